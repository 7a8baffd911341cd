"""Array helpers that keep per-row work near-linear without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def built_once(build):
    """Remember the expression ``build(*names)`` returns, per Spark context.

    The large expressions take seconds of calls to the JVM to put together;
    they depend on column names and options only.
    """
    made = {}

    @wraps(build)
    def get(*key) -> Column:
        context = SparkContext.getOrCreate().applicationId
        if (context, key) not in made:
            for old in [k for k in made if k[0] != context]:
                del made[old]
            made[context, key] = build(*key)
        return made[context, key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain column reference may be inlined by the optimizer into a lambda and
    be computed again for each element; a lambda variable is not. The fold over
    nothing hands the value on as it is; ``transform`` would copy what ``body`` returns,
    deeply, once for each level of nesting.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def words(items: Iterable[str]) -> Column:
    """A constant string array (one literal, folded by the optimizer)."""
    return F.split(F.lit("\n".join(items)), "\n")


def contains_any(text: Column, items: Iterable[str]) -> Column:
    return F.exists(words(items), lambda w: F.contains(text, w))


def scan(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    out_type: str,
) -> Column:
    """Running fold: ``emit(state_before, item)`` (an array) for each item, flattened.

    ``aggregate`` copies its result array at each append. Folding chunk by
    chunk keeps those copies small, so an array of 100,000 items stays cheap.
    """
    empty = F.array().cast(f"array<{out_type}>")
    empty2 = F.array().cast(f"array<array<{out_type}>>")

    def in_chunk(state: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(state.alias("s"), empty.alias("out")),
            lambda acc, x: F.struct(
                step(acc["s"], x).alias("s"),
                F.concat(acc["out"], emit(acc["s"], x)).alias("out"),
            ),
        )

    def over(all_items: Column) -> Column:
        n = F.size(all_items)
        # Chunks are cut within the fold: an array of them would be a copy of all items.
        folded = F.aggregate(
            F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")),
            F.struct(zero.alias("s"), empty2.alias("out")),
            lambda acc, k: let(
                in_chunk(acc["s"], F.slice(all_items, k * CHUNK + 1, F.lit(CHUNK))),
                lambda r: F.struct(
                    r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")
                ),
            ),
        )
        return F.when(n > 0, F.flatten(folded["out"])).otherwise(empty)

    return let(items, over)


def lookup_table(entries: Column, key: Callable[[Column], Column]) -> Column:
    """Spread ``entries`` over about sqrt(n) hash slots for :func:`lookup`."""

    def build(e: Column) -> Column:
        slots = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(e).cast("double"))).cast("int"))
        return let(
            slots,
            lambda n: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda s: F.filter(e, lambda x: F.pmod(F.hash(key(x)), n) == s),
            ),
        )

    return let(entries, build)


def lookup(table: Column, key: Callable[[Column], Column], wanted: Column) -> Column:
    """The entry of ``table`` whose key equals ``wanted``, else null."""
    slot = F.get(table, F.pmod(F.hash(wanted), F.size(table)))
    return F.get(F.filter(slot, lambda x: key(x) == wanted), F.lit(0))
