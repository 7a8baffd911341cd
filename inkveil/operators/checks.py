"""Checks of the promises a sanitized document makes."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import marks as M
from inkveil.functions.arrays import let
from inkveil.operators.entities import resolved_keys

# The counting function travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Structure marks: pattern per kind.
STRUCTURE = {
    "headings": "(?m)^#{1,6} ",
    "table_rows": "(?m)^\\|",
    "list_items": "(?m)^ *(?:[-*+]|[0-9]+\\.) ",
    "lines": "\n",
}


def structure_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)) for k, p in STRUCTURE.items()}


def check_structure(df: DataFrame, before: str, after: str, id_col: str = "doc_id") -> DataFrame:
    """Counts of headings, table rows, list items and lines before and after."""
    old, new = structure_counts(F.col(before)), structure_counts(F.col(after))
    out = df.select(
        id_col,
        *[old[k].alias(f"{k}_before") for k in STRUCTURE],
        *[new[k].alias(f"{k}_after") for k in STRUCTURE],
    )
    same = [F.col(f"{k}_before") == F.col(f"{k}_after") for k in STRUCTURE]
    return out.withColumn("same", same[0] & same[1] & same[2] & same[3])


def check_consistency(df: DataFrame, id_col: str = "doc_id", scope: str = "document") -> DataFrame:
    """Entities with their number of different replacements (1 is right).

    Takes documents with ``applied``. Mentions are resolved as replacing does, so a
    person whose surname alone was given another replacement is found; ``scope='corpus'``
    counts over all documents. Only span rows are shuffled.
    """
    spans = F.filter("applied", lambda p: p["pii_type"].isNotNull())
    found = let(spans, lambda items: resolved_keys(items, lambda p, key, e, i: F.struct(
        p["pii_type"].alias("pii_type"), key.alias("entity_key"), p["replacement"].alias("replacement")
    )))
    keys = ["pii_type", "entity_key"] if scope == "corpus" else [id_col, "pii_type", "entity_key"]
    return (
        df.select(id_col, F.explode(F.filter(found, lambda m: m.isNotNull())).alias("m"))
        .select(id_col, "m.*")
        .groupBy(*keys)
        .agg(F.countDistinct("replacement").alias("replacements"), F.count("*").alias("mentions"))
    )


def _action_columns(actions: dict) -> dict[str, Column]:
    return {t: F.lit(a) if isinstance(a, str) else a for t, a in actions.items()}


def _action_of(kind: Column, columns: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(kind == t, a) for t, a in columns.items()], F.lit(None).cast("string"))


def check_leaks(df: DataFrame, actions: dict, text_col: str = "content", id_col: str = "doc_id") -> DataFrame:
    """Spans of types to be deleted that the detectors still find in the output (expect none).

    A removal can put two stretches next to each other; what stands between
    them is looked at again here as plain text. ``actions`` may hold columns (one
    rule set per row): a type counts in the rows that delete it.
    """
    columns = {t: a for t, a in _action_columns(actions).items() if not isinstance(actions[t], str) or actions[t] == "delete"}
    marked = M.marked(F.col(text_col), list(columns))
    spans = M.piece_spans(M.pieces(marked))
    return (
        df.select(id_col, *[a.alias(f"_{t}") for t, a in columns.items()], F.explode(spans).alias("s"))
        .where(_action_of(F.col("s.pii_type"), {t: F.col(f"_{t}") for t in columns}) == "delete")
        .select(id_col, "s.pii_type", "s.rule", "s.start", "s.value")
        .where(~F.col("value").rlike("REMOVED|REDACTED"))
    )


def _more_often(after: str, plain: str, values: list[str]) -> list[int]:
    """How often each value stands in ``after`` beyond ``plain``, overlaps with itself not counted; both read once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    left = dict.fromkeys(values, 0)
    for text, sign in ((after, 1), (plain, -1)):
        free = dict.fromkeys(values, 0)
        for end, v in automaton.iter(text):
            if end + 1 - len(v) >= free[v]:
                free[v] = end + 1
                left[v] += sign
    return [left[v] for v in values]


def times_left(after: Column, plain: Column, values: Column) -> Column:
    """``ARRAY<BIGINT>``: for each of the ``values``, none empty, its count in ``after`` less that in ``plain``.

    Linear in the texts and the values together; null without values, and such texts stay in the JVM.
    """

    @F.arrow_udf("array<bigint>")
    def count(afters: pa.Array, plains: pa.Array, many: pa.Array) -> pa.Array:
        rows = zip(afters, plains, many)
        return pa.array(
            [_more_often(a.as_py() or "", p.as_py() or "", v.as_py()) if v.is_valid else None for a, p, v in rows], pa.list_(pa.int64())
        )

    asked = F.size(values) > 0
    return count(F.when(asked, after), F.when(asked, plain), F.when(asked, values))


def check_values(
    df: DataFrame, actions: dict, before: str = "text", after: str = "content", id_col: str = "doc_id",
    pieces_col: str | None = None,
) -> DataFrame:
    """Values of any type that an action was to replace and that the output still holds (expect none).

    One row per value: ``(id, pii_type, value, left)``. A value is left where
    the output holds it more often than the plain stretches of the input do, so
    equal text that was no personal data does not count. ``actions`` may hold
    columns (one rule set per row). What an action keeps is not looked at:
    companies under keep_part and single names of persons under keep_part.
    All values of a document are counted in one pass over its texts; only what is left becomes rows.
    ``pieces_col`` is what :func:`detect_types` found in ``before`` for all types of ``actions``,
    where that is there already; the input is not gone over again then.
    """
    columns = _action_columns(actions)
    items = F.col(pieces_col) if pieces_col else M.pieces(M.marked(F.col(before), list(actions)))
    found = df.select(
        id_col, F.col(after).alias("_after"), *[a.alias(f"_{t}") for t, a in columns.items()], items.alias("_items")
    )
    columns = {t: F.col(f"_{t}") for t in columns}
    plain = F.array_join(F.transform(F.filter("_items", lambda p: p["pii_type"].isNull()), lambda p: p["value"]), "\n")

    def looked_at(p: Column) -> Column:
        action = _action_of(p["pii_type"], columns)
        kept = (action == "keep_part") & (
            (p["pii_type"] == "company") | ((p["pii_type"] == "person_name") & (F.instr(p["value"], " ") == 0))
        )
        return p["pii_type"].isNotNull() & action.isNotNull() & (p["value"] != "") & ~kept

    values = F.array_distinct(F.transform(
        F.filter("_items", looked_at), lambda p: F.struct(p["pii_type"].alias("pii_type"), p["value"].alias("value"))
    ))
    counted = found.select(id_col, "_after", plain.alias("_plain"), values.alias("_values")).withColumn(
        "_left", times_left(F.col("_after"), F.col("_plain"), F.transform("_values", lambda v: v["value"]))
    )
    left = F.filter(
        F.zip_with("_values", "_left", lambda v, n: F.struct(v["pii_type"].alias("pii_type"), v["value"].alias("value"), n.alias("left"))),
        lambda x: x["left"] > 0,
    )
    return counted.select(id_col, F.explode(left).alias("x")).select(id_col, "x.*")


def check_output_only(df: DataFrame, before: str = "text", after: str = "content", id_col: str = "doc_id") -> DataFrame:
    """True where the output with the original values put back is the input, and nothing else was added."""
    applied = F.col("applied")
    back = F.array_join(F.transform(applied, lambda p: p["value"]), "")
    out = F.array_join(F.transform(applied, lambda p: p["replacement"]), "")
    return df.select(
        id_col,
        ((back == F.col(before)) & (out == F.col(after))).alias("output_only"),
        F.size(F.filter(applied, lambda p: p["pii_type"].isNull() & (p["value"] != p["replacement"]))).alias("changed_gaps"),
    )
