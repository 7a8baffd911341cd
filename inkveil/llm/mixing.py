"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Every document draws an exponential key, ``-ln(u) / weight``, from a hash of its id and
text. Within a source documents go by key; sizes are summed along that order, and what a
source's target asks beyond whole epochs goes to the documents in front. Sums run within
ranges of the order, so a source may hold any share of the rows, and rows that are alike
are counted before they are shuffled. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import saved

WEIGHTS = (5, 2, 1)
SEED = "mix"
LEAST_QUALITY = 0.05
MARKUP = "0123456789<>{}[]()=;:/|_#@*+~^%$&"
COPIES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"


def text_quality(text: Column) -> Column:
    """A document's weight, 0.05 to 1: its share of characters that are no digits or marks of
    code, times its share of lines that are not repeats. Empty and null texts weigh least."""
    plain = F.try_divide(F.length(F.translate(text, MARKUP, "")), F.length(text))
    lines = F.split(text, "\n", -1)
    own = F.size(F.array_distinct(lines)) / F.size(lines)
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(plain * own, F.lit(0.0)))


def sums_before(df: DataFrame, order: list[str], sums: list[str], within: list[str], beside: DataFrame | None = None):
    """``df`` with ``<c>_before`` for each column of ``sums``: its sum over the rows of the
    same ``within`` that come earlier in ``order`` (no nulls in ``within``).

    Rows are dealt out by ranges of ``order``; one row per range and ``within`` carries the
    sums from range to range. ``beside`` (one row per ``within``) is joined to these, not
    to the rows.
    """
    part = saved(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()), "ranges")
    keys = [*within, "part__"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*within).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    ranges = part.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_range") for c in sums])
    ranges = ranges.select(*keys, *[F.sum(f"{c}_range").over(along).alias(f"{c}_range") for c in sums])
    if beside is not None:
        ranges = ranges.join(beside, within)
    rows = part.select("*", *[F.sum(c).over(inside).alias(f"{c}_inside") for c in sums]).join(ranges, keys)
    for c in sums:
        rows = rows.withColumn(
            f"{c}_before", F.coalesce(f"{c}_range", F.lit(0)) + F.coalesce(f"{c}_inside", F.lit(0))
        ).drop(f"{c}_range", f"{c}_inside")
    return rows.drop("part__")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, epochs: int = 3) -> DataFrame:
    """``(nameless, name, size)`` with ``target``: ``share`` of all sizes by weight, none above ``epochs`` times its size.

    Sources in code point order, the nameless one last, take ``weights`` in turn. A source
    is at its limit when the level (what others leave, by weight) is above its ``limit /
    weight``; sources are passed in the order of that ratio, those of one ratio together.
    """
    numbered = sums_before(sizes.withColumn("one", F.lit(1)), ["nameless", "name"], ["one"], [])
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights) + 1).cast("int"))
    numbered = numbered.select("nameless", "name", "size", turn.alias("weight"), (epochs * F.col("size")).alias("limit"))
    numbered = saved(numbered.withColumn("ratio", F.col("limit") / F.col("weight")), "sources")
    whole = numbered.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    by_ratio = numbered.groupBy("ratio").agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weighing"))
    left = (F.lit(whole[0] * share) - F.col("limits_before")) / (F.lit(whole[1]) - F.col("weighing_before"))
    levels = sums_before(by_ratio, ["ratio"], ["limits", "weighing"], []).select("ratio", left.alias("level"))
    level = levels.where("level <= ratio").agg(F.min_by("level", "ratio")).first()[0]
    # Where all limits together are below the share no level is found: all are at their limit.
    found = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float("inf") if level is None else level))
    return numbered.select("nameless", "name", "size", found.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = 1.0,
    epochs: int = 3,
    quality: Column | None = None,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, epochs, taken)``, one row per input row.

    ``size`` counts words (null and empty texts: 0), ``epochs`` how often the document is
    in the mix, ``taken`` is ``size * epochs``. A source's target in whole epochs goes to all
    its documents; the rest to those of the smallest keys, while more than half of a document
    is still asked for, so that a source misses its target by half a document at most. No
    document is taken more often than ``epochs`` times. Keys depend on id, text and ``seed`` only:
    reruns agree, and of rows that are alike any may be the one taken. The empty source name
    is a source of its own, null another one. ``quality`` is a positive weight (null, zero
    and below count as the least, 0.05). Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    weight = text_quality(text) if quality is None else F.greatest(F.lit(LEAST_QUALITY), F.coalesce(quality, F.lit(0.0)))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().alias("nameless"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        drawn.alias("drawn"),
        (-F.log(u) / weight).alias("key"),
    )
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    alike = saved(alike.withColumn("words", F.col("size") * F.col("n")), "documents")
    sizes = alike.groupBy("nameless", "name").agg(F.sum("words").alias("size"))
    targets = saved(source_targets(sizes, weights, share, epochs), "targets")
    targets = targets.withColumnRenamed("size", "source_size")
    placed = sums_before(alike, ["key", "drawn", "doc_id", "size"], ["words"], ["nameless", "name"], targets)
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    # The k-th of n alike rows is taken if 2 * (before + k * size) + size <= 2 * rest.
    behind = 2 * (rest - F.col("words_before")) - F.col("size")
    more = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least("n", F.floor(F.try_divide(behind, 2 * F.col("size"))) + 1)))
    placed = placed.select(
        "*", whole.cast("long").alias("whole"), F.coalesce(more, F.lit(0)).cast("long").alias("more")
    ).withColumn("more", F.when(F.col("whole") < epochs, F.col("more")).otherwise(0))
    # Alike rows come out one by one again, in runs that no array holds more than COPIES of.
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    last = F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1
    each = runs.withColumn("k", F.explode(F.sequence(F.col("run") * COPIES, last)))
    times = F.col("whole") + (F.col("k") < F.col("more")).cast("long")
    return each.select(
        "doc_id",
        F.when(~F.col("nameless"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        times.alias("epochs"),
        (F.col("size") * times).alias("taken"),
    )
