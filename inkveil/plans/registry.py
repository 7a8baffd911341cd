"""Named queries over the test tables, each with the SQL that says what must come out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.session import apply_settings
from inkveil.sources.intake import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame``; without ``oracle`` only its rows are checked."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


# Tables whose rows are worked on hard (texts, or texts made from them).
TEXT_TABLES = {"documents", "pages", "customer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the small files of text tables are spread over the cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the test tables it names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
