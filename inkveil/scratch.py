"""New folders for tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkveil.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Under the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a new folder: computed once, and not again when an executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
