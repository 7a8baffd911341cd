"""The upload registry as a table: ``uploads(file_id, filename, size, created_at, path)``.

The files themselves are under ``path``; see :mod:`inkveil.operators.storage` for reading and removing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.model import UPLOAD_TTL_SECONDS
from inkveil.operators.storage import write_files
from inkveil.scratch import written
from inkveil.sources.intake import extension

UUID = "\\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\z"


def register_uploads(df: DataFrame, path: str, storage_dir: str = "") -> DataFrame:
    """Store every file ``(filename, content)`` under an id and append it to the registry at ``path``.

    The contents go to ``storage_dir`` (without one, beside the registry, to a folder of its name and ``-files``),
    as ``<file_id><extension>``. Ids are random, so they are written to a table of their own
    first and a task that runs again writes the same file. Files come before rows: every registered path exists, and what a
    job that failed leaves is found by :func:`orphans`. A null content has a row with null ``size`` and ``path``.
    Returns the registry as it stands on disk.
    """
    folder = storage_dir or f"{path.rstrip('/')}-files"
    name = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file_id"), F.coalesce(extension(F.col("filename")), F.lit("")))
    new = written(
        df.select(F.uuid().alias("file_id"), "filename", F.current_timestamp().alias("created_at"), "content"), "uploads"
    ).select(
        "file_id", "filename", F.length("content").cast("long").alias("size"), "created_at",
        F.when(F.col("content").isNotNull(), name).alias("path"), "content",
    )
    stored = write_files(new)
    stored.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(stored.schema).parquet(path)


def is_file_id(file_id: Column) -> Column:
    return file_id.rlike(UUID)


def get_uploads(uploads: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The uploads asked for, and the asked ids that are malformed or unknown."""
    asked = ids.select("file_id")
    known = uploads.where(is_file_id(F.col("file_id")))
    return known.join(asked, "file_id", "left_semi"), asked.join(known, "file_id", "left_anti")


def list_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All uploads without their content, and their number and size."""
    rows = uploads.select("file_id", "filename", "size", "created_at")
    return rows, uploads.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def delete_uploads(uploads: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The uploads that stay, and per asked id whether it was there."""
    asked = ids.select("file_id").distinct()
    present = uploads.select("file_id", F.lit(True).alias("deleted")).distinct()
    outcome = asked.join(present, "file_id", "left").select(
        "file_id", F.coalesce("deleted", F.lit(False)).alias("deleted")
    )
    return uploads.join(asked, "file_id", "left_anti"), outcome


def _age_micros(now: Column, then: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))


def expire(uploads: DataFrame, now: Column, ttl: int = UPLOAD_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """The uploads that stay and those older than ``ttl`` seconds (exactly ``ttl`` stays)."""
    old = _age_micros(now, F.col("created_at")) > ttl * 1_000_000
    return uploads.where(~old), uploads.where(old)


def orphans(listing: DataFrame, uploads: DataFrame, now: Column, ttl: int = UPLOAD_TTL_SECONDS) -> DataFrame:
    """Files on disk ``(path, modificationTime)`` no upload knows and older than ``ttl``.

    A listing by Spark passes over files without any bytes.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, "(?<=[^.])\\.[^.]*\\z", "")
    return (
        listing.withColumn("file_id", stem)
        .where(_age_micros(now, F.col("modificationTime")) > ttl * 1_000_000)
        .join(uploads.select("file_id"), "file_id", "left_anti")
    )
