"""Intake: files, base64 payloads and tables become document rows; bad ones become rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.arrays import let
from inkveil.model import FORMATS, MAX_BYTES, formats


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(filename: Column) -> Column:
    """Lower-case suffix with its dot; '' for none and for names like ``.txt``."""
    return F.lower(F.regexp_extract(filename, "[^./](\\.[^./]+)\\z", 1))


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files under ``path`` as ``(path, filename, modificationTime, length, content)``.

    With ``max_bytes`` the size test goes into the file scan: larger files are
    never read and come as rows without content, which :func:`check_intake`
    rejects. A missing path is an error. (Files of no bytes are not listed by
    the source.)
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return sized(files, max_bytes).withColumn("filename", file_name(F.col("path")))


def sized(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """Files up to ``max_bytes`` with their content, larger ones without: two scans, one of them of names only."""
    if max_bytes is None:
        return files
    large = files.where(F.col("length") > max_bytes).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content")
    )
    return files.where(F.col("length") <= max_bytes).unionByName(large)


def from_base64(df: DataFrame, content_col: str = "payload", out_col: str = "content") -> DataFrame:
    """Decode base64; characters outside the alphabet are dropped, wrong padding is an error.

    Adds ``out_col`` (null on failure).
    """
    def decoded(clean: Column) -> Column:
        # What follows the padding does not count; padding nobody needs is ignored.
        return let(F.substring_index(clean, "=", 1), lambda body: F.when(F.length(body) % 4 == 0, body).when(
            ((F.length(body) % 4 == 2) & clean.startswith(F.concat(body, F.lit("=="))))
            | ((F.length(body) % 4 == 3) & clean.startswith(F.concat(body, F.lit("="))) & ~clean.startswith(F.concat(body, F.lit("==")))),
            F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, "="),
        ))

    data = let(F.regexp_replace(F.col(content_col), "[^A-Za-z0-9+/=]+", ""), decoded)
    return df.withColumn(out_col, F.try_to_binary(data, F.lit("base64")))


def from_table(
    df: DataFrame, id_col: str, text_col: str, source_type: str = "text", name: Column | None = None
) -> DataFrame:
    """Text already in a table, as documents."""
    name = F.concat(F.col(id_col).cast("string"), F.lit(".txt")) if name is None else name
    return df.select(
        F.col(id_col).cast("string").alias("doc_id"),
        name.alias("filename"),
        F.lit(source_type).alias("source_type"),
        F.col(text_col).alias("content"),
    )


def spread(scan: DataFrame) -> DataFrame:
    """Give a small table at least one task per core.

    For a bare scan only. A table of many files has tasks enough and stays as
    it is; one that is a few files would be worked on by a few cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def with_extension(df: DataFrame, name_col: str = "filename") -> DataFrame:
    return df.withColumn("ext", extension(F.col(name_col)))


def filter_supported(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the 7 supported extensions with their ``source_type``, and the others."""
    named = with_extension(df)
    known = F.broadcast(formats(df.sparkSession))
    return named.join(known, "ext"), named.join(known, "ext", "left_anti")


def filter_size(df: DataFrame, max_bytes: int = MAX_BYTES, length_col: str = "length") -> DataFrame:
    """Rows up to ``max_bytes``, that size included."""
    return df.where(F.col(length_col) <= max_bytes)


def intake_error(filename: Column, length: Column, max_bytes: int = MAX_BYTES) -> tuple[Column, Column]:
    """``(error_code, error)`` of a file before it is opened; nulls when it is fine."""
    ext = extension(filename)
    supported = ", ".join(e for e, _ in FORMATS)
    no_name = filename.isNull() | (filename == "")
    too_big = length > max_bytes
    unknown = ~ext.isin([e for e, _ in FORMATS])
    code = (
        F.when(no_name, "NO_FILENAME")
        .when(length.isNull(), "UNREADABLE")
        .when(too_big, "TOO_LARGE")
        .when(unknown, "UNSUPPORTED_TYPE")
        .when(length == 0, "EMPTY")
    )
    message = (
        F.when(no_name, "Filename is required")
        .when(length.isNull(), "Failed to decode content")
        .when(
            too_big,
            f"File exceeds maximum size of {max_bytes // (1024 * 1024)}MB. "
            "Consider splitting the document into smaller parts.",
        )
        .when(unknown, F.concat(F.lit("Unsupported file type: "), ext, F.lit(f". Supported types: {supported}")))
        .when(length == 0, "File is empty")
    )
    return code, message


def check_intake(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``ext``, ``source_type``, ``error_code`` and ``error``; no row is lost."""
    code, message = intake_error(F.col("filename"), F.col("length"), max_bytes)
    named = with_extension(df)
    source = F.create_map(*[F.lit(x) for pair in FORMATS for x in pair])
    return (
        named.withColumn("source_type", F.try_element_at(source, F.col("ext")))
        .withColumn("error_code", code)
        .withColumn("error", message)
    )


def rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split checked rows into good ones and rejected ones."""
    bad = F.col("error_code").isNotNull()
    return df.where(~bad), df.where(bad)
