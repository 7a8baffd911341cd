"""From raw documents to packed sequences: five stages, each of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; it is written as Parquet
to the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import apply_settings, saved
from inkveil.llm.decontaminate import keep_clean
from inkveil.llm.ngram_join import keep_one
from inkveil.llm.packing import pack
from inkveil.llm.pii import mask_pii
from inkveil.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, each decided by its own text.

    Null and empty texts are scored like any other; rows of a null id are decided too, but
    train nothing; repeated rows all stay or all go; an empty table stays empty.
    """
    apply_settings(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar texts.

    Decided row by row: two texts under one id are two documents, a row of a null id is in
    a group like others (and stays only if the group has no id), of repeated rows one
    stays. Null and empty texts are in no group and stay; an empty table stays empty.
    """
    apply_settings(spark)
    # A row of a file is known by its place (up to collisions of 63-bit hashes), other rows are written down.
    place = F.expr("shiftrightunsigned(xxhash64(_metadata.file_path, _metadata.row_index), 1)")
    try:
        docs.select(place)
    except AnalysisException:
        place = None
    return keep_one(docs, row=place)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each decided by its own text, whatever its id.

    Null and empty texts hold none and stay; repeated rows all stay or all go; an empty
    table stays empty, and without items all rows stay.
    """
    apply_settings(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` counts the new text.

    Null texts stay null (so does their ``n_chars``), empty ones empty; ids do not matter,
    repeated rows come out as often as they come in; an empty table stays empty.
    """
    apply_settings(spark)
    out = mask_pii(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of token ids.

    Null and empty texts give one piece, the end token; null ids stay null; repeated rows
    are packed as often as they come; an empty table gives no pieces.
    """
    apply_settings(spark)
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Trained classifiers and tokenizers have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
