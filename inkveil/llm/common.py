"""What the operators share: session settings, the shared folder, batches of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches to Python are bounded by rows and by bytes, as texts may be very long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

BATCH_BYTES = 4 << 20


def apply_settings(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns as ``doc_id long, text string``; null texts become empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """``(ids, texts as UTF-8)`` of about ``limit`` bytes each from batches of ``(doc_id, text)``.

    A single text above the limit comes alone; texts are never cut.
    """
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(
            batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True
        ):
            if ids and (held + len(t) > limit or len(ids) == 65_536):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids:
        yield ids, texts


def cut_batches(texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """As :func:`text_batches`, of texts at hand (ids are null)."""
    whole = pa.record_batch([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    return text_batches(iter([whole]))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from lists or numpy arrays."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def crc_mod(id_column, modulus: int):
    """``crc32(id as text) mod modulus``, the fold of a row."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def packed(a: np.ndarray) -> bytes:
    """Integers in as few bytes each as they need, the size first."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + a.astype(f"<u{kind.itemsize}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def map_texts(docs: DataFrame, text_col: str, change) -> DataFrame:
    """Rows of ``docs`` with all their columns, after ``change(texts) -> (keep, texts)``.

    ``texts`` are strings, null ones empty; ``keep`` says per row whether it stays (null:
    all do), the new texts replace the old ones (null: they stay as they are).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            kind = batch.schema.field(at).type
            keep, texts = change([t or "" for t in batch.column(at).to_pylist()])
            if texts is not None:
                null = batch.column(at).is_null().to_pylist()
                new = pa.array([None if n else t for n, t in zip(null, texts, strict=True)], kind)
                batch = batch.set_column(at, batch.schema.field(at), new)
            yield batch if keep is None else batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


ID_BITS = 1 << 22


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column); null ids stay.

    A table of ``ID_BITS`` bits, at most 65,536 rows of two numbers whatever the size of
    ``gone``, is broadcast and lets the rows pass whose bit is not set; only the others
    meet ``gone`` in a join. So texts are shuffled only where an id may be in it.
    """
    place = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(ID_BITS))
    bit = F.expr("shiftleft(1L, cast(__place & 63 as int))")
    known = gone.select(F.col(gone.columns[0]).cast("long").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    words = (
        known.select(place.alias("__place"))
        .select(F.shiftright("__place", 6).alias("__word"), bit.alias("__bit"))
        .groupBy("__word")
        .agg(F.bit_or("__bit").alias("__bits"))
    )
    marked = (
        docs.withColumn("__place", place)
        .withColumn("__word", F.shiftright("__place", 6))
        .join(F.broadcast(words), "__word", "left")
        .withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)))
    )
    passing = marked.where(~F.col("__hit")).select(docs.columns)
    return passing.unionAll(marked.where("__hit").select(docs.columns).join(known, id_col, "left_anti").select(docs.columns))
