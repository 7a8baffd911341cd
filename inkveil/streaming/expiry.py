"""Expiry of uploads as a stream: by watermark, or by deadline without losing late rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.model import UPLOAD_TTL_SECONDS

LIVE = "file_id string, created_at timestamp, clock long, batch long"
EXPIRED = "file_id string, created_at timestamp, expired_at timestamp, late boolean, batch long"


def expire_stream(uploads: DataFrame, ttl: int = UPLOAD_TTL_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Uploads come out once the watermark has passed their age limit (append mode).

    State is one session window per live upload. Rows that arrive behind the
    watermark are dropped, as their time is over.
    """
    return (
        uploads.withWatermark("created_at", delay)
        .groupBy(F.session_window("created_at", f"{ttl} seconds"), "file_id")
        .agg(F.min("created_at").alias("created_at"))
        .select("file_id", "created_at", F.col("session_window.end").alias("expired_at"))
    )


def _live(spark: SparkSession, path: str, number: int) -> DataFrame:
    """What lives on after batch ``number``, and one row that has the batch's number and clock (microseconds)."""
    if number < 0:
        return spark.createDataFrame([], LIVE)
    return spark.read.schema(LIVE).parquet(f"{path}/live/{number % 2}")


def _put(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)


def expire_uploads(
    uploads: DataFrame, path: str, checkpoint: str, ttl: int = UPLOAD_TTL_SECONDS, delay: int = 0
) -> StreamingQuery:
    """Run a stream of ``(file_id, created_at)`` until it is caught up; expired uploads go to a table under ``path``.

    The clock is the latest ``created_at`` seen, less ``delay`` seconds; it never goes back.
    An upload expires when the clock reaches ``created_at + ttl``, its deadline, and is
    written once, whatever the order in which rows arrive and however often. What arrives
    when its deadline has passed is written too, marked ``late``; so is an upload without
    a time, which has no deadline.

    The state is a table of the uploads that live, so of no more than ``ttl`` seconds, written
    by each batch into the one of two folders that the batch before did not use. Expired
    uploads are looked at again only for late rows, and only where files hold their
    deadlines. A batch run again after a failure finds the state it began with and
    replaces what it left. Read results with :func:`expired_uploads` and :func:`live_uploads`.
    """
    micros = 1_000_000

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _live(spark, path, number - 1)
        last = known.agg(F.max("clock")).first()[0]
        deadline = F.unix_micros("created_at") + ttl * micros
        behind = F.col("deadline").isNull() if last is None else F.col("deadline").isNull() | (F.col("deadline") <= last)
        new = batch.select("file_id", F.col("created_at").cast("timestamp").alias("created_at"))
        new = new.withColumn("deadline", deadline).withColumn("late", behind)
        seen = new.agg(
            F.max("deadline").alias("top"), F.count_if("late").alias("n"),
            F.min(F.when(F.col("late"), F.col("deadline"))).alias("low"), F.max(F.when(F.col("late"), F.col("deadline"))).alias("high"),
        ).first()
        clocks = [x for x in (last, None if seen.top is None else seen.top - (ttl + delay) * micros) if x is not None]
        now = max(clocks, default=None)
        if seen.n and number > 0:
            # Late rows may repeat what was written long ago.
            old = expired_uploads(spark, path).where(F.col("batch") < number)
            bounds = F.col("expired_at").between(F.timestamp_micros(F.lit(seen.low)), F.timestamp_micros(F.lit(seen.high)))
            old = old.where(bounds | F.col("expired_at").isNull()).select(F.col("file_id").alias("_file"), F.col("created_at").alias("_at"))
            same = F.col("file_id").eqNullSafe(F.col("_file")) & F.col("created_at").eqNullSafe(F.col("_at"))
            new = new.where(~F.col("late")).unionAll(new.where("late").join(old, same, "left_anti"))
        stood = known.where("batch is null").withColumn("deadline", deadline).withColumn("late", F.lit(False)).drop("clock", "batch")
        rows = stood.unionByName(new).groupBy("file_id", "created_at", "deadline").agg(F.min("late").alias("late"))
        over = F.col("deadline").isNull() if now is None else F.col("deadline").isNull() | (F.col("deadline") <= now)
        _put(
            rows.where(over).select("file_id", "created_at", F.timestamp_micros("deadline").alias("expired_at"), "late"),
            f"{path}/expired/batch={number}",
        )
        clock = spark.createDataFrame([(None, None, now, number)], LIVE)
        none = F.lit(None).cast("long")
        lives = rows.where(~over).select("file_id", "created_at", none.alias("clock"), none.alias("batch"))
        _put(lives.unionAll(clock), f"{path}/live/{number % 2}")

    return uploads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``(file_id, created_at, expired_at, late, batch)`` of what :func:`expire_uploads` has written."""
    return spark.read.schema(EXPIRED).parquet(f"{path}/expired")


def live_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``(file_id, created_at)`` of uploads whose deadline the clock has not reached."""
    states = [_live(spark, path, k) for k in (0, 1) if _written(spark, path, k)]
    newest = max(states, key=lambda s: s.agg(F.max("batch")).first()[0])
    return newest.where("batch is null").select("file_id", "created_at")


def _written(spark: SparkSession, path: str, number: int) -> bool:
    try:
        _live(spark, path, number)
        return True
    except AnalysisException:
        return False
