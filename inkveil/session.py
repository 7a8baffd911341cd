"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps in frontmatter are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The rules are one deep expression, which the analyzer resolves level by level.
    "spark.sql.analyzer.maxIterations": "1000",
    # A row may hold a file of 10 MB; batches to Python must stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    # Many small files: they are listed by this many tasks at most (not one for each), and opening one counts as 256 KB.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
    "spark.sql.files.openCostInBytes": str(256 << 10),
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables, named by ``spark.checkpoint.dir``.

    On one machine without it (tests) a temporary folder is taken and the setting made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it names the folder for intermediate tables")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
