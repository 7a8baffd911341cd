"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores. Results go to the no-op sink: everything is computed, nothing is written.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkveil.model import DEFAULT_ACTIONS  # noqa: E402
from inkveil.operators.actions import removal_counts, sanitize_documents  # noqa: E402
from inkveil.plans import inputs, output_queries, profile_queries, registry, source_queries  # noqa: E402, F401
from inkveil.session import apply_settings  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NUMBERS = {t: DEFAULT_ACTIONS[t] for t in ("email", "phone", "financial")}


def documents(spark):
    return registry.table(spark, SF_DIR, "documents").select("doc_id", "text")


def pages(spark):
    return registry.table(spark, SF_DIR, "pages").select("page_id", "html")


def registered(name):
    return lambda spark: registry.QUERIES[name](spark, SF_DIR)


HEADLINE = {
    "documents_email_phone_card": lambda s: sanitize_documents(documents(s), NUMBERS).select("doc_id", "content"),
    "documents_default_profile": lambda s: sanitize_documents(documents(s), DEFAULT_ACTIONS).select("doc_id", "content"),
    "documents_removals_by_type": lambda s: removal_counts(sanitize_documents(documents(s), DEFAULT_ACTIONS)),
    "pages_default_profile": lambda s: sanitize_documents(
        pages(s), DEFAULT_ACTIONS, id_col="page_id", text_col="html"
    ).select("page_id", "content"),
    "letters_default_profile": registered("sanitize_columns"),
    "documents_by_requested_profile": registered("sanitize"),
    "number_persons": registered("number_persons"),
    "resolve_profile": registered("resolve_profile"),
    "update_rules": registered("update_rules"),
    "expire_uploads": registered("expire_uploads"),
    "extract_mixed_formats": registered("extract"),
    "build_prompts": registered("build_prompts"),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_settings(spark)
    size = registry.table(spark, SF_DIR, "documents").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    # Letters are dense in personal data, documents are prose with little of it.
    letter_bytes = registry.rows(spark, SF_DIR, inputs.LETTERS).agg(F.sum(F.octet_length("text"))).first()[0]
    seconds = {}
    for name, build in HEADLINE.items():
        # The second of two runs counts: the first also warms up the JVM.
        for _ in range(2):
            begin = time.perf_counter()
            build(spark).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    main_seconds = seconds["documents_email_phone_card"]
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "documents_per_second": round(size["n"] / main_seconds, 1),
        "megabytes_per_second": round(size["bytes"] / 1e6 / main_seconds, 2),
        "prose_default_profile_megabytes_per_second": round(size["bytes"] / 1e6 / seconds["documents_default_profile"], 2),
        "letters_megabytes_per_second": round(letter_bytes / 1e6 / seconds["letters_default_profile"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
