import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from inkveil.session import apply_settings

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield apply_settings(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def sanitize_texts(spark):
    """Sanitize a list of texts; each is a document of its own."""
    from inkveil.operators.actions import sanitize_documents

    def run(texts, actions, salt="salt"):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
        done = sanitize_documents(df, actions, salt).select("doc_id", "content").collect()
        return [r.content for r in sorted(done, key=lambda r: r.doc_id)]

    return run
