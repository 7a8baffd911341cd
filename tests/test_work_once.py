"""Work that was done several times over is done once, with the same results."""

from pyspark.sql import functions as F

from inkveil.functions import patterns as P
from inkveil.model import DEFAULT_ACTIONS
from inkveil.operators import checks as C
from inkveil.operators import detect as D
from inkveil.operators.actions import sanitize_documents
from inkveil.plans import action_queries  # noqa: F401  (registers the queries)
from inkveil.plans.registry import QUERIES
from inkveil.sources.router import extract
from inkveil.streaming.files import read_listed, stream_files


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def customers(spark, tmp_path):
    spark.range(6).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_a_check_lists_the_persons_of_a_document_once(spark):
    applied = "array<struct<pii_type:string,rule:string,value:string,replacement:string>>"
    person = lambda rule, value, new: ("person_name", rule, value, new)
    docs = spark.createDataFrame(
        [(1, [person("first_name_list", "Ann Lee", "A B"), (None, None, " and ", " and "), person("honorific", "Lee", "C D")]), (2, [])],
        f"doc_id int, applied {applied}",
    )
    check = C.check_consistency(docs)
    assert [tuple(r) for r in check.collect()] == [(1, "person_name", "ann lee", 2, 2)]
    assert optimized(check).count("array_except(") == 1


def test_split_persons_are_found_with_one_listing(spark, tmp_path):
    check = QUERIES["check_consistency_of_split_persons"](spark, customers(spark, tmp_path))
    got = sorted((r.doc_id, r.pii_type, r.replacements) for r in check.collect())
    assert got == [(0, "person_name", 2), (3, "person_name", 2)]


def test_checked_values_share_the_detection(spark, tmp_path):
    check = QUERIES["check_values"](spark, customers(spark, tmp_path))
    assert optimized(check).count(P.EMAIL.target) == 1
    texts = spark.createDataFrame(
        [(1, "Ann Lee, a@b.co, Acme Corp\n\n| Company | Phone |\n|---|---|\n| Foo | 555-1234 |\n"), (2, None), (2, "call 555-123-4567")],
        "doc_id int, text string",
    )
    done = sanitize_documents(texts, DEFAULT_ACTIONS)
    shared = sanitize_documents(texts, DEFAULT_ACTIONS, found=D.detect_types(texts, DEFAULT_ACTIONS))
    content = lambda df: sorted(str((r.doc_id, r.content)) for r in df.collect())
    assert content(shared) == content(done)
    plain = lambda df, **kw: sorted(tuple(r) for r in C.check_values(df.withColumn("content", F.col("text")), DEFAULT_ACTIONS, **kw).collect())
    assert plain(shared, pieces_col="pieces") == plain(done) != []


def test_mentions_meet_the_text_where_they_are(spark, tmp_path):
    found = QUERIES["entity_map_and_text"](spark, customers(spark, tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "nth" in line]
    assert {r.other_than_in_text for r in found.collect()} == {0}


FILES = [
    ("a.txt", b"one"), ("b.TXT", "ä".encode("latin-1")), ("c.csv", b"x,y\n1,2\n"), ("d.csv", b"x\n1,2\n"), ("e.eml", b"Subject: s\n\nbody\n"),
    ("f.docx", b"no zip"), ("g.xlsx", b"no zip"), ("h.pdf", b"%PDF"), ("i.odt", b"?"), ("j", b"?"), ("k.txt", None),
]


def test_formats_that_do_not_occur_are_not_planned(spark):
    def files(some):
        rows = [(n, n, None if c is None else len(c), None if c is None else bytearray(c)) for n, c in some]
        return spark.createDataFrame(rows, "doc_id string, filename string, length long, content binary")

    def ext(name):
        return f".{name.split('.')[1].lower()}" if "." in name else ""

    for some in (FILES, FILES[:2], FILES[2:4], FILES[4:5], FILES[5:6], FILES[6:7], FILES[7:], FILES[:3] + FILES[6:]):
        whole, part = extract(files(some)), extract(files(some), exts={ext(n) for n, _ in some})
        assert part.schema == whole.schema
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))
    assert "ArrowEvalPython" not in optimized(extract(files(FILES[:2]), exts={".txt"}))


def test_a_batch_of_texts_plans_no_other_reader_and_lists_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"text {i}" * (1 + 9 * (i == 2)))
    plans = []

    def process(documents):
        plans.append(optimized(documents))
        return documents.select("filename", "content", "error_code")

    where = [str(tmp_path / x) for x in ("in", "out", "ckpt")]
    stream_files(spark, *where, process, max_files=2, max_bytes=20).awaitTermination()
    got = sorted((r.filename, r.content, r.error_code) for r in spark.read.parquet(where[1]).collect())
    assert got == [("0.txt", "text 0", None), ("1.txt", "text 1", None), ("2.txt", None, "TOO_LARGE")]
    assert len(plans) == 2 and not any("ArrowEvalPython" in p for p in plans)
    listing = spark.read.format("binaryFile").load(where[0]).select("path", "modificationTime", "length")
    read = read_listed(listing, 20)
    assert {r.modificationTime for r in read.collect()} == {r.modificationTime for r in listing.collect()}
    # Contents, and the names of those that are there; the listing itself is not read again.
    assert optimized(read).count("binaryFile") == 2
