"""Queries: intake, extraction and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkveil.model import FORMATS
from inkveil.operators.actions import sanitize_text
from inkveil.plans import inputs as I
from inkveil.plans import sample_files as S
from inkveil.plans.action_queries import DEFAULT_DOCS
from inkveil.plans.registry import query, rows, table
from inkveil.scratch import new_folder
from inkveil.sources import docx, eml, intake, router, tables, text, xlsx
from inkveil.streaming.expiry import expire_stream, expire_uploads, expired_uploads, live_uploads
from inkveil.streaming.files import stream_files as run_stream

SUPPORTED = "(VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in FORMATS) + ") AS f(ext, source_type)"


FILE_LIMIT = 3000


@query(
    f"SELECT doc_id, strlen(text) + 1 AS length, CASE WHEN strlen(text) + 1 > {FILE_LIMIT} THEN 'TOO_LARGE' END AS error_code, "
    f"CASE WHEN strlen(text) + 1 <= {FILE_LIMIT} THEN text || chr(10) END AS content FROM documents"
)
def read_files(spark, sf_dir):
    """Each document a file; those over the limit come as rejects, unread."""
    folder = new_folder(spark, "files")
    S.text_files(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("name"), "text"), folder)
    files = intake.check_intake(intake.read_files(spark, folder, FILE_LIMIT), FILE_LIMIT)
    return files.select(
        F.regexp_extract("path", "/doc_id=(-?[0-9]*)-[0-9]+\\.txt\\z", 1).try_cast("long").alias("doc_id"),
        "length", "error_code", F.col("content").cast("string").alias("content"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN text END AS text FROM documents")
def from_base64(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    good = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    # Line breaks and foreign characters are ignored; a missing character is an error.
    payload = (
        F.when(F.col("doc_id") % 4 == 1, F.regexp_replace(good, "(.{76})", "$1\r\n"))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("!"), good, F.lit("*")))
        .when(F.col("doc_id") % 4 == 3, good.substr(F.lit(1), F.length(good) - 3))
        .otherwise(good)
    )
    return intake.from_base64(docs.withColumn("payload", payload)).select(
        "doc_id", F.col("content").cast("string").alias("text")
    )


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) || '.txt' AS filename, 'text' AS source_type, "
    "text AS content FROM documents UNION ALL "
    "SELECT CAST(page_id AS VARCHAR), url, 'html', html FROM pages UNION ALL "
    "SELECT CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR) || '.txt', 'text', text FROM conversations"
)
def from_table(spark, sf_dir):
    docs = intake.from_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    pages = intake.from_table(table(spark, sf_dir, "pages"), "page_id", "html", "html", F.col("url"))
    turns = intake.from_table(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return docs.unionByName(pages).unionByName(turns)


@query(f"SELECT doc_id, filename, {I.EXT} AS ext FROM ({I.FILES})")
def with_extension(spark, sf_dir):
    return intake.with_extension(rows(spark, sf_dir, I.FILES)).select("doc_id", "filename", "ext")


@query(f"SELECT doc_id, filename, ext, source_type FROM (SELECT *, {I.EXT} AS ext FROM ({I.FILES})) x JOIN {SUPPORTED} USING (ext)")
def filter_supported(spark, sf_dir):
    good, _ = intake.filter_supported(rows(spark, sf_dir, I.FILES))
    return good.select("doc_id", "filename", "ext", "source_type")


@query(f"SELECT doc_id, filename, ext FROM (SELECT *, {I.EXT} AS ext FROM ({I.FILES})) x WHERE ext NOT IN (SELECT ext FROM {SUPPORTED})")
def unsupported_files(spark, sf_dir):
    _, bad = intake.filter_supported(rows(spark, sf_dir, I.FILES))
    return bad.select("doc_id", "filename", "ext")


@query(f"SELECT doc_id, filename, length FROM ({I.FILES}) WHERE length <= 5000")
def filter_size(spark, sf_dir):
    return intake.filter_size(rows(spark, sf_dir, I.FILES), 5000).select("doc_id", "filename", "length")


_LIST = ", ".join(e for e, _ in FORMATS)


@query(
    f"SELECT doc_id, CASE WHEN length > 5242880 / 1000 THEN 'TOO_LARGE' ELSE 'UNSUPPORTED_TYPE' END AS error_code, "
    f"CASE WHEN length > 5242880 / 1000 THEN 'File exceeds maximum size of 5MB. Consider splitting the document into smaller parts.' "
    f"ELSE 'Unsupported file type: ' || ext || '. Supported types: {_LIST}' END AS error "
    f"FROM (SELECT *, {I.EXT} AS ext FROM ({I.FILES})) x WHERE length > 5242880 / 1000 OR ext NOT IN (SELECT ext FROM {SUPPORTED})"
)
def rejects(spark, sf_dir):
    # Sizes are scaled up, so that some of the documents are too large.
    files = rows(spark, sf_dir, I.FILES).withColumn("length", F.col("length") * 1000)
    _, bad = intake.rejects(intake.check_intake(files, 5 * 1024 * 1024))
    return bad.select("doc_id", "error_code", "error")


@query("SELECT doc_id, 'text' AS source_type, text AS content FROM documents")
def extract_text(spark, sf_dir):
    """Even documents as UTF-8, odd ones as Latin-1."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "content",
        F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")),
    )
    return text.extract_text(docs).select("doc_id", "source_type", "content")


_LINES = "string_split(text, chr(10))"
_TABLE = (
    "'| no | line |' || chr(10) || '|---|---|' || list_aggregate(list_transform(" + _LINES + ", "
    "lambda x, i: chr(10) || '| ' || CAST(i AS VARCHAR) || ' | ' || replace(x, '|', '\\|') || ' |'), 'string_agg', '')"
)


@query(
    f"SELECT doc_id, {_TABLE} AS content, CAST(len({_LINES}) AS INTEGER) AS row_count, CAST(2 AS INTEGER) AS column_count FROM documents"
)
def extract_csv(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", S.csv_file(F.col("text")))
    return tables.extract_csv(docs).select("doc_id", "content", "row_count", "column_count")


@query(
    f"SELECT doc_id, CAST(i AS INTEGER) AS row_no, CASE WHEN i = 0 THEN 'no' ELSE CAST(i AS VARCHAR) END AS cell_1, "
    f"CASE WHEN i = 0 THEN 'line' ELSE l[i] END AS cell_2 FROM (SELECT doc_id, {_LINES} AS l FROM documents) t, "
    "unnest(range(0, len(l) + 1)) AS u(i)"
)
def csv_cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", S.csv_file(F.col("text")))
    cells = text.table_cells(tables.csv_cells(docs))
    return cells.select(
        "doc_id", "row_no", F.get("cells", F.lit(0)).alias("cell_1"), F.get("cells", F.lit(1)).alias("cell_2")
    )


# A table per customer: a header row and one row per order.
_CELLS = (
    "SELECT c_custkey AS doc_id, 0 AS table_no, CAST(-1 AS BIGINT) AS row_no, {head} AS cells FROM customer UNION ALL "
    "SELECT o_custkey, 0, o_orderkey, {row} FROM orders"
)


@query(
    "SELECT c_custkey AS doc_id, 0 AS table_no, '| order | a\\|b |' || chr(10) || '|---|---|' || coalesce(r, '') AS content "
    "FROM customer LEFT JOIN (SELECT o_custkey, string_agg(chr(10) || '| ' || CAST(o_orderkey AS VARCHAR) || ' | ' || "
    "o_orderpriority || '\\| x |', '' ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"
)
def render_table(spark, sf_dir):
    cells = rows(spark, sf_dir, _CELLS.format(
        head="array('order', 'a|b')", row="array(CAST(o_orderkey AS STRING), o_orderpriority || '|' || chr(10) || 'x')"
    ))
    return text.render_table(cells)


@query(
    "SELECT doc_id, '## Email Headers' || chr(10) || chr(10) || '**From:** John Smith <john@example.com>' || chr(10) || "
    "'**To:** Ann <ann@example.com>, Bob <bob@example.com>' || chr(10) || '**Subject:** Größe ' || CAST(doc_id AS VARCHAR) || chr(10) || "
    "'**Date:** Mon, 01 Jan 2024 10:00:00 +0000' || chr(10) || chr(10) || '## Email Body' || chr(10) || chr(10) || text AS content, "
    "'Größe ' || CAST(doc_id AS VARCHAR) AS subject FROM documents"
)
def extract_eml(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", S.eml_file(F.col("doc_id"), F.col("text")))
    return eml.extract_eml(docs).select("doc_id", "content", "subject")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR text = '' THEN '<p>' || CAST(doc_id AS VARCHAR) || '</p>' ELSE text END AS body FROM documents"
)
def eml_body(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", S.multipart_file(F.col("doc_id"), F.col("text")))
    shown = "## Email Headers\n\n**Subject:** parts\n\n## Email Body\n\n"
    return eml.extract_eml(docs).select(
        "doc_id", F.col("content").substr(F.lit(len(shown) + 1), F.length("content")).alias("body")
    )


_PARAGRAPHS = (
    f"list_aggregate(list_transform(list_filter({_LINES}, lambda x, i: i = 1 OR trim(x) <> ''), "
    f"lambda x, i: CASE WHEN i = 1 THEN '# ' || x ELSE x END), 'string_agg', chr(10) || chr(10))"
)
_DOCX_TABLE = (
    "'| no | line |' || chr(10) || '|---|---|' || list_aggregate(list_transform(" + _LINES + ", "
    "lambda x, i: chr(10) || '| ' || CAST(i AS VARCHAR) || ' | ' || replace(trim(x), '|', '\\|') || ' |'), 'string_agg', '')"
)
_BLANK = "chr(10) || chr(10)"


@query(f"SELECT doc_id, {_PARAGRAPHS} || {_BLANK} || {_BLANK} || {_DOCX_TABLE} || {_BLANK} AS content FROM documents")
def extract_docx(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", S.docx_file(F.col("text")))
    return docx.extract_docx(docs).select("doc_id", "content")


@query(
    f"SELECT doc_id, CAST(len({_LINES}) + 1 AS INTEGER) AS table_rows, {_LINES}[-1] AS last_cell FROM documents"
)
def docx_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("_zip", docx.zip_parts(S.docx_file(F.col("text"))))
    found = docs.withColumn("cells", F.get(docx.docx_tables(F.col("_zip.parts")), F.lit(0)))
    return found.select(
        "doc_id", F.size("cells").alias("table_rows"),
        F.element_at(F.element_at("cells", -1), -1).alias("last_cell"),
    )


@query(
    f"SELECT doc_id, '## Sheet: Lines' || {_BLANK} || {_TABLE} AS content, CAST(2 AS INTEGER) AS sheet_count, "
    "'Lines,Empty' AS sheets FROM documents"
)
def extract_xlsx(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", S.xlsx_file(F.col("text")))
    return xlsx.extract_xlsx(docs).select("doc_id", "content", "sheet_count", F.array_join("sheets", ",").alias("sheets"))


PAGED = (
    "SELECT CAST(floor(doc_id / 10) AS BIGINT) AS doc_id, CAST(doc_id % 10 + 1 AS INT) AS page_no, "
    "CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END AS text FROM documents"
)


@query(
    f"SELECT doc_id, 'pdf' AS source_type, coalesce(string_agg('## Page ' || CAST(page_no AS VARCHAR) || {_BLANK} || text, {_BLANK} ORDER BY page_no) "
    f"FILTER (WHERE trim(replace(text, chr(10), '')) <> ''), '') AS content, CAST(count(*) AS INTEGER) AS page_count FROM ({PAGED}) GROUP BY doc_id"
)
def page_sections(spark, sf_dir):
    return text.page_sections(rows(spark, sf_dir, PAGED))


_EMAIL_DOC = (
    "'## Email Headers' || chr(10) || chr(10) || '**From:** John Smith <john@example.com>' || chr(10) || "
    "'**To:** Ann <ann@example.com>, Bob <bob@example.com>' || chr(10) || '**Subject:** Größe ' || CAST(doc_id AS VARCHAR) || chr(10) || "
    "'**Date:** Mon, 01 Jan 2024 10:00:00 +0000' || chr(10) || chr(10) || '## Email Body' || chr(10) || chr(10) || text"
)


@query(
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id,
      CASE doc_id % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'csv' WHEN 3 THEN 'email' WHEN 4 THEN 'docx'
                      WHEN 5 THEN 'excel' WHEN 6 THEN 'pdf' END AS source_type,
      CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN {_TABLE} WHEN 3 THEN {_EMAIL_DOC}
        WHEN 4 THEN {_PARAGRAPHS} || {_BLANK} || {_BLANK} || {_DOCX_TABLE} || {_BLANK}
        WHEN 5 THEN '## Sheet: Lines' || {_BLANK} || {_TABLE} END AS content,
      CASE doc_id % 8 WHEN 6 THEN 'PDF_NOT_READ' WHEN 7 THEN 'UNSUPPORTED_TYPE' END AS error_code
    FROM documents
    """
)
def extract(spark, sf_dir):
    """A mix of all formats through the one reader."""
    kind = F.col("doc_id") % 8
    data = (
        F.when(kind == 1, F.encode("text", "ISO-8859-1"))
        .when(kind == 2, S.csv_file(F.col("text")))
        .when(kind == 3, S.eml_file(F.col("doc_id"), F.col("text")))
        .when(kind == 4, F.col("_docx"))
        .when(kind == 5, F.col("_xlsx"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    ext = F.get(F.split(F.lit(".txt,.TXT,.csv,.eml,.docx,.xlsx,.pdf,.odt"), ","), kind.cast("int"))
    files = (
        table(spark, sf_dir, "documents")
        .withColumn("_docx", S.docx_file(F.when(kind == 4, F.col("text"))))
        .withColumn("_xlsx", S.xlsx_file(F.when(kind == 5, F.col("text"))))
        .select(
            "doc_id", F.concat(F.lit("file"), F.col("doc_id").cast("string"), ext).alias("filename"),
            data.alias("content"),
        )
        .withColumn("length", F.length("content"))
    )
    return router.extract(files).select("doc_id", "source_type", "content", "error_code")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CASE doc_id % 2 WHEN 0 THEN 'docx' ELSE 'excel' END END AS kind, "
    "CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'DOCX_READ' ELSE 'XLSX_READ' END END AS error_code, "
    "doc_id % 3 <> 0 AS has_text FROM documents"
)
def extract_broken_files(spark, sf_dir):
    """Word and Excel files, one in three with a part cut off: an error, never an empty document."""
    word, cut = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    files = (
        table(spark, sf_dir, "documents")
        .withColumn("_a", S.docx_file(F.when(word & ~cut, F.col("text"))))
        .withColumn("_b", S.broken_docx_file(F.when(word & cut, F.col("text"))))
        .withColumn("_c", S.xlsx_file(F.when(~word & ~cut, F.col("text"))))
        .withColumn("_d", S.broken_xlsx_file(F.when(~word & cut, F.col("text"))))
        .select(
            "doc_id", F.when(word, "f.docx").otherwise("f.xlsx").alias("filename"),
            F.coalesce("_a", "_b", "_c", "_d").alias("content"),
        )
        .withColumn("length", F.length("content"))
    )
    return router.extract(files).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("error_code").isNull(), F.col("source_type")).alias("kind"),
        "error_code", F.coalesce(F.length("content") > 0, F.lit(False)).alias("has_text"),
    )


# A workbook per customer, a row per order: the customer's even number means the calendar of 1904, every 100th has a cell far right.
# Nine digits of a day are well within a second.
_SECOND = "((o_orderkey * 37) % 86400)"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_TIME = f"strftime(TIMESTAMP '2000-01-01 00:00:00' + INTERVAL 1 SECOND * CAST({_SECOND} AS INT), '%H:%M:%S')"
_SERIAL = (
    "(CAST(date_diff('day', CASE o_custkey % 2 WHEN 0 THEN DATE '1904-01-01' ELSE DATE '1899-12-30' END, CAST(o_orderdate AS DATE)) AS BIGINT))"
)
_FRACTION = f"lpad(CAST(({_SECOND} * 1000000000) // 86400 AS VARCHAR), 9, '0')"
_FAR = "o_custkey % 100 = 0"
CELL_LIMIT = 300_000


def _dated_row(gap):
    return (
        f"string_agg(chr(10) || '| ' || CAST(o_orderkey AS VARCHAR) || ' | ' || {_DAY} || ' 00:00:00 | ' || {_DAY} || ' ' || {_TIME} || ' | ' || "
        f"CAST({_SERIAL} AS VARCHAR) || '.' || {_FRACTION} || ' | ' || {_TIME} || ' | 36:00:00' || {gap} || ' |', '' ORDER BY o_orderkey)"
    )


@query(
    "SELECT o_custkey, CASE WHEN error_code IS NULL THEN strlen(content) ELSE 0 END AS length, "
    "CASE WHEN error_code IS NULL THEN md5(content) END AS digest, error_code FROM ("
    f"SELECT o_custkey, CASE WHEN {_FAR} AND (count(*) + 1) * 16384 > {CELL_LIMIT} THEN 'XLSX_READ' END AS error_code, "
    f"'## Sheet: Dates' || {_BLANK} || '| key | date | moment | days | time | hours' || "
    f"CASE WHEN {_FAR} THEN repeat(' | ', 16384 - 6) || 'far' ELSE '' END || ' |' || chr(10) || "
    f"'|' || repeat('---|', CASE WHEN {_FAR} THEN 16384 ELSE 6 END) || "
    f"CASE WHEN {_FAR} THEN {_dated_row("repeat(' | ', 16384 - 6)")} ELSE {_dated_row("''")} END AS content "
    "FROM orders GROUP BY o_custkey)"
)
def extract_dated_workbooks(spark, sf_dir):
    """Dates, times and durations by style and calendar; sheets with a cell in the last column, some over the limit on cells."""
    second = F.col("o_orderkey") * 37 % 86400
    first_day = F.when(F.col("o_custkey") % 2 == 0, F.lit("1904-01-01")).otherwise(F.lit("1899-12-30")).cast("date")
    line = F.concat(
        F.col("o_orderkey").cast("string"), F.lit(","), F.datediff(F.col("o_orderdate").cast("date"), first_day).cast("string"),
        F.lit("."), F.lpad(F.floor(second * 1000000000 / 86400).cast("string"), 9, "0"),
    )
    lines = F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    head = F.concat(
        F.when(F.col("o_custkey") % 2 == 0, "1904").otherwise("1900"), F.when(F.col("o_custkey") % 100 == 0, ",far").otherwise(","),
    )
    # Few bytes become much text: a number of partitions that is given is not made smaller again.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    books = table(spark, sf_dir, "orders").repartition(tasks, "o_custkey").groupBy("o_custkey").agg(lines.alias("lines")).select(
        "o_custkey",
        S.dated_xlsx_file(F.concat(head, F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))).alias("content"),
    )
    return xlsx.extract_xlsx(books, CELL_LIMIT).select(
        "o_custkey", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("length"), F.md5("content").alias("digest"), "error_code"
    )


# -- streams -----------------------------------------------------------------

@query(f"SELECT {DEFAULT_DOCS} || chr(10) AS content, 'text' AS source_type FROM documents")
def stream_files(spark, sf_dir):
    """Each document a text file; the stream picks them up and sanitizes them."""
    folder = new_folder(spark, "stream")
    S.text_files(table(spark, sf_dir, "documents").select(F.lit("document").alias("name"), "text"), f"{folder}/in")

    # Put together once, not for each batch.
    clean = sanitize_text(F.col("content")).alias("content")

    def process(documents):
        return documents.select("doc_id", "source_type", clean, "error")

    run_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", process).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("content", "source_type")


@query(
    f"SELECT file_id, created_at, created_at + INTERVAL 300 SECOND AS expired_at FROM ({I.UPLOADS}) "
    "WHERE created_at + INTERVAL 300 SECOND <= (SELECT max(ts) FROM events)"
)
def expire_stream_uploads(spark, sf_dir):
    folder = new_folder(spark, "expiry")
    events = table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(events.schema)
        # As a pattern, so that the table may be a file or a folder of part files.
        .parquet(f"{sf_dir}/events.parque[t]")
        .select(F.expr(I.uuid_of("event_id")).alias("file_id"), F.col("ts").cast("timestamp").alias("created_at"))
    )
    done = (
        expire_stream(stream)
        .writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema("file_id string, created_at timestamp, expired_at timestamp").parquet(f"{folder}/out")


def _upload_batches(spark, sf_dir, folder):
    """The events in ten files of no order, a file a batch."""
    events = table(spark, sf_dir, "events")
    events.repartition(10, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return stream.select(F.expr(I.uuid_of("event_id")).alias("file_id"), F.col("ts").cast("timestamp").alias("created_at"))


@query(
    f"SELECT file_id, created_at, created_at + INTERVAL 300 SECOND AS expired_at, true AS expired FROM ({I.UPLOADS}) "
    "WHERE created_at + INTERVAL 300 SECOND <= (SELECT max(ts) FROM events) UNION ALL "
    f"SELECT file_id, created_at, NULL, false FROM ({I.UPLOADS}) WHERE created_at + INTERVAL 300 SECOND > (SELECT max(ts) FROM events)"
)
def expire_unsorted_uploads(spark, sf_dir):
    """Every upload once, expired or live, though nearly all arrive late."""
    folder = new_folder(spark, "expiry")
    expire_uploads(_upload_batches(spark, sf_dir, folder), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    over = expired_uploads(spark, f"{folder}/out").select("file_id", "created_at", "expired_at", F.lit(True).alias("expired"))
    live = live_uploads(spark, f"{folder}/out")
    return over.unionAll(live.select("file_id", "created_at", F.lit(None).cast("timestamp"), F.lit(False)))


@query(
    f"SELECT CASE WHEN strlen(text) + 1 > {FILE_LIMIT} THEN 'TOO_LARGE' END AS error_code, "
    f"CASE WHEN strlen(text) + 1 <= {FILE_LIMIT} THEN text || chr(10) END AS content FROM documents"
)
def stream_files_under_limit(spark, sf_dir):
    """The stream lists all files and reads those under the limit."""
    folder = new_folder(spark, "stream")
    S.text_files(table(spark, sf_dir, "documents").select(F.lit("document").alias("name"), "text"), f"{folder}/in")
    run_stream(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint",
        lambda d: d.select("error_code", "content"), max_bytes=FILE_LIMIT,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("error_code", "content")
