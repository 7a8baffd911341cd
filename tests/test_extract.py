"""Intake and extraction, e-mail against the standard library's parser."""

import base64
import email
import io
import zipfile
from datetime import datetime, timedelta
from email import policy
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from inkveil.plans.sample_files import docx_of, xlsx_of
from inkveil.sources import intake, xlsx
from inkveil.sources.router import extract


def files_df(spark, files):
    rows = [(n, n, len(b), bytearray(b)) for n, b in files]
    return spark.createDataFrame(rows, "doc_id string, filename string, length long, content binary").coalesce(1)


def run(spark, files, **kw):
    return {r.doc_id: r for r in extract(files_df(spark, files), **kw).collect()}


def test_formats_and_rejects(spark):
    bad_zip = io.BytesIO()
    with zipfile.ZipFile(bad_zip, "w") as z:
        z.writestr("foo", "x")
    out = run(spark, [
        ("utf8.txt", b"Hello, World!\nThis is a test."),
        ("latin.txt", b"Hello \xe9\xe8\xe0"),
        ("t.csv", b'Name,Email,Phone\nJohn,john@test.com,555-1234\n"a|b","x\ny",\n'),
        ("ragged.csv", b"a,b\n1,2,3\n"),
        ("blank.csv", b"\n\n"),
        ("test.xyz", b"x"),
        ("a.docx", b"not a zip"),
        ("b.docx", bad_zip.getvalue()),
        ("c.DOCX", docx_of("Title\nBody & <more>\n\nlast | one")),
        ("d.xlsx", xlsx_of("one\n\nthree|3")),
        ("e.xlsx", b"zzz"),
        ("old.xls", b"x"),
        ("p.pdf", b"%PDF"),
        ("page.html", b"<p>hi</p>"),
    ], readers={".html": ("html", lambda c: F.regexp_replace(c.cast("string"), "<[^>]*>", ""))})
    assert out["utf8.txt"].content == "Hello, World!\nThis is a test." and out["utf8.txt"].source_type == "text"
    assert out["latin.txt"].content == "Hello éèà"
    assert out["t.csv"].content == (
        "| Name | Email | Phone |\n|---|---|---|\n| John | john@test.com | 555-1234 |\n| a\\|b | x y |  |"
    )
    assert (out["t.csv"].row_count, out["t.csv"].column_count) == (2, 3)
    assert out["c.DOCX"].content == (
        "# Title\n\nBody & <more>\n\nlast | one\n\n\n\n| no | line |\n|---|---|\n| 1 | Title |\n| 2 | Body & <more> |\n| 3 |  |\n| 4 | last \\| one |\n\n"
    )
    assert out["d.xlsx"].content == "## Sheet: Lines\n\n| no | line |\n|---|---|\n| 1 | one |\n| 2 |  |\n| 3 | three\\|3 |"
    assert (out["d.xlsx"].sheet_count, out["d.xlsx"].sheets) == (2, ["Lines", "Empty"])
    assert out["page.html"].content == "hi" and out["page.html"].source_type == "html"
    codes = {n: r.error_code for n, r in out.items() if r.error_code}
    assert codes == {
        "ragged.csv": "CSV_PARSE", "blank.csv": "CSV_PARSE", "test.xyz": "UNSUPPORTED_TYPE", "a.docx": "DOCX_READ",
        "b.docx": "DOCX_READ", "e.xlsx": "XLSX_READ", "old.xls": "XLS_NOT_READ", "p.pdf": "PDF_NOT_READ",
    }
    assert all(out[n].content is None for n in codes)


def test_size_limit(spark):
    files = spark.createDataFrame([("a.txt", 11 * 1024 * 1024), ("b.txt", 10 * 1024 * 1024), ("c.txt", 0), ("", 5)], "filename string, length long")
    good, bad = intake.rejects(intake.check_intake(files))
    assert [r.filename for r in good.collect()] == ["b.txt"]
    assert {r.filename: r.error_code for r in bad.collect()} == {"a.txt": "TOO_LARGE", "c.txt": "EMPTY", "": "NO_FILENAME"}


def test_broken_parts_are_errors(spark):
    """Truncated or foreign XML in a part that is needed must not become an empty document."""
    good_doc = '<w:document xmlns:w="x"><w:body><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    book = '<workbook><sheets><sheet name="A" r:id="r1" xmlns:r="y"/></sheets></workbook>'
    relations = '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'
    sheet = "<worksheet><sheetData><row><c><v>1</v></c></row><row><c><v>2</v></c></row></sheetData></worksheet>"

    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return out.getvalue()

    def excel(**changed):
        parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": relations, "xl/worksheets/s.xml": sheet, "xl/media/p.png": "x" * 999}
        return packed({k: changed.get(k.split("/")[-1].split(".")[0], v) for k, v in parts.items()})

    files = {
        "good.docx": packed({"word/document.xml": good_doc}),
        "cut.docx": packed({"word/document.xml": good_doc[:-20]}),
        "other.docx": packed({"word/document.xml": "<x/>"}),
        "empty.docx": packed({"word/document.xml": ""}),
        "style.docx": packed({"word/document.xml": good_doc, "word/styles.xml": "<w:styles><w:style"}),
        "good.xlsx": excel(),
        "book.xlsx": excel(workbook=book[:-9]),
        "sheet.xlsx": excel(s=sheet[:40]),
        "bom.csv": "\ufeffName,x\nZed Quux,1\n".encode(),
    }
    df = spark.createDataFrame([(n, n, len(b), b) for n, b in files.items()], "doc_id string, filename string, length long, content binary")
    out = {r.filename: r for r in extract(df).collect()}
    assert {n: r.error_code for n, r in out.items()} == {
        "good.docx": None, "cut.docx": "DOCX_READ", "other.docx": "DOCX_READ", "empty.docx": "DOCX_READ", "style.docx": "DOCX_READ",
        "good.xlsx": None, "book.xlsx": "XLSX_READ", "sheet.xlsx": "XLSX_READ", "bom.csv": None,
    }
    assert all((r.content is None) == (r.error_code is not None) for r in out.values())
    assert out["good.docx"].content == "text"
    assert out["bom.csv"].content.startswith("| Name | x |")


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"abc")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    assert {r.filename for r in intake.read_files(spark, str(tmp_path)).collect()} == {"a.txt", "big.txt"}
    small = intake.read_files(spark, str(tmp_path), max_bytes=50)
    assert {r.filename: (r.length, r.content) for r in small.collect()} == {"a.txt": (3, b"abc"), "big.txt": (100, None)}
    codes = {r.filename: r.error_code for r in intake.check_intake(small, 50).collect()}
    assert codes == {"a.txt": None, "big.txt": "TOO_LARGE"}
    assert "LessThanOrEqual(length,50)" in small._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        intake.read_files(spark, str(tmp_path / "none")).collect()


def test_base64(spark):
    cases = ["VGVzdCBjb250ZW50", "VGVz\ndA==", "VGVzdA", "VGVzdA=", "V", "!!VGVz!!", "", "VGVz=", "VGVzdA==junk", "*"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, payload string")
    for r in intake.from_base64(df).collect():
        try:
            want = base64.b64decode(cases[r.i])
        except Exception:
            want = None
        assert (None if r.content is None else bytes(r.content)) == want, cases[r.i]


def test_base64_is_cleaned_once_and_not_matched_in_groups(spark):
    long = base64.b64encode(b"x" * 300_001).decode()
    cases = [long, long[:-2], long[:-1] + "\n" + long[-1:], "AAA==", "AAA=A=", "AA=A=", "AA==A", "=", "==", "AAAA=", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, payload string")
    done = intake.from_base64(df)
    got = {r.i: None if r.content is None else bytes(r.content) for r in done.collect()}
    data = b"x" * 300_001
    assert [got[i] for i in range(len(cases))] == [data, None, data, None, b"\0\0", None, b"\0", b"", b"", b"\0\0\0", None]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z0-9+/=]") == 1 and "{4}" not in plan


def test_extensions(spark):
    names = {"a.TXT": ".txt", "x.tar.gz": ".gz", ".txt": "", "noext": "", "a.b/c": "", "trailing.": "", "..txt": ".txt"}
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    for r in intake.with_extension(df).collect():
        if r.filename != "..txt":
            assert r.ext == names[r.filename], r.filename


def reference_body(msg):
    body = ""
    if not msg.is_multipart():
        return (msg.get_payload(decode=True) or b"").decode("utf-8", errors="replace")
    for part in msg.walk():
        if part.get_content_type() not in ("text/plain", "text/html"):
            continue
        data = part.get_payload(decode=True)
        if data and part.get_content_type() == "text/plain":
            return data.decode("utf-8", errors="replace")
        if data and not body:
            body = data.decode("utf-8", errors="replace")
    return body


def messages():
    plain = EmailMessage()
    plain["From"], plain["To"], plain["Subject"] = "Jörg Müller <j@example.com>", "a@b.c, d@e.f", "Grüße aus " + "Köln " * 20
    plain["Date"] = "Mon, 01 Jan 2024 10:00:00 +0100"
    plain.set_content("Hällo\nWorld = 100%\n" + "long " * 60)
    yield plain.as_bytes()
    alt = EmailMessage()
    alt["Subject"], alt["Cc"] = "alternatives", "x@y.z"
    alt.set_content("plain tëxt")
    alt.add_alternative("<p>html</p>", subtype="html")
    alt.add_attachment(b"\x00\x01bytes", maintype="application", subtype="octet-stream", filename="a.bin")
    yield alt.as_bytes()
    yield alt.as_bytes(policy=policy.SMTP)
    html = EmailMessage()
    html["Subject"] = "html only"
    html.add_alternative("<b>first ü</b>", subtype="html")
    html.add_attachment("attached text", filename="t.txt")
    yield html.as_bytes(policy=policy.SMTP)
    b64 = EmailMessage()
    b64.set_content("Grüße " * 50, cte="base64")
    yield b64.as_bytes()
    yield b"Subject: bad bytes\nContent-Type: text/plain\n\nabc \xe9 def\n"
    yield b"no headers at all"
    yield b"\nbody after empty line\n"


def test_eml_like_the_standard_parser(spark):
    raw = list(messages())
    out = run(spark, [(f"m{i}.eml", b) for i, b in enumerate(raw)])
    for i, b in enumerate(raw):
        msg = email.message_from_bytes(b, policy=policy.default)
        got = out[f"m{i}.eml"]
        head = "".join(f"**{h}:** {msg[h]}\n" for h in ("From", "To", "Cc", "Subject", "Date") if msg.get(h))
        assert got.content == "## Email Headers\n\n" + head + "\n## Email Body\n\n" + reference_body(msg), i
        assert got.subject == msg.get("Subject", "")


def sheet_of(cells, styles="", calendar="", workbook=None):
    """A workbook of one sheet whose rows are given as XML."""
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {x} {r}>{calendar}<sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {x}><sheetData>{cells}</sheetData></worksheet>",
    }
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {x}>{styles}</styleSheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_format_kinds(spark):
    codes = {
        "General": None, "0.00": None, "@": None, "#,##0": None, "yyyy-mm-dd": "date", "D.M.YY": "date", "h:mm AM/PM": "date",
        '0.00" days"': None, '0" "\\d': None, "[Red]0.00": None, "[$-409]d/m/yy;@": "date", "[h]:mm:ss": "duration", "[mm]:ss": "duration",
        "0;dd": None, "0_d": None, '"a;b"yyyy': "date", "": None, "[>=100]0": None,
    }
    df = spark.createDataFrame([(c,) for c in [*codes, None]], "code string")
    got = {r.code: r.kind for r in df.select("code", xlsx.format_kind(F.col("code")).alias("kind")).collect()}
    assert got == codes | {None: None}


def test_serials(spark):
    start = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
    values = ["0", "0.5", "0.999999", "1", "59", "60", "61", "1.75", "45306.4375", "45306.99999999", "2958465", "2958466", "-1", "x", "", "NaN", "1e3", None]
    df = spark.createDataFrame([(v, b) for v in values for b in (False, True)], "v string, b boolean")
    for r in df.select("v", "b", xlsx.serial_text(F.col("v"), F.lit("date"), F.col("b")).alias("got")).collect():
        try:
            seconds = round(float(r.v) * 86400)
            day = seconds // 86400
            early = 1 if not r.b and day < 60 else 0
            want = start[r.b] + timedelta(days=day + early, seconds=seconds % 86400)
            want = None if seconds < 0 else str(want.time()) if seconds < 86400 else str(want)
        except (ValueError, TypeError, OverflowError):
            want = None
        assert r.got == want, (r.v, r.b)


def test_dates_sparse_rows_and_the_bound(spark):
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="46"/></cellXfs>'
    rows = (
        '<row><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="C1" t="d"><v>2024-01-15T10:00:00Z</v></c></row>'
        '<row><c r="C2" s="2"><v>1.5</v></c><c r="A2" s="1"><v>45306</v></c><c r="A2"><v>twice</v></c></row>'
        '<row><c s="9"><v>45306</v></c><c s="x"><v>7</v></c><c t="s"><v>99</v></c><c r="E3" s="1"><v>no</v></c></row><row/>'
    )
    wide = '<row><c r="A1"><v>1</v></c></row>' * 400 + '<row><c r="XFD2"><v>2</v></c></row>'
    out = run(spark, [
        ("a.xlsx", sheet_of(rows, styles)), ("b.xlsx", sheet_of(rows, styles, '<workbookPr date1904="1"/>')),
        ("none.xlsx", sheet_of(rows)), ("cut.xlsx", sheet_of(rows, "<cellXfs><xf")), ("wide.xlsx", sheet_of(wide)),
    ])
    table = "## Sheet: S\n\n| a |  | 2024-01-15 10:00:00 |  |  |\n|---|---|---|---|---|\n| {} |  | {} |  |  |\n| 45306 | 7 |  |  | no |\n|  |  |  |  |  |"
    assert out["a.xlsx"].content == table.format("2024-01-15 00:00:00", "36:00:00")
    assert out["b.xlsx"].content == table.format("2028-01-16 00:00:00", "36:00:00")
    assert out["none.xlsx"].content == table.format("45306", "1.5")
    assert out["cut.xlsx"].error_code == "XLSX_READ" and "styles.xml" in out["cut.xlsx"].error
    assert out["wide.xlsx"].error_code == "XLSX_READ" and "more than 5000000 cells" in out["wide.xlsx"].error


def test_cells_between_are_not_made(spark):
    rows = '<row><c r="A1"><v>1</v></c><c r="XFD1"><v>a|b</v></c></row><row/><row><c r="C3"><v>7</v></c><c r="C3"><v>8</v></c></row>'
    bars = " | " * 16383
    files = files_df(spark, [("a.xlsx", sheet_of(rows)), ("one.xlsx", sheet_of("<row/><row/>")), ("head.xlsx", sheet_of("<row><c><v>1</v></c></row>"))])
    done = xlsx.extract_xlsx(files)
    out = {r.doc_id: r.content for r in done.collect()}
    assert out["a.xlsx"] == (
        f"## Sheet: S\n\n| 1{bars}a\\|b |\n|" + "---|" * 16384 + f"\n| {bars} |\n|  |  | 7" + " | " * 16381 + " |"
    )
    assert out["one.xlsx"] == "## Sheet: S\n\n|  |\n|\n|  |" and out["head.xlsx"] == ""
    assert "array_repeat" not in done._jdf.queryExecution().optimizedPlan().toString()
