"""Marks, pieces, offsets and overlaps against brute force."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.functions import marks as M
from inkveil.functions import patterns as P
from inkveil.functions.arrays import let
from inkveil.model import DEFAULT_ACTIONS, PII_TYPES
from inkveil.operators import checks as C
from inkveil.operators import detect as D
from inkveil.operators.actions import sanitize_documents

ODD = "".join(chr(c) for c in (1, 2, 3)) + "eoc@.a1 \n|é😀"


def collect_pieces(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    items = M.pieces(M.marked(F.col("text"), PII_TYPES))
    out = df.select("doc_id", items.alias("p")).select("doc_id", "p", M.piece_spans(F.col("p")).alias("s"))
    return [(r.p, r.s) for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def test_pieces_put_together_are_the_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["a\x01em b@c.de\x02 \x03o 555-1234", "John Smith\x02 and \x01kpJane Doe"]
    for text, (pieces, spans) in zip(texts, collect_pieces(spark, texts)):
        assert "".join(p.value for p in pieces) == text
        for s in spans:
            assert text[s.start:s.end] == s.value


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=30), min_size=1, max_size=20))
def test_protect_and_restore(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    back = df.select("i", M.restore(M.protect(F.col("t"))).alias("b"), M.protect(F.col("t")).alias("p")).collect()
    for r in back:
        assert r.b == texts[r.i]
        assert "\x01" not in r.p and "\x02" not in r.p


def test_spans_equal_python_regex(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for rule, detect in ((P.EMAIL, D.detect_email), (P.PHONE, D.detect_phone)):
        got = sorted((r.doc_id, r.start, r.value) for r in detect(docs).collect())
        want = sorted((r.doc_id, m.start(), m.group()) for r in rows for m in re.finditer(rule.target, r.text))
        assert got == want and got


def brute_overlaps(spans):
    companies = [s for s in spans if s[0] == "company"]
    spans = [s for s in spans if s[0] != "person_name" or not any(c[1] < s[2] and s[1] < c[2] for c in companies)]
    kept, end = [], -1
    for s in sorted(spans, key=lambda s: (s[1], -(s[2] - s[1]), s[3])):
        if s[1] >= end:
            kept.append(s)
            end = s[2]
    return kept


def test_resolve_overlaps(spark):
    rng = random.Random(3)
    cases = []
    for n in (0, 1, 5, 40, 700):
        for _ in range(6):
            spans = []
            for _ in range(n):
                a = rng.randrange(n * 4)
                spans.append((rng.choice(["company", "person_name", "email"]), a, a + rng.randrange(1, 9), rng.randrange(99999)))
            cases.append(spans)
    schema = "id int, spans array<struct<pii_type:string,rule:string,start:int,end:int,value:string,prio:int>>"
    df = spark.createDataFrame([(i, [(t, "r", a, b, "v", p) for t, a, b, p in c]) for i, c in enumerate(cases)], schema)
    for r in df.select("id", D.resolve_overlaps(F.col("spans")).alias("kept")).collect():
        assert [(s.pii_type, s.start, s.end, s.prio) for s in r.kept] == brute_overlaps(cases[r.id])


def test_long_document_stays_linear(spark):
    """One text of about 3 MB with 30,000 persons and e-mails: no step may be quadratic."""
    firsts, lasts = ["John", "Sarah", "Emma"], "abcdefghij"
    lines = [
        f"{firsts[i % 3]} X{lasts[i % 10]}{lasts[i // 10 % 10]}{lasts[i // 100 % 10]}{lasts[i // 1000 % 10]}k, p{i}@mail.example.com, in stock"
        for i in range(30_000)
    ]
    lines = [line.replace(" X", " Q") for line in lines]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
    begin = time.time()
    out = sanitize_documents(df, DEFAULT_ACTIONS).select("content").first()[0].split("\n")
    assert time.time() - begin < 120
    seen, numbers = {}, {}
    for line, done in zip(lines, out):
        name = line.split(",")[0]
        first = name.split()[0]
        if name not in seen:
            numbers[first] = numbers.get(first, 0) + 1
            seen[name] = f"{first} {numbers[first]}"
        assert done == f"{seen[name]}, [EMAIL_REDACTED]@mail.example.com, in stock"


def test_gazetteers_of_any_size_agree(spark, monkeypatch):
    """Lower case, digits, dots, many words, other scripts; a list in the expression and one that is joined."""
    firms = ["3M", "Acmeco Works", "Bank of America", "One Two Three Four Five", "St. Jude Works", "Yahoo!", "eBay", "金山 办公", "x"]
    texts = [(i, f"we like {n} and {n}s, 9{n} and ({n}) too") for i, n in enumerate(firms)] + [(99, "nothing here"), (100, None)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    people = spark.createDataFrame(
        [(i, f"Xyz{chr(97 + i % 26)} Miller of Foo{i} wrote; Nope Miller too; 李 Tarkov") for i in range(30)], "doc_id int, text string"
    )
    firsts = [(f"Xyz{chr(97 + i)}",) for i in range(26)] + [("李",)]
    got = []
    for extra, inline in (([], 1 << 20), ([(f"Zzz{i}x",) for i in range(5000)], 1 << 20), ([], 0)):
        monkeypatch.setattr(D, "INLINE_BYTES", inline)
        found = D.detect_company(df, spark.createDataFrame([(n,) for n in firms] + extra, "name string")).collect()
        named = D.detect_person(people, spark.createDataFrame(firsts + extra, "name string")).collect()
        got.append(
            (sorted((r.doc_id, r.start, r.value) for r in found), sorted((r.doc_id, r.value) for r in named))
        )
    assert got[0] == got[1] == got[2]
    companies, persons = got[0]
    for i, n in enumerate(firms):
        assert [v for d, _, v in companies if d == i] == [n, n]
    assert [v for d, v in persons if d == 3] == ["Xyzd Miller", "李 Tarkov"]


def test_many_first_names_stay_linear(spark):
    """Distinct first names in one text: four times as many may cost little more than four times the time."""
    def took(n):
        lines = [f"Mr. Q{i:06d}".replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") + " Smith, in stock" for i in range(n)]
        lines += [line.split()[1] + " called" for line in lines[:100]]
        df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
        begin = time.time()
        out = sanitize_documents(df, {"person_name": "delete"}).select("content").first()[0].split("\n")
        assert out[-1] == "[NAME_REMOVED] called"
        return time.time() - begin

    took(100)
    took(200_000 // 8)
    assert took(200_000) < 100


def test_many_overlaps_stay_linear(spark):
    n = 50_000
    spans = [("company" if k % 2 else "person_name", "r", 10 * k, 10 * k + 5 + k % 7, "v", k) for k in range(n)]
    schema = "spans array<struct<pii_type:string,rule:string,start:int,end:int,value:string,prio:int>>"
    df = spark.createDataFrame([(spans,)], schema)
    begin = time.time()
    kept = df.select(D.resolve_overlaps(F.col("spans")).alias("k")).first().k
    assert time.time() - begin < 60
    assert [(s.pii_type, s.start, s.end, s.prio) for s in kept] == brute_overlaps([(t, a, b, p) for t, _, a, b, _, p in spans])


def test_columns_of_all_types(spark, sanitize_texts):
    head = "| Name | D.O.B. | SSN | Account number | Phone no | E-mail | Home address | Employer | Item |\n" + "|---" * 9 + "|\n"
    row = "| Zed Quux | 1980-05-01 | 123456789 | 12345678 | 5 55 12 34 | me@x.org | 7 Elm | Quuxco | 12345678 |"
    actions = dict.fromkeys(PII_TYPES, "delete") | {"company": "invent"}
    out = sanitize_texts([head + row], actions)[0].split("\n")[2].split(" | ")
    assert out[:7] == [
        "| [NAME_REMOVED]", "[DOB_REMOVED]", "[ID_REMOVED]", "[FINANCIAL_REMOVED]", "[PHONE_REMOVED]", "[EMAIL_REMOVED]", "[ADDRESS_REMOVED]"
    ]
    assert out[7] != "Quuxco"
    assert out[8] == "12345678 |"
    only = sanitize_texts([head + row], {"date_of_birth": "delete"})[0]
    assert only == head + row.replace("1980-05-01", "[DOB_REMOVED]")


def test_column_names_as_headers(spark):
    from inkveil.operators.actions import sanitize_columns

    df = spark.createDataFrame(
        [(1, "123456789", "1980-05-01", "Zed Quux", "call 555-123-4567", "n/a"), (2, None, "", "Ann", "x", "77")],
        "id int, ssn string, DateOfBirth string, customer_name string, note string, home_phone string",
    )
    actions = {"id_numbers": "delete", "date_of_birth": "delete", "person_name": "delete", "phone": "delete"}
    got = [tuple(r)[1:] for r in sanitize_columns(df, df.columns[1:], actions).orderBy("id").collect()]
    assert got == [
        ("[ID_REMOVED]", "[DOB_REMOVED]", "[NAME_REMOVED]", "call [PHONE_REMOVED]", "n/a"),
        (None, "", "[NAME_REMOVED]", "x", "[PHONE_REMOVED]"),
    ]


def test_table_columns_with_names(spark, sanitize_texts):
    text = (
        "## Sheet: a\n\n| No | Full Name | Email |\n|---|---|---|\n| 1 | Zoltan Kis | z@x.org |\n| 2 | a\\|b |  |\n| 3 |  | q@x.org |"
        "\n\n## Sheet: b\n\n| Contact | Product name |\n|---|---|\n| Ildi | Lamp |"
    )
    assert sanitize_texts([text], {"person_name": "delete"}) == [
        "## Sheet: a\n\n| No | Full Name | Email |\n|---|---|---|\n| 1 | [NAME_REMOVED] | z@x.org |\n| 2 | [NAME_REMOVED] |  |\n| 3 |  | q@x.org |"
        "\n\n## Sheet: b\n\n| Contact | Product name |\n|---|---|\n| [NAME_REMOVED] | Lamp |"
    ]


def test_tables_with_several_name_columns_and_many_cells(spark, sanitize_texts):
    wide = "| " + " | ".join(f"c{i}" for i in range(3000)) + " | Contact |\n|" + "---|" * 3001 + "\n"
    row = "| " + "\\| | " * 3000 + "Ildi |"
    two = "| First name | Last name | City |\n|---|---|---|\n| Ildi | Kis | Györ |"
    out = sanitize_texts([wide + row, two], {"person_name": "delete"})
    assert out[0] == wide + row.replace("Ildi", "[NAME_REMOVED]")
    assert out[1] == "| First name | Last name | City |\n|---|---|---|\n| [NAME_REMOVED] | [NAME_REMOVED] | Györ |"


def test_values_are_counted_as_written_and_near_linear(spark):
    rows = [
        ("aaaa ab.b abab", "aa a.b", ["aa", "a", "a.b", "abab", "zz", "\\E"]), ("", "x", ["x"]), ("é中é中é", "中", ["é中é", "中"]), ("abc", "", []), (None, None, ["a"]),
        ("John Smith, John Smithson", "", ["John Smith", "Smithson", "John Smithson"]), ("a", "b", None),
    ]
    df = spark.createDataFrame(rows, "after string, plain string, vals array<string>")
    got = df.select(C.times_left(F.col("after"), F.col("plain"), F.col("vals")).alias("n")).collect()
    assert [r.n for r in got] == [[(a or "").count(v) - (p or "").count(v) for v in vs] if vs else None for a, p, vs in rows]

    def seconds(n):
        values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("person number "), i.cast("string"), F.lit("!")))
        one = spark.range(1).select(values.alias("v")).select("v", F.array_join("v", " and then some more words about ").alias("t"))
        begin = time.time()
        assert one.select(F.aggregate(C.times_left(F.col("t"), F.lit(""), F.col("v")), F.lit(0).cast("long"), lambda a, x: a + x)).first()[0] == n
        return time.time() - begin

    seconds(1000)
    assert seconds(100_000) < 20


def test_checks_with_actions_by_row(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.co", "mail a@b.co", "delete"), (2, "mail a@b.co", "mail a@b.co", "keep_part"), (3, "mail a@b.co", "mail a@b.co", None),
         (4, "a@b.co a@b.co", "a@b.co", "delete"), (None, "a@b.co", "a@b.co", "delete"), (6, None, None, "delete")],
        "doc_id int, text string, content string, act string",
    )
    leaks = C.check_leaks(df, {"email": F.col("act"), "phone": "keep_part"}).collect()
    assert sorted((r.doc_id or 0, r.value) for r in leaks) == [(0, "a@b.co"), (1, "a@b.co"), (4, "a@b.co")]
    left = C.check_values(df, {"email": F.col("act")}).collect()
    assert sorted((r.doc_id or 0, r.pii_type, r.value, r.left) for r in left) == [
        (0, "email", "a@b.co", 1), (1, "email", "a@b.co", 1), (2, "email", "a@b.co", 1), (4, "email", "a@b.co", 1)
    ]


def test_let_hands_values_on(spark):
    """``transform`` would copy the result at each level; the value is still computed once."""
    out = let(F.rand(), lambda r: F.struct(r.alias("a"), r.alias("b")))
    assert "transform" not in str(out)


def test_let_computes_once(spark):
    rows = spark.range(50).select(let(F.rand(), lambda r: let(r, lambda q: F.struct(r.alias("a"), q.alias("b")))).alias("x")).collect()
    assert all(r.x.a == r.x.b for r in rows) and len({r.x.a for r in rows}) > 1
    assert spark.range(1).select(let(F.lit(None).cast("string"), lambda v: v.isNull()).alias("x")).first().x


def test_words_of_a_list_by_first_letter():
    """As the plain alternation, also where one word begins another."""
    names = ["Al", "Alice", "Bob", "A", "Goldman Sachs", "Bo"]
    text = "Alice Bob Al Bo A Goldman Sachs Goldman Alicea"
    plain = "(?:" + "|".join(names) + ")"
    for tail in ("", " ", r"\b"):
        assert re.findall(P.any_of(names) + tail, text) == re.findall(plain + tail, text)
    assert P.any_of(names).count("A") == 1


def test_town_gate_lets_all_codes_pass(spark):
    texts = ["in Perth WA 6000 now", "Seattle, WA 98101", "Leeds LS1 4AP", "Toronto, ON M5V 2T6", "Reno NV 89501-1234", "Nowhere 12"]
    marked = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.mark(F.col("t"), P.CITY_ZIP).alias("t")).collect()]
    assert [P.OPEN in t for t in marked] == [True, True, True, True, True, False]
