"""Entities as tables: mentions resolved, one replacement each, over documents and over the corpus."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkveil.functions.marks import piece_spans
from inkveil.functions.names import INVENTED_FIRST, INVENTED_LAST
from inkveil.model import DEFAULT_ACTIONS
from inkveil.operators.actions import sanitize_documents
from inkveil.operators.checks import check_consistency
from inkveil.operators.detect import span_rows
from inkveil.operators.entities import entity_map, mention_rows, number_entities
from inkveil.operators.numbering import number_within


def spans(spark, texts, actions):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    done = sanitize_documents(df, actions, "salt")
    return done, span_rows(done, piece_spans(F.col("pieces")))


SURNAMES = [
    ("John Smith called. Smith paid.", "John 1 called. John 1 paid."),
    ("Dear Mr Smith, hello", "Dear Mr [NAME_REMOVED], hello"),
    ("Dear Sir or Madam, Dear All, Hello World", "Dear Sir or Madam, Dear All, Hello World"),
    ("Dear Dr. John Henderson. Henderson's file", "Dear Dr. John 1. John 1's file"),
    ("Mr. Baker came. Baker left.", "Mr. [NAME_REMOVED] came. [NAME_REMOVED] left."),
    # a surname that is a common word, where it may be just that
    ("John White left. White walls. The White House. I saw White there.", "John 1 left. White walls. The White House. I saw John 1 there."),
    ("Emma Frost came; frost too. Frost is cold, says Frost", "Emma 1 came; frost too. Frost is cold, says Emma 1"),
    ("Contact: JOHN STANTON\nStanton agreed.", "Contact: JOHN 1\nJOHN 1 agreed."),
    # the first of two with one surname; a first name that is also a surname
    ("Sarah Johnson and John Johnson. Johnson said.", "Sarah 1 and John 1. Sarah 1 said."),
    ("James Henderson met Emma James. James left.", "James 1 met Emma 1. James 1 left."),
    ("Peter Van Dyke and Olivia O'Brien. Dyke, O'Brien, O'Brien's", "Peter 1 and Olivia 1. Peter 1, Olivia 1, Olivia 1's"),
    ("Emma Henderson-Clark. Henderson-Smith and Hendersons", "Emma 1. Henderson-Smith and Hendersons"),
]


def test_surnames_and_titles(sanitize_texts):
    assert sanitize_texts([t for t, _ in SURNAMES], {"person_name": "keep_part"}) == [r for _, r in SURNAMES]
    assert sanitize_texts(["John Smith called. Smith paid."], {"person_name": "delete"}) == ["[NAME_REMOVED] called. [NAME_REMOVED] paid."]
    out = sanitize_texts(["John Smith called. Smith paid, John too."], {"person_name": "invent"})[0]
    assert re.fullmatch(r"(\w+ \w+) called\. \1 paid, \1 too\.", out)


def test_many_surnames_stay_linear(spark):
    """200,000 surnames in one text, some of them again alone."""
    def word(i):
        return "K" + "".join(chr(97 + int(c)) for c in f"{i:06d}")

    def took(n):
        lines = [f"John {word(i)} was here at that very place" for i in range(n)] + [f"then {word(i)} left" for i in range(0, n, 1000)]
        df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
        begin = time.time()
        out = sanitize_documents(df, {"person_name": "delete"}).select("content").first()[0].split("\n")
        assert set(out[n:]) == {"then [NAME_REMOVED] left"}
        return time.time() - begin

    took(100)
    small = took(50_000)
    assert took(200_000) < max(10 * small, 100)


def test_map_is_what_the_text_shows(spark):
    text = "John Smith met Sarah Jones of Acme Corp. Smith wrote to 12 Main St, New York, NY 10001. Mr. Smith and Sarah agreed. John Jones left."
    for actions in (DEFAULT_ACTIONS, {**DEFAULT_ACTIONS, "person_name": "invent", "company": "invent", "address": "invent"}):
        done, found = spans(spark, [text], actions)
        told = mention_rows(found, actions, "salt").orderBy("start").collect()
        shown = [p.replacement for p in done.first().applied if p.pii_type]
        assert [m.replacement for m in told] == shown
        rows = {r.entity_key: r for r in entity_map(found, actions=actions, salt="salt").collect()}
        assert {k: r.mentions for k, r in rows.items() if r.pii_type == "person_name"} == {"john smith": 3, "sarah jones": 2, "john jones": 1}
        assert [rows[k].ord for k in ("john smith", "sarah jones", "john jones")] == [1, 2, 3]
    numbers = {r.entity_key: (r.num, r.mentions) for r in number_entities(found).collect()}
    assert numbers == {"john smith": (1, 3), "sarah jones": (1, 2), "john jones": (2, 1)}


def test_split_person_is_found(spark):
    done, _ = spans(spark, ["John Smith called. Smith paid. Sarah Lee."], DEFAULT_ACTIONS)
    split = F.transform("applied", lambda p: F.struct(
        p["pii_type"].alias("pii_type"), p["rule"].alias("rule"), p["value"].alias("value"),
        F.when(p["value"] == "Smith", "Other 9").otherwise(p["replacement"]).alias("replacement")))
    got = {r.entity_key: r.replacements for r in check_consistency(done.withColumn("applied", split)).collect()}
    assert got == {"john smith": 2, "sarah lee": 1}
    assert {r.replacements for r in check_consistency(done).collect()} == {1}


def test_corpus_names_are_injective(spark):
    """More persons than the pool has pairs, some of them pairs of the pool themselves, one in every document."""
    rng = random.Random(3)
    people = [f"{rng.choice(['John', 'Sarah', 'Emma'])} Q{''.join(rng.choices('abcdefgh', k=5))}" for _ in range(900)]
    people += [f"{INVENTED_FIRST[i % 20]} {INVENTED_LAST[i // 20]}" for i in range(50)]
    rows = [(d, 100 * k, "person_name", "first_name_list", p) for d in range(60) for k, p in enumerate(["John Henderson", *rng.sample(people, 40)])]
    rows += [(d, 9000, "person_name", "short_surname", "Henderson") for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, start int, pii_type string, rule string, value string")
    keys = {r[4].lower() for r in rows if " " in r[4]}
    for actions in ({"person_name": "invent"}, {"person_name": "keep_part"}):
        found = entity_map(df, "corpus", actions=actions, salt="s").collect()
        assert {r.entity_key for r in found} == keys
        assert len({r.replacement for r in found}) == len(keys)
        assert sorted(r.ord for r in found) == list(range(1, len(keys) + 1))
        assert not {r.replacement.lower() for r in found} & keys
        first = next(r for r in found if r.entity_key == "john henderson")
        assert (first.ord, first.mentions, first.first_doc, first.first_start) == (1, 120, 0, 0)
        assert sorted(map(tuple, entity_map(df.repartition(7), "corpus", actions=actions, salt="s").collect())) == sorted(map(tuple, found))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_number_within(spark, n):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7919 % 100_003) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(9)
    got = {(r.g, r.k): r.num for r in number_within(df, ["g"], ["k"], "num").collect()}
    groups = {}
    for g, k in sorted(rows):
        groups.setdefault(g, []).append(k)
    assert got == {(g, k): i + 1 for g, ks in groups.items() for i, k in enumerate(ks)}


def test_addresses_of_other_countries(sanitize_texts):
    texts = [
        "at Flat 2, 10 High Street, London SW1A 2AA.", "5 King Street, Toronto, ON M5V 2T6", "Unit 7/12 Harbour Road, Sydney NSW 2000 now",
        "in London SW1A 2AA today", "PO Box 12, Perth WA 6000",
    ]
    assert sanitize_texts(texts, {"address": "delete"}) == [
        "at [ADDRESS_REMOVED].", "[ADDRESS_REMOVED]", "[ADDRESS_REMOVED] now", "in [ADDRESS_REMOVED] today", "[ADDRESS_REMOVED]"
    ]
    for text, new in zip(texts, sanitize_texts(texts, {"address": "invent"}), strict=True):
        assert not {"London", "High", "King", "Toronto", "Harbour", "Sydney", "Perth"} & set(re.findall(r"\w+", new)), new
        assert re.sub("[0-9]", "9", new).count("9") == sum(c.isdigit() for c in text)


def test_phones_are_no_long_runs(sanitize_texts):
    texts = ["0054994038693466", "00123456789012345", "+44 (0)20 7946 0958 and 0044-20-7946-0958", "0044 20.7946-0958", "004479460958"]
    assert sanitize_texts(texts, {"phone": "delete"}) == [
        texts[0], texts[1], "[PHONE_REMOVED] and [PHONE_REMOVED]", texts[3], "[PHONE_REMOVED]"
    ]
    assert sanitize_texts(["+44 (0)20 7946 0958"], {"phone": "keep_part"}) == ["+44 (20) [REDACTED]"]


def test_ages_and_dashed_dates(sanitize_texts):
    text = "DOB: 01-May-1980; aged 45, age: 7, 12 years old; aged 45 (1979-01-02); a 30-year-old in 1999 pages"
    assert sanitize_texts([text], {"date_of_birth": "delete"}) == [
        "DOB: [DOB_REMOVED]; aged [DOB_REMOVED], age: [DOB_REMOVED], [DOB_REMOVED] years old; aged 45 ([DOB_REMOVED]); a [DOB_REMOVED]-year-old in 1999 pages"
    ]


def test_amount_behind_a_legal_form(sanitize_texts):
    texts = ["John Smith of Acme Inc. got $5,000.", "John Smith left Acme Inc. Sales were $5,000."]
    for company in ("keep_part", None):
        actions = {"person_name": "delete", "financial": "delete"} | ({"company": company} if company else {})
        assert sanitize_texts(texts, actions) == [
            "[NAME_REMOVED] of Acme Inc. got [FINANCIAL_REMOVED].", "[NAME_REMOVED] left Acme Inc. Sales were $5,000."
        ]


def test_map_and_text_detect_once(spark, sf_dir, monkeypatch):
    """One detection serves the three sets of actions; only the written pieces are read behind it."""
    from inkveil.operators import actions
    from inkveil.plans import action_queries

    def again(*_):
        raise AssertionError("the text is gone over again")

    monkeypatch.setattr(actions, "detect_all", again)
    rows = action_queries.entity_map_and_text(spark, sf_dir).collect()
    assert {r.action for r in rows} == {"delete", "invent", "keep_part"}
    assert sum(r.other_than_in_text for r in rows) == 0
