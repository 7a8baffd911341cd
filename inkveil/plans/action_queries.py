"""Queries: entities, the 18 legal pairs, whole documents, plain columns, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkveil.functions.marks import piece_spans
from inkveil.model import DEFAULT_ACTIONS, REMOVED, VALID_ACTIONS
from inkveil.operators import actions as A
from inkveil.operators import checks as C
from inkveil.operators import detect as D
from inkveil.operators import entities as E
from inkveil.plans import inputs as I
from inkveil.plans.detect_queries import RE2_CARD, RE2_EMAIL, RE2_PHONE
from inkveil.plans.registry import query, rows, table
from inkveil.scratch import written

SALT = "pepper"


def letters(spark, sf_dir):
    return rows(spark, sf_dir, I.LETTERS)


# -- expected replacements, as SQL -------------------------------------------

def fake_digits_sql(value: str, keep: str = "0") -> str:
    """Every digit after ``keep`` characters moved on by a salted md5 of the value."""
    h = f"(strpos('0123456789abcdef', substr(md5('{SALT}' || v), i % 32 + 1, 1)) - 1)"
    lead = "(k + length(regexp_extract(substr(v, k + 1), '^[^0-9]*')))"
    digit = "CAST(substr(v, i + 1, 1) AS INTEGER)"
    return (
        "(SELECT string_agg(CASE WHEN i < k OR NOT regexp_matches(substr(v, i + 1, 1), '[0-9]') THEN substr(v, i + 1, 1) "
        f"WHEN i = {lead} AND {digit} > 0 THEN CAST(1 + ({digit} + {h} % 8) % 9 AS VARCHAR) "
        f"ELSE CAST(({digit} + 1 + {h} % 9) % 10 AS VARCHAR) END, '' ORDER BY i) "
        f"FROM (SELECT {value} AS v, {keep} AS k) x, unnest(range(0, length(v))) AS r(i))"
    )


def kept_person(part: I.Part) -> str:
    return {"one": f"{I.F} || ' 1'", "two": f"{I.F} || ' 2'", "bare": f"{I.F} || ' 1'"}[part.entity]


def expected(part: I.Part, actions: dict) -> str:
    """SQL for what a part of the letter becomes."""
    t = part.pii_type
    action = actions.get(t)
    if action is None or (t, action) == ("company", "keep_part"):
        return part.sql
    if action == "delete":
        return f"'{REMOVED[t]}'"
    if (t, action) == ("person_name", "keep_part"):
        return kept_person(part)
    if (t, action) == ("email", "keep_part"):
        return f"'[EMAIL_REDACTED]@' || {I.MAIL_HOST}"
    if (t, action) == ("phone", "keep_part"):
        return I.PHONE_KEPT
    if (t, action) == ("phone", "invent"):
        return fake_digits_sql(part.sql, I.PHONE_PREFIX)
    if t in ("financial", "id_numbers") and action == "invent":
        return fake_digits_sql(part.sql)
    if (t, action) == ("date_of_birth", "invent"):
        h = f"CAST('0x' || substr(md5('{SALT}' || {part.sql}), 1, 7) AS BIGINT)"
        return (
            f"strftime(CAST({part.sql} AS DATE) + CAST(({h} % 730 + 1) * "
            f"(CASE WHEN {h} % 2 = 0 THEN 1 ELSE -1 END) AS INTEGER), '%Y-%m-%d')"
        )
    raise KeyError((t, action))


def letters_after(actions: dict) -> str:
    return f"SELECT c_custkey AS doc_id, {I.letter_text(lambda p: expected(p, actions))} AS content FROM customer"


def _pair(pii_type: str, action: str, name: str, oracle: bool = True, extra: dict | None = None):
    """One legal pair on the letters; other types stay."""
    actions = {pii_type: action, **(extra or {})}

    def run(spark, sf_dir):
        done = A.sanitize_documents(letters(spark, sf_dir), actions, SALT)
        return done.select("doc_id", "content")

    query(letters_after(actions) if oracle else None, name)(run)


_pair("person_name", "delete", "delete_person")
_pair("person_name", "keep_part", "keep_first_name")
_pair("email", "delete", "delete_email")
_pair("email", "keep_part", "keep_email_domain")
_pair("phone", "delete", "delete_phone")
_pair("phone", "invent", "invent_phone")
_pair("phone", "keep_part", "keep_phone_area")
_pair("company", "keep_part", "keep_company")
_pair("address", "delete", "delete_address")
_pair("id_numbers", "delete", "delete_ids")
_pair("id_numbers", "invent", "invent_ids")
_pair("date_of_birth", "delete", "delete_dob")
_pair("date_of_birth", "invent", "invent_dob")
# Amounts are tied to persons, so the person rules run along.
_pair("financial", "delete", "delete_financial", extra={"person_name": "delete"})
_pair("financial", "invent", "invent_financial", extra={"person_name": "delete"})


# Invented names are picked by hash; what can be said about them in SQL is how
# many there are, that persons keep apart, and that none is an original.
@query(
    "SELECT c_custkey AS doc_id, CAST(2 AS BIGINT) AS invented, CAST(0 AS BIGINT) AS originals_left, "
    "CAST(5 AS BIGINT) AS mentions FROM customer"
)
def invent_person(spark, sf_dir):
    done = A.sanitize_documents(letters(spark, sf_dir), {"person_name": "invent"}, SALT)
    spans = A.replaced_spans(done, ["doc_id"]).where(F.col("pii_type") == "person_name")
    return spans.groupBy("doc_id").agg(
        F.countDistinct("replacement").alias("invented"),
        F.count_if(F.contains("replacement", "value")).alias("originals_left"),
        F.count("*").alias("mentions"),
    )


@query("SELECT c_custkey AS doc_id, CAST(1 AS BIGINT) AS invented, CAST(0 AS BIGINT) AS originals_left FROM customer")
def invent_company(spark, sf_dir):
    done = A.sanitize_documents(letters(spark, sf_dir), {"company": "invent"}, SALT)
    spans = A.replaced_spans(done, ["doc_id"]).where(F.col("pii_type") == "company")
    return spans.groupBy("doc_id").agg(
        F.countDistinct("replacement").alias("invented"),
        F.count_if(F.col("replacement") == F.col("value")).alias("originals_left"),
    )


# An invented address has the shape of the original, digits for digits.
@query(
    "SELECT c_custkey AS doc_id, true AS changed, "
    "CASE c_custkey % 2 WHEN 0 THEN '999 X St, X, XX 99999' ELSE 'PO Box ' || "
    "regexp_replace(CAST(c_custkey AS STRING), '[0-9]', '9', 'g') || ', X XX' END AS shape FROM customer"
)
def invent_address(spark, sf_dir):
    done = A.sanitize_documents(letters(spark, sf_dir), {"address": "invent"}, SALT)
    spans = A.replaced_spans(done, ["doc_id"]).where(F.col("pii_type") == "address")
    new = F.regexp_replace("replacement", "[0-9]", "9")
    shape = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(new, "9 [A-Z][a-z]+ St", "9 X St"), ", [A-Z][a-z]+", ", X"),
        "(, X,?) [A-Z]{2}", "$1 XX",
    )
    return spans.select(
        "doc_id", (F.col("replacement") != F.col("value")).alias("changed"), shape.alias("shape")
    )


# -- documents ---------------------------------------------------------------

def doc_pairs(email: str, card: str, phone: str) -> str:
    out = f"regexp_replace(text, '([A-Za-z0-9._%+-]+)(@(?:[A-Za-z0-9-]+\\.){{1,126}}[A-Za-z]{{2,}})', '{email}', 'g')"
    out = f"regexp_replace({out}, '{RE2_CARD}', '{card}', 'g')"
    return f"regexp_replace({out}, '{RE2_PHONE}', '{phone}', 'g')"


DEFAULT_DOCS = doc_pairs("[EMAIL_REDACTED]\\2", "[FINANCIAL_REMOVED]", "[PHONE_REMOVED]")


@query(f"SELECT doc_id, {DEFAULT_DOCS} AS content FROM documents")
def sanitize_documents(spark, sf_dir):
    """Flagship: the default profile over all documents."""
    return A.sanitize_documents(table(spark, sf_dir, "documents"), DEFAULT_ACTIONS).select("doc_id", "content")


@query(f"SELECT page_id, {DEFAULT_DOCS.replace('text', 'html', 1)} AS content FROM pages")
def sanitize_pages(spark, sf_dir):
    done = A.sanitize_documents(table(spark, sf_dir, "pages"), DEFAULT_ACTIONS, id_col="page_id", text_col="html")
    return done.select("page_id", "content")


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, "
    f"'{RE2_EMAIL}', '[EMAIL_REMOVED]', 'g'), '{RE2_CARD}', '[FINANCIAL_REMOVED]', 'g'), '{RE2_PHONE}', "
    "'[PHONE_REMOVED]', 'g') AS content FROM documents"
)
def apply_actions(spark, sf_dir):
    actions = {"email": "delete", "phone": "delete", "financial": "delete"}
    found = D.detect_all(table(spark, sf_dir, "documents"), actions)
    return A.apply_actions(found, actions).select("doc_id", "content")


@query(
    "SELECT pii_type, count(*) AS replaced FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS pii_type, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents"
        for t, p in (("email", RE2_EMAIL), ("phone", RE2_PHONE), ("financial", RE2_CARD))
    )
    + ") GROUP BY pii_type"
)
def removals_by_type(spark, sf_dir):
    done = A.sanitize_documents(table(spark, sf_dir, "documents"), DEFAULT_ACTIONS)
    return A.removal_counts(done)


@query(
    "SELECT c_custkey, 'Customer#[ID_REMOVED]' AS c_name, c_nationkey, c_acctbal, c_mktsegment, "
    + I.letter_text(lambda p: expected(p, DEFAULT_ACTIONS)) + " AS note FROM customer"
)
def sanitize_columns(spark, sf_dir):
    wide = rows(spark, sf_dir, f"SELECT *, {I.letter_text()} AS note FROM customer")
    return A.sanitize_columns(wide, ["c_name", "note"], DEFAULT_ACTIONS, id_col="c_custkey")


# -- entities ----------------------------------------------------------------

def letter_span_rows(spark, sf_dir):
    found = D.detect_all(letters(spark, sf_dir), {**DEFAULT_ACTIONS, "company": "invent"})
    return D.span_rows(found, piece_spans(F.col("pieces")))


_SPANS = I.letter_spans(lambda p: True)
_KEY = (
    "CASE WHEN pii_type <> 'person_name' OR strpos(value, ' ') = 0 THEN lower(value) "
    "ELSE lower(split_part(value, ' ', 1) || ' ' || split_part(value, ' ', -1)) END"
)


@query(f"SELECT doc_id, start, {_KEY} AS entity_key FROM ({_SPANS})")
def entity_key(spark, sf_dir):
    spans = letter_span_rows(spark, sf_dir)
    return spans.select("doc_id", "start", E.entity_key(F.col("pii_type"), F.col("value")).alias("entity_key"))


# What each span of the letters means and becomes, from the parts.
_MENTIONS = I.letter_spans(
    lambda p: True, lambda p: {"entity_key": I.letter_entity(p), "replacement": expected(p, DEFAULT_ACTIONS)}
)


@query(
    "SELECT doc_id, pii_type, entity_key, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY min(start)) AS ord, "
    f"min(start) AS first_start, count(*) AS mentions, arg_min(replacement, start) AS replacement FROM ({_MENTIONS}) "
    "GROUP BY doc_id, pii_type, entity_key"
)
def entity_map(spark, sf_dir):
    return E.entity_map(letter_span_rows(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


# The map's replacements against those in the sanitized letters, mention by mention, for every action.
@query(
    "SELECT action, doc_id, pii_type, entity_key, count(*) AS mentions, CAST(0 AS BIGINT) AS other_than_in_text FROM "
    f"({_MENTIONS}), (VALUES ('delete'), ('invent'), ('keep_part')) a(action) GROUP BY action, doc_id, pii_type, entity_key"
)
def entity_map_and_text(spark, sf_dir):
    legal = {(t, a) for t, a, _ in VALID_ACTIONS}
    out = None
    # The three sets of actions have the same types, so the letters are gone over once.
    texts = letters(spark, sf_dir)
    found = written(D.detect_all(texts, {**DEFAULT_ACTIONS, "company": "invent"}), "pieces")
    for action in ("delete", "invent", "keep_part"):
        actions = {t: action if (t, action) in legal else DEFAULT_ACTIONS[t] for t in DEFAULT_ACTIONS}
        done = A.sanitize_documents(texts, {**actions, "company": "invent"}, SALT, found=found)
        spans = D.span_rows(done, piece_spans(F.col("pieces")))
        told = E.mention_rows(spans, {**actions, "company": "invent"}, SALT)
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
        told = told.select("doc_id", nth.alias("nth"), "pii_type", "entity_key", "replacement")
        in_text = F.filter("applied", lambda p: p["pii_type"].isNotNull())
        # An array per letter: the mentions stay where they are, by letter, for the join and the counts.
        shown = done.select("doc_id", F.transform(in_text, lambda p: p["replacement"]).alias("shown"))
        met = told.join(shown, "doc_id").where(F.col("nth") < F.size("shown"))
        one = met.groupBy(F.lit(action).alias("action"), "doc_id", "pii_type", "entity_key").agg(
            F.count("*").alias("mentions"),
            F.count_if(F.get("shown", F.col("nth")) != F.col("replacement")).alias("other_than_in_text"),
        )
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "SELECT pii_type, entity_key, row_number() OVER (PARTITION BY pii_type ORDER BY first) AS ord, first // 100000 AS first_doc, "
    "CAST(first % 100000 AS INTEGER) AS first_start, mentions, CASE WHEN pii_type = 'person_name' THEN "
    "upper(substr(entity_key, 1, 1)) || substr(split_part(entity_key, ' ', 1), 2) || ' ' || "
    "CAST(row_number() OVER (PARTITION BY pii_type, split_part(entity_key, ' ', 1) ORDER BY first) AS VARCHAR) "
    "ELSE replacement END AS replacement FROM ("
    "SELECT pii_type, entity_key, min(doc_id * 100000 + start) AS first, count(*) AS mentions, "
    f"arg_min(replacement, doc_id * 100000 + start) AS replacement FROM ({_MENTIONS}) GROUP BY pii_type, entity_key)"
)
def entity_map_of_corpus(spark, sf_dir):
    return E.entity_map(letter_span_rows(spark, sf_dir), scope="corpus")


# Over the corpus too each person and company gets a name of its own, and none that another one has.
@query(
    "SELECT pii_type, count(*) AS entities, count(*) AS replacements, CAST(0 AS BIGINT) AS originals FROM ("
    f"SELECT DISTINCT pii_type, entity_key FROM ({_MENTIONS}) WHERE pii_type IN ('person_name', 'company')) GROUP BY pii_type"
)
def entity_map_of_corpus_invented(spark, sf_dir):
    actions = {"person_name": "invent", "company": "invent"}
    names = E.entity_map(letter_span_rows(spark, sf_dir), "corpus", actions=actions, salt=SALT).where(
        F.col("pii_type").isin("person_name", "company")
    )
    keys = names.select(F.col("pii_type").alias("kind"), F.col("entity_key").alias("taken"))
    met = names.join(keys, (F.col("pii_type") == F.col("kind")) & (F.lower("replacement") == F.col("taken")), "left")
    return met.groupBy("pii_type").agg(
        F.count("*").alias("entities"), F.countDistinct("replacement").alias("replacements"), F.count("taken").alias("originals")
    )


@query(
    "SELECT doc_id, entity_key, split_part(entity_key, ' ', 1) AS first_name, min(start) AS first_start, count(*) AS mentions, "
    "CAST(dense_rank() OVER (PARTITION BY doc_id, split_part(entity_key, ' ', 1) ORDER BY min(start)) AS INTEGER) AS num "
    f"FROM ({_MENTIONS}) WHERE pii_type = 'person_name' GROUP BY doc_id, entity_key"
)
def number_persons(spark, sf_dir):
    return E.number_entities(letter_span_rows(spark, sf_dir))


# -- checks ------------------------------------------------------------------

def _counts(text: str, tag: str) -> str:
    shapes = {
        "headings": "(?m)^#{1,6} ", "table_rows": "(?m)^\\|", "list_items": "(?m)^ *(?:[-*+]|[0-9]+\\.) ", "lines": "\\n",
    }
    return ", ".join(
        f"CAST(len(regexp_extract_all({text}, '{p}')) AS INTEGER) AS {k}_{tag}" for k, p in shapes.items()
    )


@query(
    f"SELECT doc_id, {_counts('text', 'before')}, {_counts('content', 'after')}, true AS same "
    f"FROM (SELECT doc_id, text, {DEFAULT_DOCS} AS content FROM documents)"
)
def check_structure(spark, sf_dir):
    done = A.sanitize_documents(table(spark, sf_dir, "documents"), DEFAULT_ACTIONS)
    return C.check_structure(done, "text", "content")


@query(
    "SELECT doc_id, pii_type, entity_key, CAST(1 AS BIGINT) AS replacements, count(*) AS mentions "
    f"FROM ({_MENTIONS}) GROUP BY doc_id, pii_type, entity_key"
)
def check_consistency(spark, sf_dir):
    actions = {**DEFAULT_ACTIONS, "person_name": "invent", "company": "invent", "address": "invent"}
    return C.check_consistency(A.sanitize_documents(letters(spark, sf_dir), actions, SALT))


# In every third letter the titled surname was given somebody else's name: that person must be reported.
@query(
    "SELECT doc_id, pii_type, entity_key, CAST(2 AS BIGINT) AS replacements, count(*) AS mentions "
    f"FROM ({_MENTIONS}) WHERE doc_id % 3 = 0 GROUP BY doc_id, pii_type, entity_key HAVING count(*) > 2"
)
def check_consistency_of_split_persons(spark, sf_dir):
    done = A.sanitize_documents(letters(spark, sf_dir), {**DEFAULT_ACTIONS, "company": "invent"}, SALT)
    split = F.transform("applied", lambda p: F.struct(
        p["pii_type"].alias("pii_type"), p["rule"].alias("rule"), p["value"].alias("value"),
        F.when((F.col("doc_id") % 3 == 0) & (p["rule"] == "honorific"), "Somebody 1").otherwise(p["replacement"]).alias("replacement"),
    ))
    return C.check_consistency(done.withColumn("applied", split)).where("replacements > 1")


@query(
    "SELECT doc_id, count(leak) AS leaks FROM ("
    f"SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS leak FROM ("
    f"SELECT doc_id, regexp_extract_all({DEFAULT_DOCS}, '{RE2_CARD}|{RE2_PHONE}') AS l FROM documents)) GROUP BY doc_id"
)
def check_leaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    done = A.sanitize_documents(docs, DEFAULT_ACTIONS)
    leaks = C.check_leaks(done, DEFAULT_ACTIONS).groupBy("doc_id").agg(F.count("*").alias("leaks"))
    return docs.select("doc_id").join(leaks, "doc_id", "left").select(
        "doc_id", F.coalesce("leaks", F.lit(0)).alias("leaks")
    )


# Letters of even customers are left as they are: each planted value must be reported.
@query(
    "SELECT doc_id, pii_type, value FROM (SELECT DISTINCT doc_id, pii_type, value FROM "
    f"({_SPANS})) WHERE doc_id % 2 = 0 AND pii_type <> 'company' AND (pii_type <> 'person_name' OR strpos(value, ' ') > 0)"
)
def check_values(spark, sf_dir):
    """Values that were to be replaced and stand in the output, under the default profile."""
    texts = letters(spark, sf_dir)
    # What the check looks for stands in the pieces that are replaced: the letters are gone over once.
    done = A.sanitize_documents(texts, DEFAULT_ACTIONS, found=D.detect_types(texts, DEFAULT_ACTIONS))
    done = done.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("content")))
    return C.check_values(done, DEFAULT_ACTIONS, pieces_col="pieces").select("doc_id", "pii_type", "value")


@query("SELECT doc_id, true AS output_only, CAST(0 AS INTEGER) AS changed_gaps FROM documents")
def check_output_only(spark, sf_dir):
    return C.check_output_only(A.sanitize_documents(table(spark, sf_dir, "documents"), DEFAULT_ACTIONS))
