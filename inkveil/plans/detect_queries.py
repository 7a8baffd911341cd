"""Queries: detection and overlap resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkveil.functions import patterns as P
from inkveil.functions.marks import mark_all, piece_spans, pieces, protect
from inkveil.operators import detect as D
from inkveil.operators.actions import sanitize_documents
from inkveil.model import DEFAULT_ACTIONS
from inkveil.plans.inputs import LETTERS, letter_spans
from inkveil.plans.registry import query, rows, table
from inkveil.plans.sentences import FIRST_NAME, sentences, spans_of

# The same shapes in RE2 notation; \b stands for the ASCII neighbour tests.
RE2_EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,}"
_PHONES = [
    r"\+[0-9]{1,3}[ .-]?\(0\) ?[0-9]{1,4}(?:[ .-]?[0-9]{3,4}){2}",  # +44 (0)20 7946 0958
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:(?:[ .-]?[0-9]{2}){4}|(?:[ .-]?[0-9]{3,4}){2})",  # +1 (555) 123-4567
    r"\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}",  # (555) 123-4567
    r"\b(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",  # 555.123.4567
    r"\b1[ .-]\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}",  # 1 (555) 123-4567
    r"\b00[0-9]{1,3}(?: [0-9]{1,4}(?: [0-9]{3,4}){2}|\.[0-9]{1,4}(?:\.[0-9]{3,4}){2}|-[0-9]{1,4}(?:-[0-9]{3,4}){2})",
    r"\b00[0-9]{8,10}|\b[2-9][0-9]{9}|\b0[1-9][0-9]{8}",  # up to twelve digits in a row after 00, or ten
    r"\b0[1-9](?:[ .-][0-9]{2}){4}",  # 01 23 45 67 89
    r"\b0[0-9]{1,4}[ -][0-9]{3,4}[ -][0-9]{3,4}|\b0[0-9]{3,4}[ -][0-9]{6}|\b[0-9]{3}-[0-9]{4}",
]
RE2_PHONE = f"(?:{'|'.join(_PHONES)})\\b"
RE2_CARD = r"\b(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\b"

BAR = "chr(1)"


def re2_spans(source: str, id_col: str, text_col: str, pattern: str, pii_type: str, rule: str) -> str:
    """Span rows of one pattern: matches set off by a control character, then counted off."""
    return (
        f"SELECT doc_id, '{pii_type}' AS pii_type, '{rule}' AS rule, "
        "CAST(coalesce(list_sum(list_transform(parts[1:i-1], lambda p: length(p))), 0) AS INTEGER) AS start, "
        "parts[i] AS value FROM ("
        f"SELECT {id_col} AS doc_id, string_split(regexp_replace({text_col}, '({pattern})', "
        f"{BAR} || '\\1' || {BAR}, 'g'), {BAR}) AS parts FROM {source}"
        ") t, unnest(range(2, len(parts) + 1, 2)) AS u(i)"
    )


SPAN_COLUMNS = ["doc_id", "pii_type", "rule", "start", "value"]


def _spans_of(detect, pattern: str, pii_type: str, rule: str, name: str):
    @query(re2_spans("documents", "doc_id", "text", pattern, pii_type, rule), name)
    def on_documents(spark, sf_dir):
        return detect(table(spark, sf_dir, "documents")).select(SPAN_COLUMNS)

    @query(re2_spans("pages", "page_id", "html", pattern, pii_type, rule), f"{name}_in_pages")
    def on_pages(spark, sf_dir):
        return detect(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html").select(
            F.col("page_id").alias("doc_id"), *SPAN_COLUMNS[1:]
        )


_spans_of(D.detect_email, RE2_EMAIL, "email", "email", "detect_email")
_spans_of(D.detect_phone, RE2_PHONE, "phone", "phone", "detect_phone")
_spans_of(D.detect_financial_numbers, RE2_CARD, "financial", "card", "detect_financial_numbers")

_DIGITS = "list_reverse(list_transform(string_split(regexp_replace(value, '[^0-9]', '', 'g'), ''), lambda c: CAST(c AS INTEGER)))"


@query(
    f"SELECT * EXCLUDE (d) FROM (SELECT *, {_DIGITS} AS d FROM "
    f"({re2_spans('documents', 'doc_id', 'text', RE2_CARD, 'financial', 'card')})) "
    "WHERE list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 1 THEN x "
    "WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0"
)
def detect_cards_with_check_digit(spark, sf_dir):
    found = D.detect_financial_numbers(table(spark, sf_dir, "documents"), luhn=True)
    return found.select(SPAN_COLUMNS)


def _on_letters(detect, wanted, name: str):
    @query(letter_spans(wanted), name)
    def on_letters(spark, sf_dir):
        return detect(rows(spark, sf_dir, LETTERS)).select(SPAN_COLUMNS)


_on_letters(D.detect_person, lambda p: p.pii_type == "person_name", "detect_person")
_on_letters(D.detect_company, lambda p: p.pii_type == "company", "detect_company")
_on_letters(D.detect_address, lambda p: p.pii_type == "address", "detect_address")
_on_letters(D.detect_ids, lambda p: p.pii_type == "id_numbers", "detect_ids")
_on_letters(D.detect_dob, lambda p: p.pii_type == "date_of_birth", "detect_dob")
_on_letters(D.detect_personal_amounts, lambda p: p.rule == "personal_amount", "detect_personal_amounts")
_on_letters(D.detect_phone, lambda p: p.pii_type == "phone", "detect_phone_formats")
_on_letters(
    D.detect_financial_numbers, lambda p: p.rule in ("card", "account"), "detect_financial_formats"
)


def _on_sentences(detect, name: str, pii_type: str, key: str):
    """Forty shapes of a type, of which each customer has one."""

    @query(spans_of(name, pii_type), key)
    def on_sentences(spark, sf_dir):
        found = detect(rows(spark, sf_dir, sentences(name)))
        return found.select("doc_id", "pii_type", "start", "value")


for _detect, _type in (
    (D.detect_person, "person_name"), (D.detect_email, "email"), (D.detect_phone, "phone"), (D.detect_company, "company"),
    (D.detect_address, "address"), (D.detect_financial_numbers, "financial"), (D.detect_ids, "id_numbers"), (D.detect_dob, "date_of_birth"),
):
    _on_sentences(_detect, _type, _type, f"{_detect.__name__}_in_sentences")
_on_sentences(D.detect_personal_amounts, "personal_amount", "financial", "detect_personal_amounts_in_sentences")


# Whoever is named again by surname, first name or title keeps one replacement.
@query(sentences("person_name", lambda p: f"{FIRST_NAME} || ' 1'", "content"))
def keep_first_name_in_sentences(spark, sf_dir):
    texts = rows(spark, sf_dir, sentences("person_name"))
    return sanitize_documents(texts, {"person_name": "keep_part"}).select("doc_id", "content")


@query(letter_spans(lambda p: True))
def detect_all(spark, sf_dir):
    actions = {**DEFAULT_ACTIONS, "company": "invent"}
    found = D.detect_all(rows(spark, sf_dir, LETTERS), actions)
    return D.span_rows(found, piece_spans(F.col("pieces"))).select(SPAN_COLUMNS)


# The gazetteers come from tables too: brands of parts and market segments as names.
GAZETTEER_TEXTS = (
    "SELECT p_partkey AS doc_id, 'We met ' || replace(p_brand, '#', '') || ' Ltd and Zed' || chr(97 + CAST(p_partkey % 26 AS INT)) "
    "|| ' Miller there.' AS text FROM part"
)


@query(
    "SELECT p_partkey AS doc_id, 'person_name' AS pii_type, 'gazetteer_person' AS rule, "
    "CAST(length('We met ' || replace(p_brand, '#', '') || ' Ltd and ') AS INTEGER) AS start, "
    "'Zed' || chr(97 + CAST(p_partkey % 26 AS INT)) || ' Miller' AS value FROM part"
)
def detect_person_with_gazetteer(spark, sf_dir):
    names = rows(spark, sf_dir, "SELECT DISTINCT 'Zed' || chr(97 + CAST(p_partkey % 26 AS INT)) AS name FROM part")
    return D.detect_person(rows(spark, sf_dir, GAZETTEER_TEXTS), names).select(SPAN_COLUMNS)


# One company name per customer: too many for one pattern, so the list is joined.
COMPANY_TEXTS = (
    "SELECT c_custkey AS doc_id, 'Yesterday we met Firm' || CAST(c_custkey AS STRING) || ' Works near the river, "
    "not Nofirm Works.' AS text FROM customer"
)


@query(
    "SELECT c_custkey AS doc_id, 'company' AS pii_type, 'gazetteer_company' AS rule, CAST(17 AS INTEGER) AS start, "
    "'Firm' || CAST(c_custkey AS STRING) || ' Works' AS value FROM customer"
)
def detect_company_with_long_gazetteer(spark, sf_dir):
    names = rows(spark, sf_dir, "SELECT 'Firm' || CAST(c_custkey AS STRING) || ' Works' AS name FROM customer")
    return D.detect_company(rows(spark, sf_dir, COMPANY_TEXTS), names).select(SPAN_COLUMNS)


# Every name begins with "The", every row has a null id, and the texts come from one table too.
THE_TEXTS = (
    "SELECT CAST(NULL AS BIGINT) AS doc_id, 'The note of the day: The River' || CAST(l_partkey AS STRING) || ' Works paid The Bill.' "
    "AS text FROM lineitem"
)


@query(
    "SELECT 'company' AS pii_type, CAST(21 AS INTEGER) AS start, 'The River' || CAST(l_partkey AS VARCHAR) || ' Works' AS value "
    "FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)"
)
def detect_company_by_rarest_word(spark, sf_dir):
    names = rows(
        spark, sf_dir,
        "SELECT 'The River' || CAST(p_partkey AS STRING) || ' Works' AS name FROM part WHERE p_partkey % 2 = 0 "
        "UNION ALL SELECT 'The Firm of Order' || CAST(l_orderkey AS STRING) || ' and Line' || CAST(l_linenumber AS STRING) AS name FROM lineitem "
        "UNION ALL SELECT 'The House of ' || c_name AS name FROM customer",
    )
    return D.detect_company(rows(spark, sf_dir, THE_TEXTS), names).select("pii_type", "start", "value")


# Candidates that overlap: e-mails, phones, cards and, ranked last, any digits.
DIGITS = P.Rule("cc", "id_numbers", "digits", "0-9", "[0-9]{3,}")
_CANDIDATES = " UNION ALL ".join(
    f"SELECT *, {prio} AS prio FROM ({re2_spans('documents', 'doc_id', 'text', pattern, t, r)})"
    for pattern, t, r, prio in (
        (RE2_EMAIL, "email", "email", 1),
        (RE2_PHONE, "phone", "phone", 2),
        (RE2_CARD, "financial", "card", 3),
        ("[0-9]{3,}", "id_numbers", "digits", 4),
    )
)


@query(
    f"""
    WITH RECURSIVE c AS MATERIALIZED (
        SELECT *, start + length(value) AS stop,
               row_number() OVER (PARTITION BY doc_id ORDER BY start, -length(value), prio) AS rn
        FROM ({_CANDIDATES})
    ), kept AS (
        SELECT doc_id, rn, stop FROM c WHERE rn = 1
        UNION ALL
        SELECT doc_id, rn, stop FROM (
            SELECT c.doc_id, c.rn, c.stop,
                   row_number() OVER (PARTITION BY c.doc_id ORDER BY c.rn) AS nth
            FROM c JOIN kept k ON c.doc_id = k.doc_id AND c.rn > k.rn AND c.start >= k.stop
        ) WHERE nth = 1
    )
    SELECT c.doc_id, c.pii_type, c.rule, c.start, c.value FROM c JOIN kept k ON c.doc_id = k.doc_id AND c.rn = k.rn
    """
)
def resolve_overlaps(spark, sf_dir):
    text = protect(F.col("text"))

    def candidates(rule, pii_type, name, prio):
        return F.transform(piece_spans(pieces(mark_all(text, [rule]))), lambda s: F.struct(
            F.lit(pii_type).alias("pii_type"), F.lit(name).alias("rule"), s["start"].alias("start"),
            s["end"].alias("end"), s["value"].alias("value"), F.lit(prio).alias("prio"),
        ))

    spans = F.concat(
        candidates(P.EMAIL, "email", "email", 1),
        candidates(P.PHONE, "phone", "phone", 2),
        candidates(P.CARD, "financial", "card", 3),
        candidates(DIGITS, "id_numbers", "digits", 4),
    )
    found = table(spark, sf_dir, "documents").select("doc_id", D.resolve_overlaps(spans).alias("spans"))
    return D.span_rows(found, F.col("spans")).select(SPAN_COLUMNS)


# No personal data of these shapes in the conversations: nothing may be found or changed.
@query("SELECT conv_id, turn, text AS content, CAST(0 AS INTEGER) AS spans FROM conversations")
def sanitize_conversations(spark, sf_dir):
    done = sanitize_documents(table(spark, sf_dir, "conversations"), id_col="conv_id")
    changed = F.filter("applied", lambda p: p["pii_type"].isNotNull())
    return done.select("conv_id", "turn", "content", F.size(changed).alias("spans"))
