"""Inputs the queries run on, derived from the test tables.

All of it is SQL that means the same to Spark and to the checking engine. The
number of rows follows the tables: a letter per customer, a profile per
customer, an upload per event, a request per order.
"""

from __future__ import annotations

from dataclasses import dataclass


def text(value: str) -> str:
    """A SQL string literal; newlines as chr(10)."""
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in value.split("\n"))


def pick(values: list[str], n: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST(({n}) % {len(values)} AS INT) + 1)"


def num(n: str, width: int) -> str:
    return f"lpad(CAST({n} AS STRING), {width}, '0')"


# -- letters: one per customer, personal data of all 8 types -----------------

FIRST = ["John", "Sarah", "Michael", "Emma", "Robert", "Laura", "David", "Susan", "Peter", "Olivia"]
LAST = ["Smith", "Davis", "Johnson", "Miller", "Wilson", "Moore", "Taylor", "Anderson", "Baker", "Jackson", "White"]
MIDDLE = ["Allen", "Grace", "Lee"]
COMPANY = ["Acme", "Globex", "Initech", "Umbrella", "Stark"]

TENTH = "CAST(floor(c_custkey / 10) AS BIGINT)"
F = pick(FIRST, "c_custkey")
L1 = pick(LAST, TENTH)
L2 = pick(LAST, f"{TENTH} + 1")
PHONE4 = num("(c_custkey * 7919) % 10000", 4)
PHONE3 = num("(c_custkey * 31) % 1000", 3)
PHONE = (
    f"CASE c_custkey % 4 WHEN 0 THEN '+1 (555) ' || {PHONE3} || '-' || {PHONE4} "
    f"WHEN 1 THEN '+61 2 ' || {PHONE4} || ' ' || {num('(c_custkey * 13) % 10000', 4)} "
    f"WHEN 2 THEN '555.' || {PHONE3} || '.' || {PHONE4} "
    f"ELSE '(555) ' || {PHONE3} || '-' || {PHONE4} END"
)
PHONE_KEPT = (
    "CASE c_custkey % 4 WHEN 0 THEN '+1 (555) [REDACTED]' WHEN 1 THEN '+61 (2) [REDACTED]' "
    "ELSE '(555) [REDACTED]' END"
)
PHONE_PREFIX = "CASE c_custkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 5 END"
ADDRESS = (
    f"CASE c_custkey % 2 WHEN 0 THEN CAST(100 + c_custkey % 900 AS STRING) || ' Main St, New York, NY 10001' "
    f"ELSE 'PO Box ' || CAST(c_custkey AS STRING) || ', Seattle WA' END"
)
BORN_YEAR = "CAST(1950 + c_custkey % 50 AS STRING)"
BORN_MONTH = num("1 + c_custkey % 12", 2)
BORN_DAY = num("1 + c_custkey % 28", 2)
MAIL_HOST = "'mail' || CAST(c_custkey % 9 AS STRING) || '.example.com'"


@dataclass(frozen=True)
class Part:
    """A stretch of the letter: plain text, or a span with its type, rule and entity."""

    sql: str
    pii_type: str | None = None
    rule: str | None = None
    entity: str | None = None


LETTER = [
    Part(text("Dear ")),
    Part(f"{F} || ' ' || {L1}", "person_name", "first_name_list", "one"),
    Part(text(", your customer ID ")),
    Part("'CUST-' || CAST(100000 + c_custkey AS STRING)", "id_numbers", "coded_id"),
    Part(text(" is active.\n")),
    Part(f"{F} || ' ' || {pick(MIDDLE, 'c_custkey')} || ' ' || {L1}", "person_name", "first_name_list", "one"),
    Part(text(" was born on ")),
    Part(f"{BORN_YEAR} || '-' || {BORN_MONTH} || '-' || {BORN_DAY}", "date_of_birth", "dob"),
    Part(text(" and lives at ")),
    Part(ADDRESS, "address", "street"),
    Part(text(".\n")),
    Part(f"{F} || ' ' || {L2}", "person_name", "first_name_list", "two"),
    Part(text(" owes ")),
    Part(
        f"'$' || CAST(c_custkey % 9 + 1 AS STRING) || ',' || {num('c_custkey % 1000', 3)} || '.50'",
        "financial", "personal_amount",
    ),
    Part(text(". ")),
    Part(f"{pick(COMPANY, 'c_custkey')} || ' Corp'", "company", "legal_form"),
    Part(text(" made $5,000,000 last year.\nCall ")),
    Part(PHONE, "phone", "phone"),
    Part(text(" or write to ")),
    Part(f"'user.' || CAST(c_custkey AS STRING) || '@' || {MAIL_HOST}", "email", "email"),
    Part(text(". Mr. ")),
    Part(L1, "person_name", "honorific", "one"),
    Part(text(" agreed and ")),
    Part(F, "person_name", "short_name", "bare"),
    Part(text(" signed.\nCard ")),
    Part(f"'4' || {num('c_custkey', 15)}", "financial", "card"),
    Part(text(", account number: ")),
    Part("CAST(10000000 + c_custkey AS STRING)", "financial", "account"),
    Part(text(", SSN ")),
    Part(f"{num('100 + c_custkey % 800', 3)} || '-' || {num('10 + c_custkey % 90', 2)} || '-' || {num('c_custkey % 10000', 4)}", "id_numbers", "ssn"),
    Part(text(". Meeting on 2024-01-15 at 97.51.17.173.\n")),
]


def letter_text(replace=lambda part: part.sql) -> str:
    """The letter as one SQL expression, spans replaced by ``replace(part)``."""
    return " || ".join(f"({p.sql if p.pii_type is None else replace(p)})" for p in LETTER)


LETTERS = f"SELECT c_custkey AS doc_id, {letter_text()} AS text FROM customer"


def letter_spans(wanted, extra=lambda part: {}) -> str:
    """Expected span rows of the letters: offsets are the lengths of what comes before.

    ``extra(part)`` names further columns and their SQL.
    """
    selects = []
    before = "0"
    for p in LETTER:
        if p.pii_type is not None and wanted(p):
            rule = f"'{p.rule}'"
            if p.rule == "street":
                rule = "CASE c_custkey % 2 WHEN 0 THEN 'street' ELSE 'po_box' END"
            more = "".join(f", {sql} AS {name}" for name, sql in extra(p).items())
            selects.append(
                f"SELECT c_custkey AS doc_id, '{p.pii_type}' AS pii_type, {rule} AS rule, "
                f"CAST({before} AS INT) AS start, {p.sql} AS value{more} FROM customer"
            )
        before += f" + length({p.sql})"
    return " UNION ALL ".join(selects)


def letter_entity(part: Part) -> str:
    """The entity a part of the letter means: a title or a bare name is the person of the first line."""
    if part.entity is not None:
        return f"lower({F} || ' ' || {L2 if part.entity == 'two' else L1})"
    return f"lower({part.sql})"


# -- files -------------------------------------------------------------------

EXTENSIONS = [".txt", ".DOCX", ".pdf", ".xlsx", ".xls", ".csv", ".eml", ".xyz", "", ".tar.txt"]
FILE_NAME = (
    f"CASE WHEN doc_id % 11 = 10 THEN '.txt' ELSE "
    f"source || '_' || CAST(doc_id AS STRING) || {pick(EXTENSIONS, 'doc_id')} END"
)
FILES = f"SELECT doc_id, {FILE_NAME} AS filename, n_chars AS length, text FROM documents"
EXT = (
    f"CASE WHEN doc_id % 11 = 10 THEN '' WHEN doc_id % 10 = 9 THEN '.txt' "
    f"ELSE lower({pick(EXTENSIONS, 'doc_id')}) END"
)

# -- uploads -----------------------------------------------------------------


def uuid_of(key: str) -> str:
    h = f"md5(CAST({key} AS STRING))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
        f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"
    )


UPLOADS = (
    f"SELECT {uuid_of('event_id')} AS file_id, event_type || '.txt' AS filename, "
    "CAST(length(props) AS BIGINT) AS size, ts AS created_at FROM events"
)
# Ids asked for: one per order (some name an upload) and one malformed per customer.
ASKED_IDS = f"SELECT {uuid_of('o_orderkey * 2')} AS file_id FROM orders UNION ALL SELECT c_name AS file_id FROM customer"

# -- profiles: one per customer ----------------------------------------------

PROFILES = (
    "SELECT CAST(c_custkey + 1 AS INT) AS profile_id, "
    "CASE WHEN c_custkey = 0 THEN 'default' ELSE 'Tenant_' || CAST(c_custkey AS STRING) END AS name, "
    "TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS modified_at FROM customer"
)

# (type, its legal actions)
CHOICES = [
    ("person_name", ["delete", "invent", "keep_part"]),
    ("email", ["delete", "keep_part"]),
    ("phone", ["delete", "invent", "keep_part"]),
    ("company", ["keep_part", "invent"]),
    ("address", ["delete", "invent"]),
    ("financial", ["delete", "invent"]),
    ("id_numbers", ["delete", "invent"]),
    ("date_of_birth", ["delete", "invent"]),
]

WIDE_RULES = "SELECT CAST(c_custkey + 1 AS INT) AS profile_id, " + ", ".join(
    f"{pick(a, f'c_custkey + {i}')} AS {t}" for i, (t, a) in enumerate(CHOICES)
) + " FROM customer"

RULES = " UNION ALL ".join(
    f"SELECT CAST(c_custkey + 1 AS INT) AS profile_id, '{t}' AS pii_type, {pick(a, f'c_custkey + {i}')} AS action, "
    f"CASE WHEN c_custkey % 5 = 0 THEN 'own text ' || CAST(c_custkey AS STRING) END AS description FROM customer"
    for i, (t, a) in enumerate(CHOICES)
)

# One request per order: by id, by name in another case, by number as a name, by default, or missing.
REQUESTS = (
    "SELECT o_orderkey AS request_id, "
    "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 WHEN o_orderkey % 55 = 1 THEN o_custkey + 1000000 END AS profile_id, "
    "CASE o_orderkey % 5 WHEN 1 THEN 'TENANT_' || CAST(o_custkey AS STRING) WHEN 2 THEN CAST(o_custkey + 1 AS STRING) "
    "WHEN 3 THEN 'nobody_' || CAST(o_custkey AS STRING) END AS profile FROM orders"
)
