"""Forty sentence shapes for each type of personal data, one per customer in turn.

A shape is a list of parts, as the letters are: plain text and spans, so the SQL that
says what must be found is put together from the same parts.
"""

from __future__ import annotations

from inkveil.plans.inputs import FIRST, Part, num, pick, text

N = "c_custkey"
SURNAMES = [
    "Henderson", "Kowalczyk", "Lindgren", "McGregor", "Petersen", "Tanaka", "Moreau", "Castellano", "Vandenberg",
    "Müller-Lang",
]
FIRST_NAME, SURNAME = pick(FIRST, f"floor({N} / 7)"), pick(SURNAMES, f"floor({N} / 3)")
FULL = f"{FIRST_NAME} || ' ' || {SURNAME}"


def person(sql: str) -> Part:
    return Part(sql, "person_name")


def person_shapes() -> list[list[Part]]:
    """Somebody named in full, then again: by surname, first name, title, genitive or in full; first or later in a sentence."""
    first = [
        [person(FULL), Part(text(" wrote to us."))],
        [Part(text("We met ")), person(f"{FIRST_NAME} || ' Grace ' || {SURNAME}"), Part(text(" in the office."))],
        [Part(text("Name: ")), person(FULL), Part(text("\nThe file is new."))],
        [Part(text("Dear ")), person(FULL), Part(text(", thank you."))],
    ]
    again = [
        [person(SURNAME)],
        [person(FIRST_NAME)],
        [Part(text("Dr. ")), person(SURNAME)],
        [Part(text("the letter of ")), person(SURNAME), Part(text("'s wife"))],
        [person(FULL)],
    ]
    places = [(" ", " answered soon."), (" Then ", " answered soon.")]
    return [a + [Part(text(before))] + b + [Part(text(behind))] for a in first for b in again for before, behind in places]


FRAMES = [("Please note ", "."), ("", " is on file."), ("On file: ", "; see below."), ("(see ", ")"), ("We have ", " and more.")]
D3, D4 = num(f"({N} * 31) % 1000", 3), num(f"({N} * 7919) % 10000", 4)
YEAR = f"CAST(1950 + {N} % 50 AS STRING)"
MONTH = pick("January,February,March,April,May,June,July,August,September,October,November,December".split(","), N)
DAY = f"CAST(10 + {N} % 19 AS STRING)"

# Per type: what stands before the value as its cue, and the value.
FORMATS = {
    "email": [
        ("", f"'user' || CAST({N} AS STRING) || '@example.com'"),
        ("", f"'first.last' || CAST({N} AS STRING) || '@mail.example.org'"),
        ("", f"'a+b' || CAST({N} AS STRING) || '@sub-domain.example.net'"),
        ("", f"'A_B%' || CAST({N} AS STRING) || '@EXAMPLE.COM'"),
        ("mailto:", f"'x-y' || CAST({N} AS STRING) || '@example.co.uk'"),
        ("mail <", f"'me' || CAST({N} AS STRING) || '@example.io'"),
        ("e-mail ", f"CAST({N} AS STRING) || '@123.example.de'"),
        ("write to ", f"'o.k.' || CAST({N} AS STRING) || '@a.b.c.example.museum'"),
    ],
    "phone": [
        ("", f"'+1 (555) ' || {D3} || '-' || {D4}"),
        ("", f"'+44 (0)20 ' || {D4} || ' ' || {D4}"),
        ("", f"'555.' || {D3} || '.' || {D4}"),
        ("call ", f"'(555) ' || {D3} || '-' || {D4}"),
        ("", f"'0044 20 ' || {D4} || ' ' || {D4}"),
        ("tel ", f"'1-555-' || {D3} || '-' || {D4}"),
        ("", f"'+33 1 23 45 67 ' || {num(f'{N} % 100', 2)}"),
        ("", f"'555' || {D3} || {D4}"),
    ],
    "company": [
        ("", f"'Acme' || CAST({N} AS STRING) || ' Corp'"),
        ("", "'Globex Works Ltd'"),
        ("", f"'Initech' || CAST({N} AS STRING) || ' Holdings'"),
        ("", "'Stark Steel LLC'"),
        ("", "'Quux & Sons, Inc'"),
        ("", f"'Nord' || CAST({N} AS STRING) || ' GmbH'"),
        ("", "'Blue River Water Group'"),
        ("", "'Deutsche Bank'"),
    ],
    "address": [
        ("", f"CAST(100 + {N} AS STRING) || ' Main St, New York, NY 10001'"),
        ("", f"'PO Box ' || CAST(1 + {N} AS STRING) || ', Seattle WA'"),
        ("", f"CAST(1 + {N} AS STRING) || ' Old Mill Road, Apt 4B'"),
        ("", f"CAST(1 + {N} AS STRING) || ' MAIN ST, NEW YORK, NY 10001'"),
        ("", f"'Portland, OR 97201-' || {D4}"),
        ("", f"'Flat 2, ' || CAST(1 + {N} AS STRING) || ' High Street, London SW1A 2AA'"),
        ("", f"CAST(1 + {N} AS STRING) || ' King Street, Toronto, ON M5V 2T6'"),
        ("", f"'Unit 7, ' || CAST(1 + {N} AS STRING) || ' Harbour Road, Sydney NSW 2000'"),
    ],
    "financial": [
        ("", f"'4' || {num(N, 15)}"),
        ("", f"'4111 1111 ' || {D4} || ' ' || {D4}"),
        ("", f"'4111-1111-' || {D4} || '-' || {D4}"),
        ("account number: ", f"CAST(10000000 + {N} AS STRING)"),
        ("IBAN ", f"'DE89 3704 0044 0532 0130 ' || {num(f'{N} % 100', 2)}"),
        ("acct ", f"CAST(10000000 + {N} AS STRING)"),
        ("sort code ", f"'12-34-' || {num(f'{N} % 100', 2)}"),
        ("", f"'3782 822463 ' || {num(f'10000 + {N} % 9000', 5)}"),
    ],
    "id_numbers": [
        ("", f"{num(f'100 + {N} % 800', 3)} || '-12-' || {D4}"),
        ("badge ", f"'EMP-' || CAST(10000 + {N} AS STRING)"),
        ("", f"'CUST' || CAST(10000 + {N} AS STRING)"),
        ("passport no. ", f"'X' || CAST(1000000 + {N} AS STRING)"),
        ("driver's license ", f"'D123-' || {D4}"),
        ("SSN ", f"CAST(100000000 + {N} AS STRING)"),
        ("patient id: ", f"CAST(100000 + {N} AS STRING)"),
        ("tax file number ", f"CAST(100000000 + {N} AS STRING)"),
    ],
    "date_of_birth": [
        ("born on ", f"{YEAR} || '-05-' || {DAY}"),
        ("DOB: ", f"'05/' || {DAY} || '/' || {YEAR}"),
        ("birthday ", f"{MONTH} || ' ' || {DAY} || ', ' || {YEAR}"),
        ("date of birth ", f"{DAY} || ' ' || {MONTH} || ' ' || {YEAR}"),
        ("DOB ", f"{DAY} || '-' || substr({MONTH}, 1, 3) || '-' || {YEAR}"),
        ("born in ", f"{MONTH} || ' ' || {YEAR}"),
        ("aged ", f"CAST(20 + {N} % 70 AS STRING)"),
        ("birth date ", f"{DAY} || '.05.' || {YEAR}"),
    ],
}


def shapes_of(pii_type: str) -> list[list[Part]]:
    return [
        [Part(text(before + cue)), Part(value, pii_type), Part(text(behind))]
        for cue, value in FORMATS[pii_type]
        for before, behind in FRAMES
    ]


AMOUNTS = [
    f"'$' || CAST(1 + {N} % 9 AS STRING) || ',250.50'", f"'€' || CAST(300 + {N} % 99 AS STRING)", f"'USD ' || CAST(500 + {N} AS STRING)",
    f"CAST(20 + {N} AS STRING) || ' dollars'", f"'£ ' || CAST(20 + {N} AS STRING)", f"'$' || CAST(1 + {N} % 9 AS STRING) || ' million'",
    f"CAST(1 + {N} % 9 AS STRING) || '.500,00 €'", f"CAST(1 + {N} % 9 AS STRING) || ' 200 EUR'",
]


def amount_shapes() -> list[list[Part]]:
    """An amount in the sentence of a person, and one in a sentence without."""
    frames = [
        ([person(FULL), Part(text(" of Acme Inc. got "))], " today."),
        ([person(FULL), Part(text(" owes "))], ". Sales were $9,000,000 last year."),
        ([Part(text("Costs of $700 rose. We paid ")), person(FULL), Part(text(" ")), ], " in cash."),
        ([Part(text("Mr. ")), person(SURNAME), Part(text(" sent "))], "\nTotal USD 800"),
        ([Part(text("Total €900\nFor ")), person(FULL), Part(text(" we keep "))], " here."),
    ]
    return [before + [Part(a, "financial"), Part(text(behind))] for a in AMOUNTS for before, behind in frames]


SHAPES = {"person_name": person_shapes()} | {t: shapes_of(t) for t in FORMATS} | {"personal_amount": amount_shapes()}


def joined(parts: list[Part], replace=lambda p: p.sql) -> str:
    return " || ".join(f"({p.sql if p.pii_type is None else replace(p)})" for p in parts)


def sentences(name: str, replace=lambda p: p.sql, column: str = "text") -> str:
    """``(doc_id, text)``: each customer's sentence, spans replaced by ``replace(part)``."""
    shapes = SHAPES[name]
    cases = " ".join(f"WHEN {k} THEN {joined(parts, replace)}" for k, parts in enumerate(shapes))
    return f"SELECT c_custkey AS doc_id, CASE c_custkey % {len(shapes)} {cases} END AS {column} FROM customer"


def spans_of(name: str, pii_type: str) -> str:
    """The spans of a type that must be found: ``(doc_id, pii_type, start, value)``."""
    shapes, out = SHAPES[name], []
    for k, parts in enumerate(shapes):
        before = "0"
        for p in parts:
            if p.pii_type == pii_type:
                out.append(
                    f"SELECT c_custkey AS doc_id, '{pii_type}' AS pii_type, CAST({before} AS INT) AS start, {p.sql} AS value "
                    f"FROM customer WHERE c_custkey % {len(shapes)} = {k}"
                )
            before += f" + length({p.sql})"
    return " UNION ALL ".join(out)
