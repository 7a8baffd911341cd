"""Input and output pairs the rule texts give, for each legal pair; and what must stay."""

import re

import pytest

from inkveil.operators.actions import check_actions

DELETE = {
    "person_name": [
        ("John Smith sent the email", "[NAME_REMOVED] sent the email"),
        ("Contact Sarah Johnson", "Contact [NAME_REMOVED]"),
        ("Dear Bob, see Dr. Strange", "Dear [NAME_REMOVED], see Dr. [NAME_REMOVED]"),
        ("**From:** Zoltan Kis <x>", "**From:** [NAME_REMOVED] <x>"),
        ("Emma O'Brien and Peter Van Dyke", "[NAME_REMOVED] and [NAME_REMOVED]"),
        ("Sarah Müller-Lüdenscheidt wrote", "[NAME_REMOVED] wrote"),
        ("John Smith's car", "[NAME_REMOVED]'s car"),
        ("Contact John Smith, Group Manager", "Contact [NAME_REMOVED], Group Manager"),
        ("Sarah Johnson, Company Secretary", "[NAME_REMOVED], Company Secretary"),
        ("John Smith, Bank Manager", "[NAME_REMOVED], Bank Manager"),
        ("Michael O’Brien wrote", "[NAME_REMOVED] wrote"),
        ("Contact: JOHN SMITH", "Contact: [NAME_REMOVED]"),
        ("John Smith; John’s, Johnny and John-Boy", "[NAME_REMOVED]; [NAME_REMOVED]’s, Johnny and [NAME_REMOVED]-Boy"),
    ],
    "email": [
        ("Contact john.smith@company.com", "Contact [EMAIL_REMOVED]"),
        ("a@b.co,c+d@e-f.example.org.", "[EMAIL_REMOVED],[EMAIL_REMOVED]."),
        ("no@mail here @ all", "no@mail here @ all"),
        ("'a@b.org' o'brien@x.com", "'[EMAIL_REMOVED]' [EMAIL_REMOVED]"),
    ],
    "phone": [
        ("call +1 (555) 123-4567 now", "call [PHONE_REMOVED] now"),
        ("555.123.4567", "[PHONE_REMOVED]"),
        ("+61 2 1234 5678, (555) 123-4567; 555-123-4567", "[PHONE_REMOVED], [PHONE_REMOVED]; [PHONE_REMOVED]"),
        ("5551234567, 0412345678; 01 23 45 67 89", "[PHONE_REMOVED], [PHONE_REMOVED]; [PHONE_REMOVED]"),
        ("0044 20 7946 0958 but 1234567890, a5551234567", "[PHONE_REMOVED] but 1234567890, a5551234567"),
        ("555-1234 or +33 1 23 45 67 89 or 07911 123456", "[PHONE_REMOVED] or [PHONE_REMOVED] or [PHONE_REMOVED]"),
    ],
    "address": [
        ("at 123 Main St, New York, NY 10001.", "at [ADDRESS_REMOVED]."),
        ("PO Box 456, Seattle WA", "[ADDRESS_REMOVED]"),
        ("in Portland, OR 97201-1234 today", "in [ADDRESS_REMOVED] today"),
        ("12 Old Mill Road, Apt 4B", "[ADDRESS_REMOVED]"),
        ("PO BOX 123, Seattle WA; 350 5th Ave, now", "[ADDRESS_REMOVED]; [ADDRESS_REMOVED], now"),
        ("123 MAIN ST, NEW YORK, NY 10001", "[ADDRESS_REMOVED]"),
        ("123 Main street but 5 Good way", "[ADDRESS_REMOVED] but 5 Good way"),
    ],
    "financial": [
        ("card 4111 1111 1111 1111 or 4465758382889437", "card [FINANCIAL_REMOVED] or [FINANCIAL_REMOVED]"),
        ("4465758382889437 4465758382889438", "[FINANCIAL_REMOVED] [FINANCIAL_REMOVED]"),
        ("Account number: 12345678, IBAN DE89 3704 0044 0532 0130 00", "Account number: [FINANCIAL_REMOVED], IBAN [FINANCIAL_REMOVED]"),
    ],
    "id_numbers": [
        ("badge EMP-12345, SSN 123-45-6789", "badge [ID_REMOVED], SSN [ID_REMOVED]"),
        ("passport no. X1234567; driver's license D123-4567", "passport no. [ID_REMOVED]; driver's license [ID_REMOVED]"),
        ("Customer#000000001", "Customer#[ID_REMOVED]"),
        ("driver’s license number D1234567", "driver’s license number [ID_REMOVED]"),
        ("customer 2024 report", "customer 2024 report"),
    ],
    "date_of_birth": [
        ("born on 1980-02-03 in Rome", "born on [DOB_REMOVED] in Rome"),
        ("DOB: 03/04/1975", "DOB: [DOB_REMOVED]"),
        ("birthday March 5, 1990", "birthday [DOB_REMOVED]"),
        ("DOB: 1980/05/01, DOB: 5 MARCH 1980", "DOB: [DOB_REMOVED], DOB: [DOB_REMOVED]"),
        ("born in March 1980, met in March 1999", "born in [DOB_REMOVED], met in March 1999"),
        ("aged 45 (1979-01-02)", "aged 45 ([DOB_REMOVED])"),
    ],
}

UNTOUCHED = [
    "server 97.51.17.173 answered",
    'token = "11acdfb36bb72224148e6160f674b4be45601bf"',
    "Apache License, Version 2.0.",
    "The meeting is on 2024-01-15.",
    "Revenue was $5,000,000 overall.",
    "",
    "é1234 x \x01 odd \x02 marks \x03e \x03",
]


@pytest.mark.parametrize("pii_type", DELETE)
def test_delete(sanitize_texts, pii_type):
    cases = DELETE[pii_type]
    assert sanitize_texts([c[0] for c in cases], {pii_type: "delete"}) == [c[1] for c in cases]


def test_nothing_else_is_touched(sanitize_texts):
    actions = {t: "delete" for t in DELETE} | {"company": "invent"}
    assert sanitize_texts(UNTOUCHED, actions) == UNTOUCHED


def test_keep_part(sanitize_texts):
    cases = [
        ("John Michael Smith, John Andrew Davis and Sarah Johnson.", "John 1, John 2 and Sarah 1."),
        ("John Smith met John Smith, John Smith and John Davis", "John 1 met John 1, John 1 and John 2"),
        # a bare first name is the person that has it; a titled surname too
        ("John Allen Smith left. John came back. Mr. Smith sat.", "John 1 left. John 1 came back. Mr. John 1 sat."),
        ("Dr. Strange waits", "Dr. [NAME_REMOVED] waits"),
        ("john.smith@company.com and ceo@example.org", "[EMAIL_REDACTED]@company.com and [EMAIL_REDACTED]@example.org"),
        ("+1 (555) 123-4567", "+1 (555) [REDACTED]"),
        ("+61 2 1234 5678", "+61 (2) [REDACTED]"),
        ("555.123.4567", "(555) [REDACTED]"),
        ("+15551234567", "+1 (555) [REDACTED]"),
        ("555-1234", "[REDACTED]"),
        ("Acme Corp hired Emma Stone of Google", "Acme Corp hired Emma 1 of Google"),
        # company beats person where both fit
        ("John Lewis Partners pays", "John Lewis Partners pays"),
    ]
    actions = {t: "keep_part" for t in ("person_name", "email", "phone", "company")}
    assert sanitize_texts([c[0] for c in cases], actions) == [c[1] for c in cases]


def test_amounts_only_where_a_person_is(sanitize_texts):
    text = "John Smith owes $1,200.50. Sales were $9,000,000. Costs: €300 paid by Mr. Baker\nTotal USD 500"
    out = sanitize_texts([text], {"financial": "delete", "person_name": "keep_part"})
    assert out == [
        "John 1 owes [FINANCIAL_REMOVED]. Sales were $9,000,000. Costs: [FINANCIAL_REMOVED] paid by Mr. [NAME_REMOVED]\nTotal USD 500"
    ]


INVENT = [
    ("+1 (555) 123-4567", r"\+1 \(555\) \d{3}-\d{4}"),
    ("+61 2 1234 5678", r"\+61 2 \d{4} \d{4}"),
    ("123 Main St, New York, NY 10001", r"[1-9]\d{2} [A-Z][a-z]+ St, [A-Z][a-z]+, [A-Z]{2} [1-9]\d{4}"),
    ("PO Box 456, Seattle WA", r"PO Box [1-9]\d{2}, [A-Z][a-z]+ [A-Z]{2}"),
    ("4111-1111-1111-1111", r"[1-9]\d{3}-\d{4}-\d{4}-\d{4}"),
    ("EMP-12345", r"EMP-[1-9]\d{4}"),
    ("123-45-6789", r"[1-9]\d{2}-\d{2}-\d{4}"),
    ("born on 1980-02-03", r"born on 19(78|79|80|81|82)-\d{2}-\d{2}"),
    ("DOB: 25/12/1975", r"DOB: \d{2}/\d{2}/197[3-7]"),
    ("DOB: March 5, 1990", r"DOB: [A-Z][a-z]+ \d{1,2}, (1988|1989|1990|1991|1992)"),
    ("DOB: 1/2/75", r"DOB: 1/2/7[34]"),
    ("Acme Corp", r"[A-Z][a-z]+ [A-Z][a-z]+"),
    ("John Smith", r"[A-Z][a-z]+ [A-Z][a-z]+"),
]


def test_invent(sanitize_texts):
    actions = {t: "invent" for t in (
        "person_name", "phone", "company", "address", "financial", "id_numbers", "date_of_birth"
    )}
    texts = [c[0] for c in INVENT]
    first, again = sanitize_texts(texts, actions), sanitize_texts(texts, actions)
    assert first == again
    for (text, shape), out in zip(INVENT, first):
        assert re.fullmatch(shape, out), (text, out)
        assert out != text
    assert sanitize_texts(texts, actions, salt="other") != first


def test_invent_is_consistent_and_keeps_people_apart(sanitize_texts):
    text = "; ".join(f"{f} {l}" for f in ("John", "Sarah", "Emma") for l in ("Smith", "Davis", "Baker")) * 2
    out = sanitize_texts([text.replace("BakerJohn", "Baker; John")], {"person_name": "invent"})[0]
    names = out.split("; ")
    assert names[:9] == names[9:]
    assert len(set(names)) == 9
    assert not set(names) & set(text.split("; "))


def test_only_legal_pairs():
    for t, a in (("email", "invent"), ("company", "delete"), ("address", "keep_part"), ("nickname", "delete")):
        with pytest.raises(ValueError):
            check_actions({t: a})
