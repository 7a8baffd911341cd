"""What counts as personal data: one :class:`Rule` per shape, in priority order.

A rule never looks inside a stretch an earlier rule took, so the order of
``RULES`` decides every overlap. Patterns are kept linear: bounded word
lengths, no nested open quantifiers, ASCII neighbour classes.
"""

from __future__ import annotations

from dataclasses import dataclass

from inkveil.functions.names import COMPANIES, FIRST_NAMES

# Neighbour tests: no ASCII word character just before / just after.
LB = "(?<![A-Za-z0-9_])"
RB = "(?![A-Za-z0-9_])"

# The same for names, which may hold any letter.
NAME_LB = r"(?<![\p{L}\p{N}_])"
NAME_RB = r"(?![\p{L}\p{N}_])"

# Marks around a match; see marks.py.
OPEN = "\x01"
CLOSE = "\x02"

WORD = r"(?:\p{Lu}['’]|Mc|Mac|De|Van )?\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?"
INITIAL = r"\p{Lu}\."
UPPER_NAME = r"\p{Lu}{2,30}(?: \p{Lu}{2,30}){1,2}"


@dataclass(frozen=True)
class Rule:
    """One shape of personal data.

    ``first`` is the class of characters a match (cue included) can start
    with, ``cue`` is context that must come before and stays in the text,
    ``target`` is what gets replaced. Groups inside are non-capturing.
    A text cannot match unless it holds one of the ``hints`` (words) and a
    match of ``gate`` (a cheap pattern); most texts fail these and skip the rule.
    """

    code: str
    pii_type: str
    name: str
    first: str
    target: str
    cue: str = ""
    hints: tuple[str, ...] = ()
    gate: str = ""


STREET_WORDS = (
    "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|"
    "Terrace|Way|Highway|Hwy|Parkway|Pkwy"
)
STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|DC|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|"
    "NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"
)
# Street words that are no common words may be lower case.
LOWER_STREET_WORDS = "street|avenue|road|boulevard|lane|terrace|highway|parkway"
UPPER_STREET_WORDS = STREET_WORDS.upper()
CITY = "(?:[A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){0,2}|[A-Z]{3,20}(?: [A-Z]{3,20}){0,2})"
ZIP = "[0-9]{5}(?:-[0-9]{4})?"
CITY_STATE = f"{CITY},? (?:{STATES})(?: {ZIP})?{RB}"
UNIT = "(?:Apt|Suite|Ste|Unit)\\.? [A-Za-z0-9-]{1,8}"
# A unit before the street, and what stands behind a town in other countries.
UNIT_FIRST = "(?:Flat|FLAT|Apartment|Apt|Suite|Unit|UNIT|Level|Shop)\\.? [A-Za-z0-9]{1,6}(?:,|/|,? )? ?"
UK_CODE = "[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}"
CANADA_CODE = "(?:AB|BC|MB|NB|NL|NS|NT|NU|ON|PE|QC|SK|YT),? [A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]"
AUSTRALIA_CODE = "(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT),? [0-9]{4}"
OTHER_CODE = f"(?:{UK_CODE}|{CANADA_CODE}|{AUSTRALIA_CODE})"
TOWN = f"(?:{CITY},? {OTHER_CODE}{RB}|{CITY_STATE})"

MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
DATE = (
    "(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
    "|[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{2})"
    f"|(?i:{MONTHS})\\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}"
    f"|[0-9]{{1,2}}(?:st|nd|rd|th)? (?:of )?(?i:{MONTHS})\\.?,? [0-9]{{4}}"
    f"|[0-9]{{1,2}}[-/.](?i:{MONTHS})[-/.](?:[0-9]{{4}}|[0-9]{{2}})"
    f"|(?i:{MONTHS})\\.?,? [0-9]{{4}})"
)
# A birth cue may stand up to this far before its date, in the same line.
DOB_GAP = 20

LEGAL_FORMS = "Incorporated|Inc|Corporation|Corp|LLC|LLP|Limited|Ltd|GmbH|PLC|Plc|AG"
# These are common words too: no comma, no person and no title of office around them.
COMPANY_NOUNS = "Company|Co|Group|Holdings|Industries|Partners|Bank"
OFFICES = (
    "Manager|Secretary|Director|Officer|Head|Lead|Leader|President|Chair|Chairman|Chairwoman|Executive|Analyst|"
    "Clerk|Teller|Assistant|Accountant|Lawyer|Counsel|Partner"
)
COMPANY_WORD = r"\p{Lu}[\p{L}0-9&'-]{0,30}"


def any_of(words) -> str:
    """One of the words; those of one first letter stand together, so that a place is tried against few of them."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def person_target(first_names: str) -> str:
    """First name from a list, optional middle name or initial, last name."""
    return f"{NAME_LB}{first_names} (?:(?:{WORD}|{INITIAL}) )?{WORD}{NAME_RB}"


EMAIL = Rule(
    "em", "email", "email", "A-Za-z0-9._%+-",
    "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:['’][A-Za-z0-9._%+-]++){0,3}@(?:[A-Za-z0-9-]+\\.){1,126}[A-Za-z]{2,}",
    hints=("@",),
)

# Rules that need digits, run only on texts that have some.
IBAN = Rule(
    "ib", "financial", "iban", "A-Z",
    (
        f"{LB}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}"
        f"|(?: [A-Z]{{4}})?(?: [0-9][A-Z0-9]{{3}}){{2,6}}(?: [0-9][A-Z0-9]{{0,2}})?){RB}"
    ),
)
CARD = Rule(
    "cc", "financial", "card", "0-9",
    f"{LB}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){RB}",
)
ACCOUNT = Rule(
    "ac", "financial", "account", "AaBbRrSs",
    f"[0-9](?:[ -]?[0-9]){{4,18}}{RB}",
    cue=(
        f"{LB}(?:[Aa]ccount|ACCOUNT|[Aa]cct|ACCT|[Aa]/[Cc]|[Rr]outing|ROUTING|[Ss]ort [Cc]ode|SORT CODE|BSB|bsb)"
        "(?: (?:[Nn]umber|NUMBER|[Nn]o|NO|[Nn]um))?[.:# ]{1,3}(?:is )?"
    ),
    hints=(
        "ccount", "ACCOUNT", "cct", "ACCT", "/c", "/C", "outing", "ROUTING", "ort code", "ort Code", "SORT CODE",
        "BSB", "bsb",
    ),
)
SSN = Rule("ss", "id_numbers", "ssn", "0-9", f"{LB}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{RB}")
CODED_ID = Rule(
    "ei", "id_numbers", "coded_id", "ECISUMP",
    f"{LB}(?:EMP|EMPL|CUST|CLIENT|STAFF|USER|MEMBER|PATIENT|ID)-?[0-9]{{3,12}}{RB}",
    gate="[A-Z]-?[0-9]{3}",
)
CUED_ID = Rule(
    "ci", "id_numbers", "cued_id", "CcDdEeMmNnPpSsTt",
    f"[A-Z]{{0,3}}[0-9](?:[A-Z0-9]|[ -][0-9]){{3,17}}{RB}",
    cue=(
        f"{LB}(?:(?:[Pp]assport|PASSPORT|[Dd]river['’]?s? [Ll]icen[cs]e|SSN|ssn|[Ss]ocial [Ss]ecurity|TFN|tfn|"
        "[Tt]ax [Ff]ile|[Nn]ational [Ii]nsurance)(?: (?:[Nn]umber|NUMBER|[Nn]o|NO|[Nn]um|[Ii]d|ID))?[.:# ]{1,3}(?:is )?"
        "|(?:[Cc]ustomer|[Ee]mployee|[Cc]lient|[Mm]ember|[Pp]atient|[Ss]taff)"
        "(?: (?:[Ii]d|ID|[Nn]umber|[Nn]o)[.:# ]{1,3}(?:is )?|#))"
    ),
    hints=(
        "assport", "PASSPORT", "river", "SSN", "ssn", "ocial ", "TFN", "tfn", "ax ", "ational ", "ustomer",
        "mployee", "lient", "ember", "atient", "taff",
    ),
)
DOB = Rule(
    "db", "date_of_birth", "dob", "BbDd",
    f"{DATE}{RB}",
    cue=(
        f"{LB}(?:[Bb]orn|BORN|[Bb]irth ?[Dd]ay|[Bb]irth ?[Dd]ate|[Dd]ate [Oo]f [Bb]irth|DATE OF BIRTH|DOB|dob|Dob|"
        f"D\\.O\\.B|d\\.o\\.b){RB}[^\\n{OPEN}{CLOSE}0-9]{{0,{DOB_GAP}}}?"
    ),
    hints=("orn", "BORN", "irth", "BIRTH", "DOB", "dob", "Dob", "D.O.B", "d.o.b"),
)
AGE_DOB = Rule(
    "ag", "date_of_birth", "age_dob", "Aa",
    f"{DATE}{RB}",
    cue=f"{LB}(?:[Aa]ged?|AGED?)[ :][0-9]{{1,3}}[ ,(]{{1,3}}",
    hints=("ge ", "ged ", "ge:", "ged:", "GE ", "GED ", "GE:", "GED:"),
)
# An age alone, where no date follows it.
AGE = Rule(
    "ga", "date_of_birth", "age", "Aa0-9",
    f"(?:(?<=[ :])[0-9]{{1,3}}{RB}(?![ ,(]{{1,3}}{OPEN})|{LB}[0-9]{{1,3}}(?=(?: years old| years of age|-year-old){RB}))",
    cue=f"(?:{LB}(?:[Aa]ged?|AGED?)(?: of)?[ :]{{1,2}}|{LB}(?=[0-9]{{1,3}}(?: years o|-year-o)))",
    hints=("ge ", "ged ", "ge:", "ged:", "GE ", "GED ", "GE:", "GED:", " years o", "-year-o"),
)
_SEP = "[ .-]"
PHONE_SHAPES = [
    # international, the trunk zero in brackets
    f"\\+[0-9]{{1,3}}{_SEP}?\\(0\\) ?[0-9]{{1,4}}(?:{_SEP}?[0-9]{{3,4}}){{2}}",
    # international
    f"\\+[0-9]{{1,3}}{_SEP}?(?:\\([0-9]{{1,4}}\\)|[0-9]{{1,4}})(?:(?:{_SEP}?[0-9]{{2}}){{4}}|(?:{_SEP}?[0-9]{{3,4}}){{2}})",
    # area code in brackets
    f"\\([0-9]{{2,4}}\\) ?[0-9]{{3,4}}{_SEP}[0-9]{{4}}",
]
# Those that begin with a digit and have no word character before.
PHONE_DIGITS = [
    # area code with separators, leading 1 allowed
    f"(?:1{_SEP})?[0-9]{{3}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{4}}",
    f"1{_SEP}\\([0-9]{{3}}\\) ?[0-9]{{3}}{_SEP}[0-9]{{4}}",
    # international with 00: with one kind of separator throughout, or up to 12 digits in a row
    *(f"00[0-9]{{1,3}}{sep}[0-9]{{1,4}}(?:{sep}[0-9]{{3,4}}){{2}}" for sep in (" ", "\\.", "-")),
    f"00[0-9]{{8,10}}",
    # ten digits in a row, or a leading 0 and pairs
    f"(?:[2-9][0-9]{{9}}|0[1-9][0-9]{{8}})",
    f"0[1-9](?:{_SEP}[0-9]{{2}}){{4}}",
    # leading 0
    f"0[0-9]{{1,4}}[ -][0-9]{{3,4}}[ -][0-9]{{3,4}}",
    f"0[0-9]{{3,4}}[ -][0-9]{{6}}",
    # seven digits
    f"[0-9]{{3}}-[0-9]{{4}}",
]
PHONE = Rule("ph", "phone", "phone", "+(0-9", f"(?:{'|'.join(PHONE_SHAPES)}|{LB}(?:{'|'.join(PHONE_DIGITS)})){RB}")
STREET = Rule(
    "st", "address", "street", "0-9FASUL",
    (
        f"{LB}(?:{UNIT_FIRST})?[0-9]{{1,6}}[A-Za-z]? (?:(?:[A-Z][A-Za-z'’.-]{{0,20}}|[0-9]{{1,3}}(?:st|nd|rd|th|ST|ND|RD|TH)) ){{1,4}}"
        f"(?:{STREET_WORDS}|{UPPER_STREET_WORDS}|{LOWER_STREET_WORDS}){RB}\\.?"
        f"(?:,? {UNIT})?(?:,? {TOWN})?"
    ),
    gate="[0-9][A-Za-z]? [A-Z0-9]",
)
PO_BOX = Rule(
    "po", "address", "po_box", "P",
    f"{LB}P\\.?O\\.? ?(?:Box|BOX) [0-9]{{1,8}}{RB}(?:,? {TOWN})?",
    hints=("Box ", "BOX "),
)
CITY_ZIP = Rule(
    "cz", "address", "city_zip", "A-Z",
    f"{LB}{CITY},? (?:(?:{STATES}) {ZIP}|{OTHER_CODE}){RB}",
    gate="[A-Z](?:[0-9]|,? [0-9]{4})",
)

COMPANY = Rule(
    "co", "company", "legal_form", r"\p{Lu}",
    (
        f"{NAME_LB}(?:(?:{COMPANY_WORD} (?:& )?){{0,3}}{COMPANY_WORD},? (?:{LEGAL_FORMS}){NAME_RB}"
        f"|(?!{any_of(FIRST_NAMES)} )(?:{COMPANY_WORD} ){{1,4}}(?:{COMPANY_NOUNS}){NAME_RB}(?! (?:{OFFICES}){NAME_RB}))"
    ),
    gate=rf" (?=[A-Z])(?:{LEGAL_FORMS}|{COMPANY_NOUNS}){NAME_RB}",
)
KNOWN_COMPANY = Rule(
    "kc", "company", "known_company", "A-Z", f"{NAME_LB}{any_of(COMPANIES)}{NAME_RB}",
    gate=f"(?=[A-Z]){any_of(COMPANIES)}",
)

HONORIFIC = Rule(
    "ho", "person_name", "honorific", "MDPS",
    f"{WORD}(?: (?:{WORD}|{INITIAL})){{0,2}}{NAME_RB}",
    cue=f"{LB}(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Sir)\\.? ",
    gate=r"(?=[MDPS])(?:Mrs?|Ms|Miss|Dr|Prof|Professor|Sir)\.? \p{Lu}",
)
KNOWN_PERSON = Rule(
    "kp", "person_name", "first_name_list", "A-Z", person_target(any_of(FIRST_NAMES)),
    gate=r"\p{L} \p{Lu}",
)
# What may follow "Dear" and the like without being a name.
NO_NAMES = (
    "Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Sir|Sirs|Madam|All|Team|Customer|Customers|Colleague|Colleagues|Friend|Friends|"
    "Everyone|Everybody|There|World|Reader|Readers|Hiring"
)
LABELLED_PERSON = Rule(
    "lp", "person_name", "label", "NnCADHTF*",
    f"(?!(?:{NO_NAMES}){NAME_RB})(?:{WORD}(?: (?:{WORD}|{INITIAL})){{0,2}}|{UPPER_NAME}){NAME_RB}",
    cue=(
        f"(?:{LB}(?:(?:[Nn]ame|NAME): ?|Contact: ?|Attn:? |Dear |Hello |Hi )"
        "|\\*\\*(?:From|To|Cc):\\*\\* \"?|(?:From|To|Cc): \"?)"
    ),
    hints=(":", "Attn", "Dear ", "Hello ", "Hi "),
)

# The whole number, whatever parts its thousands and decimals.
NUMBER = "[0-9](?:[0-9.,’]*[0-9])?(?: [0-9]{3}(?![0-9]))*"
CURRENCY = "(?:[$€£]|(?:USD|EUR|GBP|[Dd]ollars|[Ee]uros?|[Pp]ounds)" + RB + ")"
AMOUNT = Rule(
    "am", "financial", "personal_amount", "$€£UEG0-9",
    (
        f"(?:(?:[$€£] ?|(?:USD|EUR|GBP) ){NUMBER}(?: ?(?:million|thousand))?"
        f"|{LB}(?<![.,’0-9]){NUMBER}(?: ?(?:million|thousand))? ?{CURRENCY})"
    ),
)
AMOUNT_GATE = "(?:[$€£] ?|USD |EUR |GBP )[0-9]|[0-9](?: ?(?:million|thousand))? ?" + CURRENCY

DIGIT_RULES = [
    IBAN, CARD, ACCOUNT, SSN, CODED_ID, CUED_ID, DOB, AGE_DOB, AGE, PHONE, STREET, PO_BOX, CITY_ZIP,
]
COMPANY_RULES = [COMPANY, KNOWN_COMPANY]
PERSON_RULES = [HONORIFIC, KNOWN_PERSON, LABELLED_PERSON]

# Marks that are not single-pattern rules.
TABLE_PERSON = Rule("tp", "person_name", "table_column", "", "")
TABLE_EMAIL = Rule("te", "email", "email_column", "", "")
TABLE_PHONE = Rule("th", "phone", "phone_column", "", "")
TABLE_COMPANY = Rule("tc", "company", "company_column", "", "")
TABLE_ADDRESS = Rule("ta", "address", "address_column", "", "")
TABLE_FINANCIAL = Rule("tf", "financial", "financial_column", "", "")
TABLE_ID = Rule("ti", "id_numbers", "id_column", "", "")
TABLE_DOB = Rule("td", "date_of_birth", "dob_column", "", "")
SHORT_PERSON = Rule("sp", "person_name", "short_name", "", "")
SHORT_SURNAME = Rule("sn", "person_name", "short_surname", "", "")
GAZETTEER_PERSON = Rule("gp", "person_name", "gazetteer_person", "", "")
GAZETTEER_COMPANY = Rule("gc", "company", "gazetteer_company", "", "")

RULES = [
    EMAIL, *DIGIT_RULES, *COMPANY_RULES, GAZETTEER_COMPANY, *PERSON_RULES, GAZETTEER_PERSON,
    TABLE_PERSON, SHORT_PERSON, SHORT_SURNAME, AMOUNT,
    TABLE_EMAIL, TABLE_PHONE, TABLE_COMPANY, TABLE_ADDRESS, TABLE_FINANCIAL, TABLE_ID, TABLE_DOB,
]

# Header cells whose column holds person names.
NAME_HEADER = (
    "(?i:(?:(?:full|first|last|customer|client|employee|contact|patient|manager) ?)?name"
    "|contact(?: person)?|employee|manager)"
)

# For the other types: what headers say, and what a cell must hold to count.
_NO = "(?: ?(?:no\\.?|num|number|#|id))?"
COLUMN_RULES = [
    (TABLE_PERSON, NAME_HEADER, ""),
    (TABLE_EMAIL, "(?i:e-?mail(?: address)?)", "@"),
    (TABLE_PHONE, f"(?i:(?:(?:home|work|cell|mobile|contact|office) ?)?(?:tele)?phone{_NO}|mobile{_NO}|cell{_NO}|tel\\.?{_NO}|fax{_NO})", "[0-9]"),
    (TABLE_COMPANY, "(?i:company(?: name)?|employer|firm|organi[sz]ation)", ""),
    (TABLE_ADDRESS, "(?i:(?:(?:home|street|mailing|postal|billing|shipping) ?)?address|street)", ""),
    (
        TABLE_FINANCIAL,
        f"(?i:(?:(?:bank|card|credit card|debit card|savings) ?)?(?:account|acct\\.?|a/c|card){_NO}|iban|sort code|routing{_NO}|"
        "salary|wage|income|balance)",
        "[0-9]",
    ),
    (
        TABLE_ID,
        f"(?i:ssn|social security{_NO}|passport{_NO}|tfn|tax file{_NO}|tax{_NO}|national id|national insurance{_NO}|"
        f"driver['’]?s? licen[cs]e{_NO}|(?:employee|customer|client|member|patient|staff) ?(?:id|no\\.?|number))",
        "[0-9]",
    ),
    (TABLE_DOB, "(?i:dob|d\\.o\\.b\\.?|date of birth|birth ?date|birth ?day|born)", "[0-9]"),
]
