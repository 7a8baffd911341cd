"""Personal data in texts: labelers vote on candidate spans, EM weighs them, a classifier decides.

Fixed rules give the base spans, which always stay. Wider rules propose further
candidates. Five labelers (shape, validity, gazetteer, context, borders) vote for,
against or not at all on every candidate. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern marks
personal data; a logistic classifier is trained on these probabilities. It does not see the
votes but what the labelers do not look at: how long a candidate is, what characters it is
made of and what stands right before and behind it. Its odds over the average ones are
multiplied with those of the votes and decide which candidates become spans; where
accepted ones overlap, the first and longest stays.

Votes and features take few values, so what goes to the driver is a table of patterns
with counts, of a size that the rules bound (``MAX_PATTERNS``), whatever the corpus.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batch_of, id_and_text, map_texts, saved, text_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "national_id", "secret")
LABELERS = ("shape", "validity", "gazetteer", "context", "borders")
LENGTHS = (8, 12, 16, 20, 32)
BORDERS = (" \t\r\n", "=:", "\"'`", "()[]{}<>", ",.;!?")  # classes of characters beside a candidate; also others, none
MADE_OF = ("digits", "letters", "both", "with marks")
TRAITS = (len(LENGTHS) + 1, len(MADE_OF), len(BORDERS) + 2, len(BORDERS) + 2)  # length, characters, before, behind
MAX_PATTERNS = len(KINDS) * 3 ** len(LABELERS) * math.prod(TRAITS)
THRESHOLD = 0.5

# The base rules.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]")

# Wider rules: what stands where only a part of a base rule holds.
AT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?"
    r"[A-Za-z0-9-]+(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]+)+",
    re.IGNORECASE | re.ASCII,
)
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api_?key)["']?\x20?[=:]\x20?["']?([A-Za-z0-9_/+=-]{16,})""", re.I)

CUES = {
    "email": "mail e-mail contact write reach address",
    "ip": "ip address host server login logged client",
    "card": "card visa mastercard credit debit payment pay",
    "phone": "phone tel mobile call fax contact cell whatsapp",
    "account": "iban account bank transfer payment",
    "national_id": "ssn social security id passport tax",
    "secret": "token secret password passwd key credential",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version release isbn issn section figure chapter order invoice page build".split())
TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu ch at nl pl ru cn jp in br ca au us".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91".split())
WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` decides at most one match: the run before it, from the last match on, and the domain behind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        elif start == at or not domain:
            # The run before may not be used again across this sign.
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Matches of the four base rules, by kind, each leftmost and non-overlapping."""
    found: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            found[1] = [m.span() for m in IP.finditer(text) if octets(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = NOT_DIGITS.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found[2].append(m.span())
        if "+" in text:
            found[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGITS.sub("", m.group())) <= 15]
    return found


def wider_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base rules."""
    out = []
    low = text.casefold() if "(" in text or "[" in text else ""
    if "(at)" in low or "[at]" in low:
        out += [("email", *m.span()) for m in AT.finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    if DIGIT.search(text):
        out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        out += [("national_id", *m.span()) for m in NATIONAL_ID.finditer(text)]
        out += [("account", *m.span()) for m in ACCOUNT.finditer(text)]
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 15 and digits[0] in "3456":
                out.append(("card", *m.span()))
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, 0 none, -1 against."""
    value = text[start:end]
    digits = NOT_DIGITS.sub("", value)
    lead = WORD.findall(text[max(0, start - 48) : start].lower())[-6:]
    if kind == "email":
        valid = 1 if 6 <= len(value) <= 254 else -1
        listed = 1 if re.split(r"[^a-z]+", value.lower().rstrip(")]"))[-1] in TOP_DOMAINS else 0
    elif kind == "ip":
        valid = -1 if any(len(p) > 1 and p[0] == "0" for p in value.split(".")) else 1
        listed = -1 if value.startswith(("0.", "127.", "255.")) else 0
    elif kind == "card":
        valid = 1 if luhn(digits) else -1
        listed = 1 if digits[0] in "3456" else 0
    elif kind == "phone":
        valid = 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        listed = 1 if base and any(digits.startswith(c) for c in CALLING) else 0
    elif kind == "account":
        moved = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in moved[4:] + moved[:4])
        valid = 1 if int(number) % 97 == 1 else -1
        listed = 0
    elif kind == "national_id":
        valid = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        listed = 0
    else:
        valid = 1 if len(set(value)) >= 8 else -1
        listed = 1 if DIGIT.search(value) else 0
    context = 1 if CUES[kind].intersection(lead) else -1 if AGAINST.intersection(lead) else 0
    inner = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return (1 if base else 0, valid, listed, context, 1 if inner else -1)


def border(c: str) -> int:
    """The class of a character beside a candidate, empty at an end of the text."""
    return next((k for k, some in enumerate(BORDERS) if c in some), len(BORDERS)) if c else len(BORDERS) + 1


def traits(text: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a candidate beside the votes, each below its number in ``TRAITS``."""
    value = text[start:end]
    digits, letters = bool(DIGIT.search(value)), any(map(str.isalpha, value))
    made = 3 if not value.isalnum() else 2 if digits and letters else 1 if letters else 0
    return sum(end - start >= x for x in LENGTHS), made, border(text[start - 1 : start] if start else ""), border(text[end : end + 1])


def pattern(kind: str, vote: tuple[int, ...], trait: tuple[int, ...]) -> int:
    """Kind, votes and traits as one number below ``MAX_PATTERNS``."""
    p = KINDS.index(kind)
    for v in vote:
        p = 3 * p + v + 1
    for t, size in zip(trait, TRAITS, strict=True):
        p = size * p + t
    return p


def parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(kind, votes, traits)`` of patterns."""
    trait, vote = [], []
    for size in TRAITS[::-1]:
        p, t = np.divmod(p, size)
        trait.append(t)
    for _ in LABELERS:
        p, v = np.divmod(p, 3)
        vote.append(v - 1)
    return p, np.stack(vote[::-1], 1), np.stack(trait[::-1], 1)


def expectation_maximisation(vote: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is personal data, and each labeler's table of
    ``P(vote | class)`` (class no, yes; votes against, none, for); counts are smoothed."""
    n_labelers = vote.shape[1]
    yes = np.clip((vote.sum(1) + n_labelers) / (2 * n_labelers), 0.05, 0.95)
    table = np.zeros((n_labelers, 2, 3))
    for _ in range(rounds):
        weights = np.stack((count * (1 - yes), count * yes))
        for j, c, v in itertools.product(range(n_labelers), range(2), range(3)):
            # A vote for counts a little for the class yes, one against for no: the classes keep their meaning.
            prior = 1.0 + (v == 2 * c)
            table[j, c, v] = weights[c][vote[:, j] == v - 1].sum() + prior
        table /= table.sum(2, keepdims=True)
        share = (weights[1].sum() + 1) / (weights.sum() + 2)
        log = np.log(np.array([1 - share, share]))[None, :]
        log = log + sum(np.log(table[j][:, vote[:, j] + 1]).T for j in range(n_labelers))
        now = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        if np.abs(now - yes).max() < 1e-9:
            break
        yes = now
    return yes, table


def features(p: np.ndarray) -> np.ndarray:
    kind, _, trait = parts(p)
    return np.concatenate(
        (
            np.ones((len(p), 1)),
            kind[:, None] == np.arange(len(KINDS)),
            *(trait[:, k, None] == np.arange(size) for k, size in enumerate(TRAITS)),
        ),
        axis=1,
        dtype=float,
    )


def odds(chance: np.ndarray) -> np.ndarray:
    """Logarithms of odds, bounded."""
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    return np.log(chance / (1 - chance))


def train(p: np.ndarray, count: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of the span classifier, by Newton steps on the EM probabilities of patterns."""
    x, w = features(p), np.zeros(features(p[:1]).shape[1])
    share = count / count.sum()
    for _ in range(30):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (guess - target)) + 1e-4 * w
        curve = (x * (share * guess * (1 - guess))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def chances(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each pattern the probability of personal data, by its votes and by the classifier fitted on all."""
    target, _ = expectation_maximisation(parts(p)[1], count)
    by_traits = features(p) @ train(p, count, target)
    total = odds(target) + by_traits - odds((count * target).sum() / count.sum())
    return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("kind", pa.list_(pa.int8())),
        ("start", pa.list_(pa.int32())),
        ("stop", pa.list_(pa.int32())),
        ("pattern", pa.list_(pa.int32())),
        ("base", pa.list_(pa.bool_())),
    ]
)
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])
SPANS_DDL = "doc_id long, spans array<struct<kind: string, start: int, stop: int, base: boolean>>"
FOUND_DDL = (
    "doc_id long, kind array<tinyint>, start array<int>, stop array<int>, pattern array<int>, base array<boolean>"
)


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """``(kind, start, stop, pattern, is base)``; a wider candidate that meets a base span is left out,
    other candidates may overlap."""
    out = []
    for kind, spans in zip(BASE_KINDS, base_spans(text), strict=True):
        out += [(kind, a, b, True) for a, b in spans]
    wider = wider_spans(text)
    if wider and out:
        taken = sorted((a, b) for _, a, b, _ in out)
        starts = [a for a, _ in taken]
        reach = list(itertools.accumulate((b for _, b in taken), max))
        clear = []
        for kind, a, b in wider:
            k = int(np.searchsorted(starts, b))  # base spans that begin before its end
            if k == 0 or reach[k - 1] <= a:
                clear.append((kind, a, b))
        wider = clear
    out += [(kind, a, b, False) for kind, a, b in wider]
    return [
        (KINDS.index(kind), a, b, pattern(kind, votes(text, kind, a, b, base), traits(text, a, b)), base)
        for kind, a, b, base in out
    ]


def settled(found: list[tuple], accepted: frozenset[int]) -> list[tuple]:
    """Candidates that become spans, by kind and start: base ones, and accepted ones that do not overlap."""
    out, last = [c for c in found if c[4]], -1
    for c in sorted((c for c in found if not c[4] and c[3] in accepted), key=lambda c: (c[1], -c[2], c[0])):
        if c[1] >= last:
            out.append(c)
            last = c[2]
    return sorted(out)


def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches):
        rows = [list(zip(*c, strict=True)) or [()] * 5 for c in (candidates(t.decode()) for t in texts)]
        yield batch_of(FOUND, ids, *([list(r[k]) for r in rows] for k in range(5)))


def proposed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return saved(id_and_text(docs, id_col, text_col).mapInArrow(propose, FOUND_DDL), "pii")


def accepted_patterns(found: DataFrame, threshold: float = THRESHOLD) -> list[int]:
    """Patterns that the classifier, fitted on all candidates, gives at least ``threshold``."""
    counts = found.select(F.explode("pattern").alias("pattern")).groupBy("pattern").count().collect()
    counts.sort(key=lambda r: r["pattern"])
    if not counts:
        return []
    p = np.array([r["pattern"] for r in counts], np.int64)
    return p[chances(p, np.array([r["count"] for r in counts], float)) >= threshold].tolist()


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``, one row per input row: ``spans`` is an array of ``(kind, start, stop, base)``
    ordered by kind as in :data:`KINDS`, then start; offsets in code points, stop exclusive.

    Base spans always stay; candidates of the wider rules are added where the classifier
    gives at least ``threshold`` and neither a base span nor an accepted one is in the way. Null and empty texts have no
    spans; null ids stay null, repeated rows come out as often as they come in, other
    columns are ignored. The classifier is fitted on all candidates of the input.
    """
    found = proposed(docs, id_col, text_col)
    accepted = frozenset(accepted_patterns(found, threshold))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, 6)]
            spans = [
                [{"kind": KINDS[k], "start": a, "stop": b, "base": base} for k, a, b, _, base in settled(rows, accepted)]
                for rows in (list(zip(*c, strict=True)) for c in zip(*columns, strict=True))
            ]
            yield batch_of(SPANS, batch.column(0), spans)

    return found.mapInArrow(settle, SPANS_DDL)


def masked(text: str, accepted: frozenset[int]) -> str:
    """A text with every span that stays replaced by its kind in brackets; spans that overlap become one."""
    out, last = [], 0
    for kind, a, b, _, _ in sorted(settled(candidates(text), accepted), key=lambda c: (c[1], -c[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def mask_pii(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs``, personal data in the text masked; null texts stay null.

    Spans as in :func:`pii_spans`; each row is masked where it is, texts are not shuffled.
    """
    accepted = frozenset(accepted_patterns(proposed(docs, id_col, text_col), threshold))
    return map_texts(docs, text_col, lambda texts: (None, [masked(t, accepted) for t in texts]))


def as_text(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
