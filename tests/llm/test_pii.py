import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.llm.pii import (
    KINDS,
    MAX_PATTERNS,
    TRAITS,
    base_spans,
    candidates,
    chances,
    expectation_maximisation,
    luhn,
    mask_pii,
    masked,
    parts,
    pattern,
    pii_spans,
    settled,
)

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, rule in enumerate(RULES):
        spans = []
        for m in re.finditer(rule, text):
            n = sum(c in "0123456789" for c in m.group())
            good = (
                True,
                k == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                16 <= n <= 19 and luhn(re.sub("[^0-9]", "", m.group())),
                8 <= n <= 15,
            )[k]
            if good:
                spans.append(m.span())
        out.append(spans)
    return out


PARTS = st.sampled_from(
    ["a", "b.c", "@", "@x.y", ".", "1", "23", "256", "1.2.3.4", " ", "-", "+", "+1 ", "(555)", "4111111111111111", "é", "٣"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_rules_as_plain_patterns(text):
    assert base_spans(text) == plain(text)


def test_base_rules_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        base_spans(text)


def test_patterns():
    for kind in KINDS:
        for vote in ((1, 1, 1, 1, 1), (-1, -1, -1, -1, -1), (0, 1, -1, 0, 1)):
            for trait in ((0, 0, 0, 0), (3, 2, 1, 6), tuple(n - 1 for n in TRAITS)):
                p = pattern(kind, vote, trait)
                assert 0 <= p < MAX_PATTERNS
                got = parts(np.array([p]))
                assert KINDS[got[0][0]] == kind
                assert tuple(got[1][0]) == vote
                assert tuple(got[2][0]) == trait


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.6
    right = (0.95, 0.9, 0.7, 0.6, 0.55)
    vote = np.stack([np.where(rng.random(20_000) < r, truth, ~truth) * 2 - 1 for r in right], 1)
    patterns, at, count = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    yes, table = expectation_maximisation(patterns, count.astype(float))
    for j, r in enumerate(right):
        assert table[j, 1, 2] == pytest.approx(r, abs=0.05)
    guessed = yes[at.ravel()] >= 0.5
    assert (guessed == truth).mean() > 0.95


def test_secrets_are_added_and_base_stays(spark):
    rows = [
        (1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" mail a@b.com'),
        (2, "call +1 (555) 555-1234 or pay 4111111111111111 from 10.0.0.1"),
        (3, None),
        (4, "plain words only"),
    ] + [(10 + k, f'token = "{k:040x}{k * 7919:08x}"') for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.stop, s.base) for s in r.spans] for r in pii_spans(df).collect()}
    assert got[1] == [("email", 58, 65, True), ("secret", 11, 51, False)]
    assert [s[0] for s in got[2]] == ["ip", "card", "phone"]
    assert got[3] == got[4] == []
    text = {r.doc_id: r.text for r in mask_pii(df).collect()}
    assert text[1] == 'x token = "[SECRET]" mail [EMAIL]'
    assert text[2] == "call [PHONE] or pay [CARD] from [IP]"
    assert text[3] is None
    assert text[4] == "plain words only"


def test_wider_candidates_avoid_base():
    kinds = [KINDS[c[0]] for c in candidates("me (at) host (dot) org, 555-123-4567, 219-09-9999, DE89 3704 0044 0532 0130 00")]
    assert sorted(kinds) == ["account", "email", "national_id", "phone"]
    assert [c[4] for c in candidates("+1 555-123-4567")] == [True]


def test_masked_overlaps():
    assert masked("a@1.2.3.4 b", frozenset()) == "[EMAIL] b"


def test_overlaps_are_settled_among_accepted():
    text = "tel 415-555-0132 2024"
    found = candidates(text)
    by_kind = {KINDS[c[0]]: c for c in found}
    assert set(by_kind) == {"card", "phone"}
    card, phone = by_kind["card"], by_kind["phone"]
    assert settled(found, frozenset([phone[3]])) == [phone]
    assert settled(found, frozenset([card[3]])) == [card]
    assert settled(found, frozenset([card[3], phone[3]])) == [card]
    assert masked(text, frozenset([phone[3]])) == "tel [PHONE] 2024"


def test_rejected_candidates_hide_no_others(spark):
    rows = [(k, f"tel 415-555-{k:04d} 2024") for k in range(100, 160)] + [(k, "nothing here") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii_spans(df).where("doc_id >= 100").collect():
        assert [(s.kind, s.start, s.stop) for s in r.spans] == [("phone", 4, 16)]


def test_classifier_goes_by_more_than_votes():
    """Secrets in quotes behind '=' have good votes mostly, words behind a colon bad ones; of two
    candidates with the same votes the one that looks like the former is likelier."""
    rng = np.random.default_rng(3)
    seen: dict[int, int] = {}
    for _ in range(2000):
        good = rng.random() < 0.5
        vote = tuple(int(rng.choice([-1, 0, 1], p=[0.1, 0.2, 0.7] if good else [0.7, 0.2, 0.1])) for _ in range(5))
        p = pattern("secret", vote, (4, 2, 2, 2) if good else (4, 1, 0, 0))
        seen[p] = seen.get(p, 0) + 1
    p = np.array(sorted(seen))
    count = np.array([seen[k] for k in p.tolist()], float)
    _, vote, trait = parts(p)
    truth = trait[:, 1] == 2
    chance, (yes, _) = chances(p, count), expectation_maximisation(vote, count)
    wrong = [(count * ((c >= 0.5) != truth)).sum() / count.sum() for c in (chance, yes)]
    assert wrong[0] < 0.01 < wrong[1]


def test_long_local_parts_and_linear_wider_rules():
    name = "x" * 300
    assert [c[:3] for c in candidates(f"{name} [at] host [dot] org")] == [(0, 0, 320)]
    for text in ("a" * 300_000, "a." * 150_000, "1-" * 150_000, "(at)" * 50_000, "token=" * 50_000):
        candidates(text)
