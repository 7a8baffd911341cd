import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.llm.license_scan import BASE, evaluate, license_scan, postfix, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = ["MIT", "License", "mit", "license", " ", ",", "\n", "Apache", "general", "Public", "licenses", "é", "-", "mit-license"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map(" ".join))
def test_base_as_by_hand(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    places = [
        (k, label)
        for k in range(len(words))
        for phrase, label in BASE.items()
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    got = scan(text.encode(), frozenset())
    assert got[0] == len(words)
    assert got[1] == len(places)
    assert got[2] == min((k for k, _ in places), default=None)
    assert got[3] == max((k for k, _ in places), default=None)
    assert got[4] == ",".join(sorted({x for _, x in places}))
    assert 0 <= got[6] <= 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", "MIT"),
        ("MIT OR Apache-2.0 AND ISC", "MIT Apache-2.0 ISC and or"),
        ("(MIT OR Apache-2.0) AND ISC", "MIT Apache-2.0 or ISC and"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", "GPL-2.0-only Classpath-exception-2.0 with MIT or"),
        ("MIT */", "MIT"),
        ("OR MIT", None),
        ("(MIT", None),
        ("MIT AND", None),
        ("", None),
    ],
)
def test_postfix(text, want):
    assert postfix(text) == (want.split() if want else None)


def test_evaluate():
    allowed = frozenset({"mit", "isc"})
    for text, ok in (("MIT", True), ("GPL-3.0 OR MIT", True), ("GPL-3.0 AND MIT", False), ("MIT WITH x", True)):
        assert evaluate(postfix(text), allowed)[0] is ok


def test_rows(spark):
    rows = [
        (1, "// SPDX-License-Identifier: MIT OR GPL-3.0\nint x;"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, None),
        (4, "GNU General Public License, version 3. MIT License"),
    ]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].permitted) == ("gpl-3.0,mit", "", True)
    assert got[1].expressions == ["MIT GPL-3.0 or"]
    assert (got[2].labels, got[2].first_word) == ("apache,apache-2.0", 3)
    assert (got[3].n_words, got[3].score, got[3].first_word) == (0, 0.0, None)
    assert (got[4].base_labels, got[4].first_word, got[4].last_word) == ("gpl,mit", 1, 6)


def test_long_texts_stay_linear():
    import time

    from inkveil.llm.license_scan import PERMITTED, scan

    def took(size):
        text = b"mit license " * (size // 12)
        begin = time.process_time()
        out = scan(text, PERMITTED)
        assert out[1] == size // 12 and out[2] == 0 and out[3] == 2 * (size // 12) - 2
        return time.process_time() - begin

    took(10_000)
    small = took(1_000_000)
    assert took(8_000_000) < 24 * small + 1
