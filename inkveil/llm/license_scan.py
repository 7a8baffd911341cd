"""Licences in texts: Aho-Corasick over words for names, notices and tags; shunting-yard for expressions.

A text is brought to its words with one space around each, so that an automaton over
characters finds phrases of whole words only, all of them in one pass. Behind an
identifier tag stands an expression of licence ids, ``and``, ``or``, ``with`` and
brackets, which is parsed and evaluated against the ids that may be used.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.llm.common import batch_of, id_and_text, text_batches

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TAG = "spdx license identifier"
# Label, weight as evidence, phrase: names weigh less than notices.
NOTICES = [
    ("mit", 0.8, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 0.6, "released under the mit license"),
    ("mit", 0.6, "licensed under the mit license"),
    ("apache-2.0", 0.7, "apache license version 2 0"),
    ("apache-2.0", 0.7, "apache 2 0 license"),
    ("gpl-2.0", 0.7, "gnu general public license version 2"),
    ("gpl-3.0", 0.7, "gnu general public license version 3"),
    ("agpl", 0.7, "gnu affero general public license"),
    ("lgpl", 0.7, "gnu lesser general public license"),
    ("mpl-2.0", 0.7, "mozilla public license version 2 0"),
    ("bsd", 0.8, "redistribution and use in source and binary forms with or without modification"),
    ("bsd", 0.5, "bsd license"),
    ("isc", 0.5, "isc license"),
    ("cc0", 0.6, "cc0 1 0"),
    ("cc-by-4.0", 0.6, "cc by 4 0"),
    ("cc-by-sa-4.0", 0.6, "cc by sa 4 0"),
    ("cc-by-nc-4.0", 0.6, "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", 0.6, "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", 0.6, "cc by nd 4 0"),
    ("proprietary", 0.4, "all rights reserved"),
    ("public-domain", 0.5, "released into the public domain"),
]
NAME_WEIGHT, TAG_WEIGHT = 0.5, 0.9
PERMITTED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc cc0-1.0 cc-by-4.0 unlicense zlib".split())

LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
EXPRESSION = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*", re.IGNORECASE | re.ASCII)
BINDS = {"or": 1, "and": 2, "with": 3}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """What each phrase says: ``(is base, label, weight, its length, is a tag)``."""
    says: dict[str, list] = {}
    for phrase, label in BASE.items():
        says.setdefault(f" {phrase} ", []).append((True, label, NAME_WEIGHT, len(phrase) + 2))
    for label, weight, phrase in NOTICES:
        says.setdefault(f" {phrase} ", []).append((False, label, weight, len(phrase) + 2))
    says.setdefault(f" {TAG} ", []).append((False, None, TAG_WEIGHT, len(TAG) + 2))
    out = ahocorasick.Automaton()
    for phrase, meaning in says.items():
        out.add_word(phrase, meaning)
    out.make_automaton()
    return out


def postfix(text: str) -> list[str] | None:
    """An expression in postfix order (shunting-yard); operators come lower-case.

    Reading ends where the expression can't go on, as at a comment's end. Null if what
    was read is no expression.
    """
    out, stack, operand = [], [], False
    for token in TOKEN.findall(text):
        t = token.lower()
        if t in BINDS:
            if not operand:
                return None
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            stack.append(t)
        elif t == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: list[str], permitted: frozenset[str]) -> tuple[bool, set[str]]:
    """Whether a postfix expression allows use under ``permitted`` ids, and the licence ids in it.

    ``or`` leaves a choice, ``and`` asks for both, ``with`` adds an exception, which
    changes nothing for its licence.
    """
    stack: list[tuple[bool, set[str]]] = []
    for t in expression:
        if t in BINDS:
            (b, ids_b), (a, ids_a) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((a, ids_a))
            else:
                stack.append((a or b if t == "or" else a and b, ids_a | ids_b))
        else:
            stack.append((t.lower() in permitted, {t.lower()}))
    return stack[0]


def scan(text: bytes, permitted: frozenset[str]) -> tuple:
    """One row of :func:`license_scan` but for the id."""
    words = text.translate(LOWER_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # word k stands behind blank k
    starts, base, labels, weights, tagged = [], set(), set(), {}, False
    for end, meaning in automaton().iter(line.decode("latin-1")):
        for is_base, label, weight, size in meaning:
            if is_base:
                starts.append(end + 1 - size)
                base.add(label)
            if label is None:
                tagged = True
            else:
                labels.add(label)
                weights[label] = max(weight, weights.get(label, 0))
    starts = np.searchsorted(blanks, starts).tolist()
    expressions, allowed = [], None
    for found in EXPRESSION.findall(text.decode()) if tagged else ():
        parsed = postfix(found)
        if parsed:
            ok, ids = evaluate(parsed, permitted)
            expressions.append(" ".join(parsed))
            allowed = ok if allowed is None else allowed and ok
            labels |= ids
            weights |= dict.fromkeys(ids, TAG_WEIGHT)
    doubt = 1.0
    for w in sorted(weights.values()):
        doubt *= 1 - w
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        1 - doubt,
        expressions,
        allowed,
    )


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("expressions", pa.list_(pa.string())),
        ("permitted", pa.bool_()),
    ]
)


def license_scan(
    docs: DataFrame, permitted: frozenset[str] = PERMITTED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: words, base places, labels, score, tagged expressions and their verdict.

    ``score`` says how sure a licence is stated: one less the product of the doubts of
    all labels. ``expressions`` are postfix; ``permitted`` is null without one, else
    whether all allow use under the given ids. Null and empty texts have no words, no
    labels (empty strings) and score 0; malformed expressions are passed over; null ids
    stay null, repeated rows come out as often as they come in, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            rows = [(i, *scan(t, permitted)) for i, t in zip(ids, texts, strict=True)]
            yield batch_of(SCHEMA, *map(list, zip(*rows, strict=True)))

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double, expressions array<string>, permitted boolean",
    )
