"""Marking: every detector wraps its matches, one split turns the text into pieces.

``OPEN code value CLOSE`` stands around each match, where OPEN and CLOSE are
control characters (texts that hold them anyway are escaped first, so any text
survives). A later rule skips what is already marked, so each character belongs
to at most one span. The work is one regex pass per rule and stays linear in
the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import patterns as P
from inkveil.functions.arrays import contains_any, let, lookup, lookup_table, scan, words
from inkveil.functions.names import COMMON_WORDS
from inkveil.functions.patterns import CLOSE, OPEN, Rule
from inkveil.model import SPAN_TYPE

ESC = "\x03"
CODE_LEN = 2
MARKED = f"{OPEN}[^{CLOSE}]*+{CLOSE}"
# A sentence end that is not personal data.
SENTENCE = ".."
# Any code of a person rule, as it stands after OPEN.
PERSON_CODES = [r.code for r in P.RULES if r.pii_type == "person_name"]
PERSON_MARK = f"{OPEN}(?:{'|'.join(PERSON_CODES)})"
# A company that ends in a legal form, its full stop and no sign of a new sentence.
FORM_IN_MARK = f"{OPEN}(?:{'|'.join(r.code for r in P.RULES if r.pii_type == 'company')})[^{CLOSE}]*(?:Inc|Ltd|Corp|Co){CLOSE}\\.[ \\t]+(?![\\p{{Lu}}{OPEN}])"


def protect(text: Column) -> Column:
    """Escape the mark characters themselves, should a text hold them."""

    def escape(t: Column) -> Column:
        e = F.replace(t, F.lit(ESC), F.lit(ESC + "e"))
        e = F.replace(e, F.lit(OPEN), F.lit(ESC + "o"))
        return F.replace(e, F.lit(CLOSE), F.lit(ESC + "c"))

    return let(text, lambda t: F.when(contains_any(t, (OPEN, CLOSE, ESC)), escape(t)).otherwise(t))


def restore(text: Column) -> Column:
    """Undo :func:`protect`."""
    back = F.replace(text, F.lit(ESC + "c"), F.lit(CLOSE))
    back = F.replace(back, F.lit(ESC + "o"), F.lit(OPEN))
    return F.replace(back, F.lit(ESC + "e"), F.lit(ESC))


def mark_with(text: Column, rule: Rule, target: Column, first: Column | None = None) -> Column:
    """Mark matches of a pattern that is itself a column (one pattern per row)."""
    head = F.lit("") if first is None else F.concat(F.lit(f"(?=[{OPEN}"), first, F.lit("])"))
    pattern = F.concat(head, F.lit(f"(?:({MARKED})|("), F.lit(rule.cue), F.lit(")("), target, F.lit("))"))
    return _mark(text, rule, pattern)


def mark(text: Column, rule: Rule) -> Column:
    """Mark the matches of one rule in a (protected, maybe already marked) text."""
    pattern = f"(?=[{OPEN}{rule.first}])(?:({MARKED})|({rule.cue})({rule.target}))"
    gates = []
    if rule.hints:
        gates.append(lambda t: contains_any(t, rule.hints))
    if rule.gate:
        gates.append(lambda t: t.rlike(rule.gate))
    if not gates:
        return _mark(text, rule, F.lit(pattern))
    return let(text, lambda t: F.when(
        reduce(lambda a, b: a & b, [g(t) for g in gates]), _mark(t, rule, F.lit(pattern))
    ).otherwise(t))


def _mark(text: Column, rule: Rule, pattern: Column) -> Column:
    # A skipped mark leaves an empty new mark behind it, which is dropped again.
    wrapped = F.regexp_replace(text, pattern, F.lit(f"$1$2{OPEN}{rule.code}$3{CLOSE}"))
    return F.replace(wrapped, F.lit(f"{OPEN}{rule.code}{CLOSE}"), F.lit(""))


def mark_all(text: Column, rules: Iterable[Rule]) -> Column:
    for rule in rules:
        text = mark(text, rule)
    return text


def mark_gated(text: Column, rules: list[Rule], gate) -> Column:
    """Run ``rules`` only on texts for which ``gate(text)`` holds."""
    if not rules:
        return text
    return let(text, lambda t: F.when(gate(t), mark_all(t, rules)).otherwise(t))


def has_digits(text: Column) -> Column:
    return text.rlike("[0-9]")


def mark_table_columns(text: Column, types: Iterable[str]) -> Column:
    """Mark the cells of Markdown table columns whose header says what they hold.

    Tables are taken block by block (blocks are parted by an empty line), as
    each has its own header. Cells with a mark already keep it.
    """
    rules = [(r, h, need) for r, h, need in P.COLUMN_RULES if r.pii_type in types]
    if not rules:
        return text
    head = r"^(\n?\|[^\n]*\n\|[-|]+\|\n)"
    pipe = r"(?<!\\)\|"
    any_header = "(?:" + "|".join(h for _, h, _ in rules) + ")"

    def in_block(block: Column) -> Column:
        header = F.regexp_extract(block, head, 1)
        return let(header, lambda h: F.when(h == "", block).otherwise(let(columns(h), lambda at: F.when(
            F.size(at) == 0, block
        ).otherwise(F.concat(h, by_line(F.substring(block, F.length(h) + 1, F.length(block)), lambda x: in_row(x, at)))))))

    def columns(header: Column) -> Column:
        """Number of each column and code of its rule, for columns that have one."""
        cells = F.split(F.regexp_extract(header, r"\A\n?(\|[^\n]*)\n", 1), pipe)

        def code(c: Column) -> Column:
            out = None
            for rule, h, _ in rules:
                fits = c.rlike(rf"\A *(?:{h}) *\z")
                out = F.when(fits, rule.code) if out is None else out.when(fits, rule.code)
            return out

        coded = F.transform(cells, lambda c, j: F.struct(j.alias("j"), code(c).alias("code")))
        return F.filter(coded, lambda x: x["code"].isNotNull())

    def marked_cell(c: Column, code: Column) -> Column:
        needs = F.lit(True)
        for rule, _, need in rules:
            if need:
                needs = F.when(code == rule.code, c.rlike(need)).otherwise(needs)
        start, stop = F.regexp_extract(c, r"\A( *)", 1), F.regexp_extract(c, r"( *)\z", 1)
        inside = F.concat(start, F.lit(OPEN), code, F.trim(c), F.lit(CLOSE), stop)
        return F.when((F.trim(c) != "") & ~c.contains(OPEN) & needs, inside).otherwise(c)

    def in_row(row: Column, at: Column) -> Column:
        # Only the columns with a rule are looked at; the rest of the row is put back as it is.
        def cells(parts: Column) -> Column:
            return let(
                F.map_from_entries(at),
                lambda codes: F.transform(parts, lambda c, j: let(
                    F.try_element_at(codes, j), lambda code: F.when(code.isNull(), c).otherwise(marked_cell(c, code))
                )),
            )

        return F.when(row.startswith("|"), F.array_join(cells(F.split(row, pipe)), "|")).otherwise(row)

    def over(t: Column) -> Column:
        blocks = F.split(t, "\n\n")
        return F.when(
            t.contains("\n|-") & t.rlike(rf"\| *{any_header} *\|[^\n]*\n\|-"),
            F.array_join(F.transform(blocks, in_block), "\n\n"),
        ).otherwise(t)

    return let(text, over)


def column_rule(name: str, types: Iterable[str]) -> tuple[Rule, str] | None:
    """The rule that a table column's name stands for, as a header would; and what a value must hold."""
    shown = re.sub(r"[_\s]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)).strip()
    for rule, header, need in P.COLUMN_RULES:
        if rule.pii_type in types and re.fullmatch(header, shown):
            return rule, need
    return None


def mark_short_names(text: Column) -> Column:
    """Mark bare first names and surnames of persons who are named in full (or by title) in the same text.

    The plain stretches are cut into capitalised words once; each word is looked up
    among the names, so the work grows with the words, not with names times text. A
    surname that is a common word, by a list or because the text has it in lower case,
    does not count at the start of a sentence or before another capitalised word; no surname
    counts behind one ("Nope Miller" is not the Miller of the text).
    """
    person = f"{OPEN}((?:{'|'.join(PERSON_CODES)})[^{CLOSE}]+){CLOSE}"
    word = rf"{P.NAME_LB}(\p{{Lu}}\p{{L}}*(?:['’-]\p{{L}}+)*){P.NAME_RB}"
    sentence_start = r"(?:[.!?:]['’\")\]]*\s+|\n\s*)['’\"(\[]*\z"
    first_code, last_code = OPEN + P.SHORT_PERSON.code, OPEN + P.SHORT_SURNAME.code

    def known_words(t: Column, names: Column) -> Column:
        """``(word, last, common)`` of the names, first names before surnames."""
        value = lambda n: F.substring(n, CODE_LEN + 1, F.length(n))
        full = F.transform(F.filter(names, lambda n: n.contains(" ")), value)
        titled = F.transform(
            F.filter(names, lambda n: n.startswith(P.HONORIFIC.code) & ~n.contains(" ")), value
        )

        def cased(given: Column) -> Column:
            """With the usual spelling of words in capitals."""
            return let(given, lambda parts: F.array_distinct(F.concat(parts, F.transform(
                F.filter(parts, lambda w: (F.length(w) > 1) & (w == F.upper(w))), lambda w: F.initcap(F.lower(w))
            ))))

        def both(f: Column) -> Column:
            firsts = cased(F.transform(f, lambda v: F.substring_index(v, " ", 1)))
            lasts = cased(F.concat(F.transform(f, lambda v: F.substring_index(v, " ", -1)), titled))
            return let(firsts, lambda x: F.struct(x.alias("firsts"), F.array_except(lasts, x).alias("lasts")))

        def entries(x: Column) -> Column:
            lower = F.concat(words(COMMON_WORDS), F.split(t, r"[^\p{Ll}]+"))
            # The few surnames are hashed, not the words of the text.
            common = F.array_intersect(lower, F.transform(x["lasts"], F.lower))
            return let(lookup_table(common, lambda c: c), lambda c: F.concat(
                F.transform(x["firsts"], lambda w: entry(w, F.lit(False), F.lit(False))),
                F.transform(x["lasts"], lambda w: entry(w, F.lit(True), let(
                    F.lower(w), lambda k: lookup(c, lambda y: y, k)
                ).isNotNull())),
            ))

        return let(let(full, both), entries)

    def entry(word_: Column, last: Column, common: Column) -> Column:
        return F.struct(word_.alias("word"), last.alias("last"), common.alias("common"))

    def in_plain(part: Column, known: Column, at: Column) -> Column:
        """A stretch between marks; ``at`` is its place, 0 for the start of the text."""
        cut = F.split(F.regexp_replace(part, word, f"{OPEN}$1{OPEN}"), OPEN)

        def over(pieces_: Column) -> Column:
            def bare(e: Column, i: Column) -> Column:
                def starts(k: Column) -> Column:
                    before = F.get(pieces_, k - 1)
                    return before.rlike(sentence_start) | ((k == 1) & (at == 0) & (F.trim(before) == ""))

                # Behind a capitalised word that starts no sentence it is the surname of somebody else.
                other = e["last"] & (i >= 3) & (F.get(pieces_, i - 1) == " ") & ~starts(i - 2)
                follows = (F.get(pieces_, i + 1) == " ") & F.get(pieces_, i + 2).isNotNull()
                return e["word"].isNotNull() & ~(e["common"] & (starts(i) | follows)) & ~other

            def piece(w: Column, i: Column) -> Column:
                # Of a genitive the name before it counts; of a compound that is no name, the first part if a first name.
                def marked_part(e: Column, name: Column) -> Column:
                    code = F.when(e["last"], last_code).otherwise(first_code)
                    return F.concat(code, name, F.lit(CLOSE), F.substring(w, F.length(name) + 1, F.length(w)))

                def by_part(x: Column) -> Column:
                    base, lead = x["base"], x["lead"]
                    return let(F.when(base != w, find(known, base)), lambda e: F.when(bare(e, i), marked_part(e, base)).otherwise(
                        let(find(known, lead), lambda e: F.when(bare(e, i) & ~e["last"], marked_part(e, lead)).otherwise(w))
                    ))

                parts = F.struct(
                    F.regexp_replace(w, "['’]s$", "").alias("base"), F.regexp_extract(w, r"\A(\p{L}+)", 1).alias("lead")
                )
                compound = F.when(contains_any(w, ("'", "’", "-")), let(parts, by_part)).otherwise(w)
                return F.when(i % 2 == 0, w).otherwise(let(
                    find(known, w), lambda e: F.when(bare(e, i), marked_part(e, w)).otherwise(compound)
                ))

            return F.array_join(F.transform(pieces_, piece), "")

        return let(cut, over)

    def find(known: Column, w: Column) -> Column:
        return lookup(known, lambda x: x["word"], w)

    def over(t: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(t, F.lit(person), 1))
        # Between marks: plain text at even places, a mark's code and value at odd ones.
        parts = F.split(t, f"[{OPEN}{CLOSE}]")
        table = lookup_table(let(names, lambda n: known_words(t, n)), lambda x: x["word"])
        marked_ = let(table, lambda known: F.array_join(F.transform(
            parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(OPEN), p, F.lit(CLOSE))).otherwise(in_plain(p, known, i))
        ), ""))
        return F.when(t.contains(OPEN) & t.rlike(PERSON_MARK), marked_).otherwise(t)

    return let(text, over)


def mark_personal_amounts(text: Column) -> Column:
    """Mark money amounts standing in a sentence or line that names a person."""
    # A full stop after a title or a legal form does not end a sentence.
    end = F.lit(f"({FORM_IN_MARK}|{MARKED}|{P.LB}(?:Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Inc|Ltd|Corp|Co)\\.[ \\t]+)|([.!?][ \\t]+|\\n)")

    def over(t: Column) -> Column:
        ended = F.regexp_replace(t, end, F.lit(f"$1{OPEN}{SENTENCE}$2{CLOSE}"))
        ended = F.replace(ended, F.lit(f"{OPEN}{SENTENCE}{CLOSE}"), F.lit(""))
        sentences = F.transform(
            F.split(ended, f"{OPEN}\\.\\."),
            lambda s: F.when(s.rlike(PERSON_MARK), mark(s, P.AMOUNT)).otherwise(s),
        )
        return F.when(
            t.contains(OPEN) & t.rlike(PERSON_MARK) & t.rlike(P.AMOUNT_GATE),
            F.array_join(sentences, OPEN + SENTENCE),
        ).otherwise(t)

    return let(text, over)


def marked(
    text: Column,
    types: Iterable[str],
    first_names: Column | None = None,
    companies: Column | None = None,
) -> Column:
    """Protect ``text`` and mark every span of the wanted types.

    ``first_names`` / ``companies`` are optional per-row regex alternations
    from a gazetteer (null: none for this row).
    """
    types = set(types)
    names = "person_name" in types

    def in_line(line: Column) -> Column:
        out = mark(line, P.EMAIL) if "email" in types else line
        out = mark_gated(out, [r for r in P.DIGIT_RULES if r.pii_type in types], has_digits)
        if names or "company" in types:
            out = mark_all(out, P.COMPANY_RULES)
            if companies is not None:
                out = _mark_row_list(out, P.GAZETTEER_COMPANY, companies, P.NAME_LB, P.NAME_RB)
        if names:
            out = mark_all(out, P.PERSON_RULES)
            if first_names is not None:
                tail = f" (?:(?:{P.WORD}|{P.INITIAL}) )?{P.WORD}{P.NAME_RB}"
                out = _mark_row_list(out, P.GAZETTEER_PERSON, first_names, P.NAME_LB, tail)
        return out

    out = mark_table_columns(by_line(protect(text), in_line), types)
    if names:
        out = mark_short_names(out)
        if "financial" in types:
            out = mark_personal_amounts(out)
    return out


def marked_value(text: Column, types: Iterable[str], column: str) -> Column:
    """A value of a table column: marked whole where the column's name says what it holds, else by the rules."""
    types = set(types)
    found = column_rule(column, types)
    out = marked(text, types)
    if found is None:
        return out
    rule, need = found
    whole = F.concat(F.lit(OPEN + rule.code), protect(text), F.lit(CLOSE))
    fits = (F.trim(text) != "") & (text.rlike(need) if need else F.lit(True))
    return F.when(fits, whole).otherwise(out)


def by_line(text: Column, body) -> Column:
    """Apply ``body`` to each line: no rule looks beyond one, and most lines fail every gate."""
    return F.array_join(F.transform(F.split(text, "\n"), body), "\n")


def _mark_row_list(text: Column, rule: Rule, words: Column, before: str, after: str) -> Column:
    target = F.concat(F.lit(before + "(?:"), words, F.lit(")" + after))
    return let(
        F.struct(text.alias("t"), target.alias("p")),
        lambda x: F.when(x["p"].isNotNull(), mark_with(x["t"], rule, x["p"])).otherwise(x["t"]),
    )


def pieces(marked_text: Column) -> Column:
    """Split a marked text into ``ARRAY<STRUCT<pii_type, rule, value>>``.

    The values put together are the text; plain stretches have a null type.
    """
    types, names = words(r.pii_type for r in P.RULES), words(r.name for r in P.RULES)
    codes = ",".join(r.code for r in P.RULES)

    def piece(part: Column, i: Column) -> Column:
        def of(which: Column, value: Column) -> Column:
            return F.struct(
                F.get(types, which - 1).alias("pii_type"),
                F.get(names, which - 1).alias("rule"),
                F.when(part.contains(ESC), restore(value)).otherwise(value).alias("value"),
            )

        # 0 for a sentence end, which is plain text.
        code = F.find_in_set(F.substring(part, 1, CODE_LEN), F.lit(codes))
        value = F.substring(part, CODE_LEN + 1, F.length(part))
        return F.when(i % 2 == 0, of(F.lit(0), part)).otherwise(let(code, lambda which: of(which, value)))

    def over(m: Column) -> Column:
        parts = F.when(m.contains(OPEN), F.split(m, f"[{OPEN}{CLOSE}]")).otherwise(F.array(m))
        return F.when(m.isNotNull(), F.transform(parts, piece))

    return let(marked_text, over)


def piece_spans(items: Column) -> Column:
    """Typed pieces as spans with 0-based code-point offsets."""
    names = words(r.name for r in P.RULES)

    def emit(pos: Column, p: Column) -> Column:
        span = F.struct(
            p["pii_type"].alias("pii_type"),
            p["rule"].alias("rule"),
            pos.alias("start"),
            (pos + F.length(p["value"])).alias("end"),
            p["value"].alias("value"),
            F.array_position(names, p["rule"]).cast("int").alias("prio"),
        )
        return F.when(p["pii_type"].isNotNull(), F.array(span)).otherwise(
            F.array().cast(f"array<{SPAN_TYPE}>")
        )

    return scan(items, F.lit(0), lambda pos, p: pos + F.length(p["value"]), emit, SPAN_TYPE)


def text_of(items: Column) -> Column:
    """The text the pieces were cut from."""
    return F.array_join(F.transform(items, lambda p: p["value"]), "")

