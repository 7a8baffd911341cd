"""Detection: spans of personal data in a text column.

Every function is narrow (no shuffle) unless a gazetteer too long for one
pattern is given; see :func:`gazetteer_words`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import marks as M
from inkveil.functions import patterns as P
from inkveil.functions.arrays import built_once, let, scan, words
from inkveil.model import PII_TYPES, SPAN_TYPE
from inkveil.operators.gazetteer import text_words, with_names

# Gazetteers up to this size go into the expression itself.
INLINE_BYTES = 256 * 1024


def span_rows(df: DataFrame, spans: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per span; the text itself is not carried along.

    The array is filtered inside ``explode``: of a bare one the optimizer
    would test the size first, and so compute it twice.
    """
    return (
        df.select(id_col, F.explode(F.filter(spans, lambda s: s.isNotNull())).alias("s"))
        .select(id_col, "s.pii_type", "s.rule", "s.start", "s.end", "s.value", "s.prio")
    )


def _spans(marked: Column) -> Column:
    """The spans of a marked text; null, so no row, without a mark."""
    return let(marked, lambda m: F.when(m.contains(P.OPEN), M.piece_spans(M.pieces(m))))


def _detect(df: DataFrame, marked: Column, types: Iterable[str], id_col: str) -> DataFrame:
    found = span_rows(df, _spans(marked), id_col)
    return found.where(F.col("pii_type").isin(*types))


def _detect_rules(df: DataFrame, rules: list[P.Rule], id_col: str, text_col: str) -> DataFrame:
    marked = M.by_line(M.protect(F.col(text_col)), lambda line: M.mark_all(line, rules))
    return span_rows(df, _spans(marked), id_col)


def detect_email(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _detect_rules(df, [P.EMAIL], id_col, text_col)


def detect_phone(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _detect_rules(df, [P.PHONE], id_col, text_col)


def detect_address(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _detect_rules(df, [P.STREET, P.PO_BOX, P.CITY_ZIP], id_col, text_col)


def detect_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _detect_rules(df, [P.SSN, P.CODED_ID, P.CUED_ID], id_col, text_col)


def detect_dob(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _detect_rules(df, [P.DOB, P.AGE_DOB, P.AGE], id_col, text_col)


def passes_luhn(value: Column) -> Column:
    """Check digit test of card numbers, separators ignored."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def total(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            n = F.substring(d, i + 1, F.lit(1)).cast("int") * (i % 2 + 1)
            return acc + F.when(n > 9, n - 9).otherwise(n)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step)

    return let(digits, lambda d: F.when(F.length(d) > 0, total(d) % 10 == 0).otherwise(False))


def detect_financial_numbers(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", luhn: bool = False
) -> DataFrame:
    """IBANs, card numbers and numbers after an account cue; ``luhn`` drops cards that fail it."""
    found = _detect_rules(df, [P.IBAN, P.CARD, P.ACCOUNT], id_col, text_col)
    return found.where((F.col("rule") != P.CARD.name) | passes_luhn(F.col("value"))) if luhn else found


def detect_company(
    df: DataFrame, gazetteer: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Company names by legal form and list; ``gazetteer`` (column ``name``) adds more."""
    words = None
    if gazetteer is not None:
        df, words = gazetteer_words(df, gazetteer, text_col, "_company_words")
    return _detect(df, M.marked(F.col(text_col), ["company"], companies=words), ["company"], id_col)


def detect_person(
    df: DataFrame, gazetteer: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Person names by cue and first-name list; ``gazetteer`` (column ``name``) adds first names.

    Company names are marked first, so they are never taken for persons.
    """
    words = None
    if gazetteer is not None:
        df, words = gazetteer_words(df, gazetteer, text_col, "_first_name_words")
    marked = M.marked(F.col(text_col), ["person_name"], first_names=words)
    return _detect(df, marked, ["person_name"], id_col)


def detect_personal_amounts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Money amounts in a sentence or line that names a person."""
    marked = M.marked(F.col(text_col), ["person_name", "financial"])
    found = _detect(df, marked, ["financial"], id_col)
    return found.where(F.col("rule") == P.AMOUNT.name)


def gazetteer_words(df: DataFrame, gazetteer: DataFrame, text_col: str, out_col: str) -> tuple[DataFrame, Column]:
    """The gazetteer names to look for in each row, as a regex alternation.

    A name is looked for where all its words may stand; so any script, any case and
    any number of words will do, and what is found does not depend on the length of the
    list. A list of up to ``INLINE_BYTES`` (its size is checked) stands in the expression,
    under the first word of each name, and no row is shuffled. A longer one is
    an index by the rarest word; see :mod:`inkveil.operators.gazetteer`.
    """
    first = F.regexp_extract("name", r"([\p{L}\p{N}_]+)", 1)
    given = gazetteer.select(F.trim("name").alias("name")).select("name", first.alias("first")).where(F.col("first") != "")
    names = given.distinct()
    bytes_of = F.sum(F.octet_length("name") + F.octet_length("first"))
    # An estimate first, as names by the million need no shuffle to be told from a short list.
    size, n, distinct = given.agg(bytes_of, F.count("*"), F.approx_count_distinct("name")).first()
    if not size:
        return df, F.lit(None).cast("string")
    if size * distinct <= 2 * n * INLINE_BYTES:
        size = names.agg(bytes_of).first()[0]

    def pattern(found: Column) -> Column:
        # Longer names first, so that a name inside another does not win.
        quoted = F.transform(found, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E")))
        return F.when(F.size(found) > 0, F.array_join(quoted, "|"))

    if size <= INLINE_BYTES:
        listed = sorted(names.collect(), key=lambda r: (-len(r.name), r.name))
        all_names, firsts = words(r.name for r in listed), words(r.first for r in listed)
        tokens = text_words(F.col(text_col))
        return df, let(F.array_intersect(tokens, words(sorted({r.first for r in listed}))), lambda seen: F.when(
            F.size(seen) > 0,
            pattern(F.filter(all_names, lambda n, i: F.array_contains(seen, F.get(firsts, i)))),
        ))

    return with_names(df, given.select("name"), text_col, out_col), pattern(F.col(out_col))


def active_types(actions: dict) -> list[str]:
    """The types to detect: those with an action.

    A fixed action that changes nothing (company, keep_part) is left out; the
    company rules run anyway wherever persons are looked for.
    """
    return [t for t in PII_TYPES if t in actions and (t, actions[t]) != ("company", "keep_part")]


def detect_all(df: DataFrame, actions: dict, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """Mark every type that has an action and add the pieces column, in one pass over the text.

    ``actions`` maps a type to a fixed action or to a column.
    """
    return detect_types(df, active_types(actions), text_col, out_col)


def detect_types(df: DataFrame, types: Iterable[str], text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """:func:`detect_all` for the types named, those that an action leaves as they are too."""
    return df.withColumn(out_col, pieces_of(text_col, tuple(types)))


@built_once
def pieces_of(text_col: str, types: tuple[str, ...]) -> Column:
    return M.pieces(M.marked(F.col(text_col), types))


def resolve_overlaps(spans: Column) -> Column:
    """One span per stretch of text, out of candidate spans of any detectors.

    Persons that overlap a company go first; then spans are taken greedily by
    start, longer first, lower ``prio`` first.
    """
    fields = ["pii_type", "rule", "start", "end", "value", "prio"]

    def sorted_spans(s: Column) -> Column:
        keyed = F.transform(s, lambda x: F.struct(
            x["start"].alias("a"), (-(x["end"] - x["start"])).alias("b"), x["prio"].alias("c"), x.alias("span")
        ))
        return F.transform(F.sort_array(keyed), lambda x: x["span"])

    def greedy(s: Column) -> Column:
        kept = scan(
            s,
            F.lit(-1),
            lambda end, x: F.when(x["start"] >= end, x["end"]).otherwise(end),
            lambda end, x: F.when(
                x["start"] >= end, F.array(F.struct(*[x[f].alias(f) for f in fields]))
            ).otherwise(F.array().cast(f"array<{SPAN_TYPE}>")),
            SPAN_TYPE,
        )
        return kept

    flagged = f"struct<span:{SPAN_TYPE},hit:boolean>"

    def sweep(items: Column, zero: Column, reach, meets) -> Column:
        """Flag persons that meet what the companies before them in ``items`` reach."""
        is_company = lambda x: x["span"]["pii_type"] == "company"
        return scan(
            items,
            zero,
            lambda far, x: F.when(is_company(x), reach(far, x["span"])).otherwise(far),
            lambda far, x: F.array(F.struct(
                x["span"].alias("span"),
                (x["hit"] | ((x["span"]["pii_type"] == "person_name") & meets(far, x["span"]))).alias("hit"),
            )),
            flagged,
        )

    def without_shielded(s: Column) -> Column:
        # By start, companies first: the farthest end so far; then from the right: the nearest start.
        keyed = F.transform(s, lambda x: F.struct(
            x["start"].alias("a"), (x["pii_type"] != "company").alias("b"), x.alias("span"), F.lit(False).alias("hit")
        ))
        items = F.transform(F.sort_array(keyed), lambda x: F.struct(x["span"].alias("span"), x["hit"].alias("hit")))
        left = let(items, lambda i: sweep(
            i, F.lit(-1), lambda far, c: F.greatest(far, c["end"]), lambda far, p: far > p["start"]
        ))
        both = let(F.reverse(left), lambda i: sweep(
            i, F.lit(2**31 - 1), lambda far, c: F.least(far, c["start"]), lambda far, p: far < p["end"]
        ))
        kept = F.transform(F.filter(both, lambda x: ~x["hit"]), lambda x: x["span"])
        return F.when(F.exists(s, lambda x: x["pii_type"] == "company"), kept).otherwise(s)

    return let(spans, lambda s: let(sorted_spans(without_shielded(s)), greedy))
