"""Entities: which spans mean the same person, company or address, and what each becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import names as N
from inkveil.functions import replace as R
from inkveil.functions.arrays import let
from inkveil.functions.replace import first_word, is_full_name, normal_key, person_key
from inkveil.model import DEFAULT_ACTIONS, REMOVED
from inkveil.operators.numbering import number_within

MENTION = ["start", "pii_type", "rule", "value"]


def entity_key(pii_type: Column, value: Column) -> Column:
    """Persons: first and last word; other types: lower case, blanks squeezed."""
    return F.when(pii_type == "person_name", person_key(value)).otherwise(normal_key(value))


def resolved_keys(items: Column, emit) -> Column:
    """``emit(item, entity key, person)`` for each item of a document's array, in order.

    A bare first name, a bare or a titled surname has the key of the person it means;
    ``person`` is that person's entry, null for other types.
    """

    def over(tables: Column) -> Column:
        def item(p: Column, i: Column) -> Column:
            person = F.when(p["pii_type"] == "person_name", R.resolved_person(p, tables))
            return let(person, lambda e: emit(p, F.coalesce(e["key"], normal_key(p["value"])), e, i))

        return F.transform(items, item)

    return let(let(R.person_entities(items), R.person_tables), over)


def mention_rows(
    spans: DataFrame, actions: dict | None = None, salt: str = "", id_col: str = "doc_id"
) -> DataFrame:
    """One row per span: ``(id, start, pii_type, rule, value, entity_key, num, replacement)``.

    Input is span rows (no text). The spans of a document meet in one array, as
    many as its text had, where the functions that replace in the row resolve
    them: keys, numbers and replacements are those of the sanitized text. ``num``
    numbers persons of one first name.
    """
    actions = DEFAULT_ACTIONS if actions is None else actions
    together = F.sort_array(F.collect_list(F.struct(*MENTION)))
    docs = spans.groupBy(id_col).agg(together.alias("_items"))

    # Step by step, as one expression would be too deep for the analyzer.
    applied = docs.withColumn("_applied", R.applied_pieces(F.col("_items"), actions, salt, F.col(id_col).cast("string")))

    def mentions(x: Column) -> Column:
        return resolved_keys(x["items"], lambda p, key, e, i: F.struct(
            *[p[c].alias(c) for c in MENTION],
            key.alias("entity_key"),
            e["num"].cast("int").alias("num"),
            F.get(x["applied"], i)["replacement"].alias("replacement"),
        ))

    both = F.struct(F.col("_items").alias("items"), F.col("_applied").alias("applied"))
    found = F.filter(let(both, mentions), lambda m: m.isNotNull())
    return applied.select(id_col, F.explode(found).alias("m")).select(id_col, "m.*")


def entity_map(
    spans: DataFrame, scope: str = "document", id_col: str = "doc_id", actions: dict | None = None, salt: str = ""
) -> DataFrame:
    """One row per entity: number, first position, number of mentions and what it becomes.

    ``(id, pii_type, entity_key, ord, first_start, mentions, replacement)``; ``ord``
    counts the entities of a type by first appearance. Everything behind the first
    shuffle (span rows, by document) stays where it is.

    ``scope='corpus'`` maps the entities of all documents together: ``(pii_type, entity_key,
    ord, first_doc, first_start, mentions, replacement)``. Mentions are resolved within
    their document first. Aggregation is partial before the shuffle, so a name that
    fills a third of the corpus costs one row per task; see :func:`corpus_replacements`.
    """
    mentions = mention_rows(spans, actions, salt, id_col)
    if scope == "corpus":
        return corpus_map(mentions, DEFAULT_ACTIONS if actions is None else actions, salt, id_col)
    found = mentions.groupBy(id_col, "pii_type", "entity_key").agg(
        F.min("start").alias("first_start"),
        F.count("*").alias("mentions"),
        F.min_by("replacement", "start").alias("replacement"),
    )
    order = Window.partitionBy(id_col, "pii_type").orderBy("first_start")
    return found.select(
        id_col, "pii_type", "entity_key", F.row_number().over(order).cast("long").alias("ord"), "first_start", "mentions", "replacement"
    )


def corpus_map(mentions: DataFrame, actions: dict, salt: str, id_col: str) -> DataFrame:
    """The corpus-wide map of mention rows; see :func:`entity_map`."""
    first = F.struct(F.col(id_col), "start")
    found = mentions.groupBy("pii_type", "entity_key").agg(
        F.min(first).alias("first"),
        F.count("*").alias("mentions"),
        F.min_by(F.struct("value", "rule", "replacement"), first).alias("shown"),
        # How a person is shown comes from the first mention by full name.
        F.min_by("value", F.when(F.instr("value", " ") > 0, first)).alias("full"),
    )
    found = found.select(
        "pii_type", "entity_key", F.col(f"first.{id_col}").alias("first_doc"), F.col("first.start").alias("first_start"),
        "mentions", "shown", F.coalesce("full", "shown.value").alias("full"),
    )
    numbered = number_within(found, ["pii_type"], ["first_doc", "first_start", "pii_type", "entity_key"], "ord")
    return corpus_replacements(numbered, actions, salt).select(
        "pii_type", "entity_key", "ord", "first_doc", "first_start", "mentions", "replacement"
    )


def corpus_replacements(found: DataFrame, actions: dict, salt: str) -> DataFrame:
    """Add ``replacement``, one for each entity of the corpus.

    Persons under keep_part are numbered per first name over all documents. Invented
    names of persons and companies go by ``ord`` through the pairs of the pool that
    nobody has, then through all pairs with a number between, so that no two entities
    share one. Of the rest the replacement depends on the value only.
    """
    person, company = actions.get("person_name"), actions.get("company")
    parts = [found.where(~F.col("pii_type").isin("person_name", "company")).withColumn("replacement", F.col("shown.replacement"))]
    for kind, action, heads, tails in (
        ("person_name", person, N.INVENTED_FIRST, N.INVENTED_LAST),
        ("company", company, N.INVENTED_COMPANY_HEAD, N.INVENTED_COMPANY_TAIL),
    ):
        mine = found.where(F.col("pii_type") == kind)
        if action == "invent":
            mine = mine.withColumn("replacement", pool_name(mine, heads, tails, salt))
        elif kind == "person_name" and action == "keep_part":
            lone = R.by_surname(F.col("shown.rule")) & ~is_full_name(F.col("entity_key"))
            mine = number_within(
                mine.withColumn("_first", first_word(F.col("entity_key"))), ["_first"],
                ["first_doc", "first_start", "entity_key"], "_num",
            )
            kept = F.concat_ws(" ", first_word(F.trim("full")), F.col("_num").cast("string"))
            mine = mine.withColumn("replacement", F.when(lone, REMOVED[kind]).otherwise(kept)).drop("_first", "_num")
        else:
            mine = mine.withColumn("replacement", F.col("shown.replacement"))
        parts.append(mine)
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def pool_name(entities: DataFrame, heads: list[str], tails: list[str], salt: str) -> Column:
    """The pool's name number ``ord``: pairs in a salted order, those that are an entity's key left out."""
    spark = entities.sparkSession
    pairs = spark.createDataFrame([(f"{h} {t}",) for h in heads for t in tails], "name string")
    # Not more rows than the pool has pairs.
    taken = {r.key for r in pairs.select("name", F.lower("name").alias("key")).join(
        entities.select(F.col("entity_key").alias("key")), "key", "left_semi").select("key").collect()}
    names = [f"{h} {t}" for h in heads for t in tails]
    free = [n for n in names if n.lower() not in taken]

    def salted(some: list[str]) -> Column:
        """In an order that depends on the salt; of no names an empty array."""
        listed = F.array(*[F.struct(F.md5(F.concat(F.lit(salt), F.lit(n))).alias("h"), F.lit(n).alias("n")) for n in some])
        return F.transform(F.sort_array(listed), lambda x: x["n"]) if some else F.array().cast("array<string>")

    k = F.col("ord") - 1
    again = k - len(free)
    pair = F.get(salted(names), (again % len(names)).cast("int"))
    number = (F.floor(again / len(names)) + 2).cast("string")
    numbered = F.concat_ws(" ", F.substring_index(pair, " ", 1), number, F.substring_index(pair, " ", -1))
    return F.when(k < len(free), F.get(salted(free), k.cast("int"))).otherwise(numbered)


def number_entities(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number the persons of each document per first name, as replacing does.

    ``(id, entity_key, first_name, first_start, mentions, num)``: a bare name or a titled
    surname is a mention of the person it means and gets no number of its own. The spans
    are shuffled once, by document.
    """
    persons = mention_rows(spans.where(F.col("pii_type") == "person_name"), {}, "", id_col)
    return (
        persons.groupBy(id_col, "entity_key")
        .agg(F.min("start").alias("first_start"), F.count("*").alias("mentions"), F.min("num").alias("num"))
        .select(id_col, "entity_key", first_word(F.col("entity_key")).alias("first_name"), "first_start", "mentions", "num")
    )
