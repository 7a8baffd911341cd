"""What a span becomes: one expression per legal (type, action) pair.

Invented values derive from a salted md5 of the original, so the same value
gives the same replacement anywhere without any state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import names as N
from inkveil.functions.arrays import let, lookup, lookup_table, words
from inkveil.functions.patterns import CITY, OTHER_CODE, STATES, STREET_WORDS, UNIT_FIRST, ZIP
from inkveil.model import REMOVED

REDACTED = "[REDACTED]"


def normal_key(value: Column) -> Column:
    """Lower case, blanks squeezed: the key of companies, addresses and the rest."""
    return F.trim(F.regexp_replace(F.lower(value), "[ \t]+", " "))


def hex_digit(digest: Column, i: Column) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(digest, i % 32 + 1, F.lit(1))) - 1


def hash_number(key: Column, salt: Column) -> Column:
    """A non-negative int from a salted md5."""
    return F.conv(F.substring(F.md5(F.concat(salt, key)), 1, 7), 16, 10).cast("int")


def pick(pool: list[str], n: Column) -> Column:
    return F.get(words(pool), (n % len(pool)).cast("int"))


def fake_digits(value: Column, salt: Column, keep: Column | int = 0) -> Column:
    """Every digit after the first ``keep`` characters becomes another digit.

    Separators, letters and length stay; a leading non-zero digit stays
    non-zero, so amounts keep their order of magnitude.
    """

    def over(x: Column) -> Column:
        v, digest, kept = x["v"], x["h"], x["k"]
        lead = F.length(F.regexp_extract(F.substring(v, kept + 1, F.length(v)), "^([^0-9]*)", 1)) + kept

        def char(c: Column, i: Column, first: Column) -> Column:
            h = hex_digit(digest, i)

            def moved(d: Column) -> Column:
                other = F.when((i == first) & (d > 0), F.lit(1) + (d + h % 8) % 9).otherwise((d + 1 + h % 9) % 10)
                return F.when(d >= 0, other.cast("string")).otherwise(c)

            return F.when(i >= kept, let(F.instr(F.lit("0123456789"), c) - 1, moved)).otherwise(c)

        chars = F.split(v, "")
        return let(lead, lambda first: F.array_join(F.transform(chars, lambda c, i: char(c, i, first)), ""))

    keep = F.lit(keep) if isinstance(keep, int) else keep
    whole = F.struct(
        value.alias("v"), F.md5(F.concat(salt, value)).alias("h"), keep.cast("int").alias("k")
    )
    return let(whole, lambda x: F.when(F.length(x["v"]) > 0, over(x)).otherwise(""))


# -- e-mail -----------------------------------------------------------------

def keep_email_domain(value: Column) -> Column:
    return F.concat(F.lit("[EMAIL_REDACTED]"), F.regexp_extract(value, "(@.*)$", 1))


# -- phone ------------------------------------------------------------------

# Country codes by the public numbering plan, for numbers written without separators.
SOLID_COUNTRY = (
    "^\\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
)
SEVEN_DIGITS = "^[0-9]{3}-[0-9]{4}$"


def phone_country(value: Column) -> Column:
    spaced = F.regexp_extract(value, "^\\+([0-9]{1,3})[ .(-]", 1)
    solid = F.regexp_extract(value, SOLID_COUNTRY, 1)
    return F.when(spaced != "", spaced).otherwise(solid)


def phone_prefix(value: Column) -> Column:
    """Country and area code as written, with the separators between them."""

    def over(v: Column) -> Column:
        spaced = F.regexp_extract(
            v, "^((?:\\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\\(0\\) ?[0-9]{1,4}[ .-]|\\([0-9]{1,4}\\)|[0-9]{1,4}[ .-]))", 1
        )
        solid = F.regexp_extract(v, SOLID_COUNTRY + "[0-9]{3}", 0)
        return (
            F.when(v.rlike(SEVEN_DIGITS), "")
            .when(spaced != "", spaced)
            .otherwise(solid)
        )

    return let(value, over)


def keep_phone_area(value: Column) -> Column:
    """``+CC (area) [REDACTED]``; without a country ``(area) [REDACTED]``."""

    def over(v: Column) -> Column:
        def parts(x: Column) -> Column:
            rest = F.substring(x["p"], F.length(x["c"]) + 2, F.length(x["p"]))
            after_country = F.when(x["c"] != "", rest).otherwise(F.regexp_replace(x["p"], "^1[ .-]", ""))
            area = F.regexp_replace(F.regexp_replace(after_country, "\\(0\\)", ""), "[^0-9]", "")
            return F.concat(
                F.when(x["c"] != "", F.concat(F.lit("+"), x["c"], F.lit(" "))).otherwise(""),
                F.when(area != "", F.concat(F.lit("("), area, F.lit(") "))).otherwise(""),
                F.lit(REDACTED),
            )

        return let(F.struct(phone_prefix(v).alias("p"), phone_country(v).alias("c")), parts)

    return let(value, over)


def invent_phone(value: Column, salt: Column) -> Column:
    return let(value, lambda v: fake_digits(v, salt, F.length(phone_prefix(v))))


# -- address ----------------------------------------------------------------

def invent_address(value: Column, salt: Column) -> Column:
    """Same shape: unit, number, street, town, state and code each replaced in place."""
    tail = f"({CITY})(,? )({STATES})((?: {ZIP})?)$"
    abroad = f"({CITY})(,? {OTHER_CODE})$"
    street = f"^((?:{UNIT_FIRST})?)([0-9]+[A-Za-z]?) (.+?) ((?:{STREET_WORDS})\\.?(?:,.*| (?:Apt|Suite|Unit).*)?)$"
    cities = [c for c, _ in N.INVENTED_CITIES]

    def over(x: Column) -> Column:
        v, h = x["v"], x["h"]

        def cut(other: Column) -> Column:
            town = F.when(other != "", other).otherwise(F.regexp_extract(v, tail, 0))
            return let(town, lambda t: F.struct(
                F.substring(v, F.lit(1), F.length(v) - F.length(t)).alias("f"), t.alias("t"), (other != "").alias("abroad")
            ))

        def rebuilt(y: Column) -> Column:
            f, t = y["f"], y["t"]

            def renamed(name: Column) -> Column:
                new_name = pick(N.INVENTED_STREETS, h)
                # Never the street it was.
                new_name = F.when(new_name == name, pick(N.INVENTED_STREETS, h + 1)).otherwise(new_name)
                return F.when(
                    name != "",
                    F.concat(
                        fake_digits(F.regexp_extract(f, street, 1), salt), fake_digits(F.regexp_extract(f, street, 2), salt),
                        F.lit(" "), new_name, F.lit(" "), F.regexp_extract(f, street, 4),
                    ),
                ).otherwise(fake_digits(f, salt))

            new_front = let(F.regexp_extract(f, street, 3), renamed)
            old_city = F.when(y["abroad"], F.regexp_extract(t, abroad, 1)).otherwise(F.regexp_extract(t, tail, 1))
            shift = F.when(pick(cities, h) == old_city, 1).otherwise(0)
            new_town = F.when(
                y["abroad"], F.concat(pick(cities, h + shift), fake_digits(F.regexp_extract(t, abroad, 2), salt))
            ).when(
                t != "",
                F.concat(
                    pick(cities, h + shift),
                    F.regexp_extract(t, tail, 2),
                    pick([s for _, s in N.INVENTED_CITIES], h + shift),
                    fake_digits(F.regexp_extract(t, tail, 4), salt),
                ),
            ).otherwise("")
            return F.concat(new_front, new_town)

        return let(let(F.regexp_extract(v, abroad, 0), cut), rebuilt)

    key = normal_key(value)
    return let(F.struct(value.alias("v"), hash_number(key, salt).alias("h")), over)


# -- date of birth ----------------------------------------------------------

# (shape, pattern of the date functions), tried in this order.
DATE_FORMATS = [
    ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    ("^(?:0[1-9]|1[0-2])/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"),
    ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"),
    ("^(?:[1-9]|1[0-2])/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    ("^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$", "dd.MM.yyyy"),
    ("^[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}$", "d.M.yyyy"),
    ("^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd-MM-yyyy"),
    ("^[A-Z][a-z]{3,8} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
    ("^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    ("^[A-Z][a-z]{3,8} [0-9]{1,2} [0-9]{4}$", "MMMM d yyyy"),
    ("^[0-9]{1,2} [A-Z][a-z]{3,8} [0-9]{4}$", "d MMMM yyyy"),
    ("^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$", "d MMM yyyy"),
]


def invent_birth_date(value: Column, salt: Column) -> Column:
    """Move the date by 1 to 730 days either way and write it in the same format.

    A date in none of the known formats keeps its shape with its year moved by
    one or two; a two-digit year likewise.
    """

    def over(x: Column) -> Column:
        v, h = x["v"], x["h"]
        days = (h % 730 + 1) * F.when(h % 2 == 0, 1).otherwise(-1)
        moved = None
        for shape, fmt in DATE_FORMATS:
            # Two shapes may fit (day or month first); the first that parses wins.
            parsed = F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(fmt)).cast("date"))
            one = F.date_format(F.date_add(parsed, days), fmt)
            moved = one if moved is None else F.coalesce(moved, one)
        return F.coalesce(moved, year_moved(v, h))

    def year_moved(v: Column, h: Column) -> Column:
        shift = h % 2 + 1
        year = F.regexp_extract(v, "([0-9]{4})$", 1)
        short = F.regexp_extract(v, "([0-9]{2})$", 1)
        first_year = F.regexp_extract(v, "^([0-9]{4})", 1)
        return (
            F.when(year != "", F.concat(F.regexp_replace(v, "[0-9]{4}$", ""), (year.cast("int") - shift).cast("string")))
            .when(first_year != "", F.concat((first_year.cast("int") - shift).cast("string"), F.substring(v, F.lit(5), F.length(v))))
            .otherwise(F.concat(
                F.regexp_replace(v, "[0-9]{2}$", ""),
                F.lpad(((short.cast("int") + 100 - shift) % 100).cast("string"), 2, "0"),
            ))
        )

    return let(F.struct(value.alias("v"), hash_number(value, salt).alias("h")), over)


# -- persons and companies: one replacement per entity of the document -------

def person_key(value: Column) -> Column:
    """First and last word, lower case; middle names do not matter."""

    def over(parts: Column) -> Column:
        first, last = F.element_at(parts, 1), F.element_at(parts, -1)
        return F.when(F.size(parts) > 1, F.concat_ws(" ", first, last)).otherwise(first)

    return let(F.split(normal_key(value), " "), over)


def first_word(key: Column) -> Column:
    return F.substring_index(key, " ", 1)


def last_word(key: Column) -> Column:
    return F.substring_index(key, " ", -1)


def is_full_name(key: Column) -> Column:
    return F.instr(key, " ") > 0


PERSON_ENTITIES = "array<struct<ord:int,key:string,first:string,num:int,shown:string>>"


def person_entities(items: Column) -> Column:
    """The persons of one document, by first appearance.

    ``ord`` counts persons, ``num`` counts those that share a first name. A
    bare name that is the first or last name of a fully named person is not a
    person of its own.
    """

    def own_keys(mentions: Column) -> Column:
        keys = F.array_distinct(F.transform(mentions, lambda m: m["key"]))

        def over(all_keys: Column) -> Column:
            full = F.filter(all_keys, is_full_name)
            known = F.concat(F.transform(full, first_word), F.transform(full, last_word))
            bare = F.filter(all_keys, lambda k: ~is_full_name(k))
            return F.array_except(all_keys, F.array_intersect(bare, known))

        return let(keys, over)

    def entries(mentions: Column) -> Column:
        return let(
            lookup_table(mentions, lambda m: m["key"]),
            lambda table: F.transform(own_keys(mentions), lambda k, i: F.struct(
                first_word(k).alias("first"),
                (i + 1).alias("ord"),
                k.alias("key"),
                lookup(table, lambda m: m["key"], k)["word"].alias("shown"),
            )),
        )

    def numbered(by_first_name: Column) -> Column:
        # Sorted by (first, ord): a person's number is the distance from the
        # first entry with the same first name.
        starts = F.filter(
            F.transform(by_first_name, lambda e, i: F.struct(e["first"].alias("first"), i.alias("i"))),
            lambda x: (x["i"] == 0) | (F.get(by_first_name, x["i"] - 1)["first"] != x["first"]),
        )
        return let(
            lookup_table(starts, lambda x: x["first"]),
            lambda t: F.transform(by_first_name, lambda e, i: F.struct(
                e["ord"].alias("ord"),
                e["key"].alias("key"),
                e["first"].alias("first"),
                (i - lookup(t, lambda x: x["first"], e["first"])["i"] + 1).alias("num"),
                e["shown"].alias("shown"),
            )),
        )

    def over(mentions: Column) -> Column:
        return F.when(
            F.size(mentions) > 0,
            F.sort_array(let(F.sort_array(entries(mentions)), numbered)),
        ).otherwise(F.array().cast(PERSON_ENTITIES))

    persons = F.filter(items, lambda p: p["pii_type"] == "person_name")
    return let(
        F.transform(persons, lambda p: F.struct(
            person_key(p["value"]).alias("key"),
            first_word(F.trim(p["value"])).alias("word"),
        )),
        over,
    )


def person_tables(entities: Column) -> Column:
    """The persons of :func:`person_entities` by key, by first name and by last name; see :func:`resolved_person`."""
    return F.struct(
        lookup_table(entities, lambda x: x["key"]).alias("by_key"),
        lookup_table(entities, lambda x: x["first"]).alias("by_first"),
        lookup_table(entities, lambda x: last_word(x["key"])).alias("by_last"),
    )


def by_surname(rule: Column) -> Column:
    """Whether a mention of this rule names a person by the surname."""
    return rule.isin("honorific", "short_surname")


def resolved_person(p: Column, tables: Column) -> Column:
    """The person that a mention means, an entry of :func:`person_entities`.

    That of its own key; else the first with its word as first or last name,
    a title or the rule for surnames asking for the last name first.
    """

    def resolve(k: Column) -> Column:
        by_first = lookup(tables["by_first"], lambda e: e["first"], k)
        by_last = lookup(tables["by_last"], lambda e: last_word(e["key"]), k)
        return F.coalesce(
            lookup(tables["by_key"], lambda e: e["key"], k),
            F.when(by_surname(p["rule"]), F.coalesce(by_last, by_first)).otherwise(F.coalesce(by_first, by_last)),
        )

    return let(person_key(p["value"]), resolve)


def company_keys(items: Column) -> Column:
    """Distinct company keys of one document by first appearance."""
    found = F.filter(items, lambda p: p["pii_type"] == "company")
    return F.array_distinct(F.transform(found, lambda p: normal_key(p["value"])))


def invented_names(keys: Column, doc_key: Column, salt: Column, heads: list[str], tails: list[str]) -> Column:
    """One different invented lower-case name per key, none of them among the keys.

    Words that occur in a key are not used either (unless no other is left).
    """

    def unused(pool: list[str], taken: Column) -> Column:
        lower = words(w.lower() for w in pool)
        return let(F.array_except(lower, taken), lambda free: F.when(F.size(free) > 0, free).otherwise(lower))

    def over(k: Column) -> Column:
        taken = F.flatten(F.transform(k, lambda x: F.split(x, " ")))
        pools = let(taken, lambda t: F.struct(unused(heads, t).alias("head"), unused(tails, t).alias("tail")))
        return F.when(F.size(k) > 0, let(pools, lambda p: F.array_except(candidates(k, p["head"], p["tail"]), k))).otherwise(
            F.array().cast("array<string>")
        )

    def candidates(k: Column, head: Column, tail: Column) -> Column:
        # Twice as many as keys: at most half of them can be keys.
        n_head, n_all = F.size(head), F.size(head) * F.size(tail)

        def name(i: Column, start: Column) -> Column:
            lap = F.floor(i / n_all)
            return F.concat_ws(
                " ",
                F.get(head, ((start + i) % n_head).cast("int")),
                F.when(lap > 0, (lap + 1).cast("string")),
                F.get(tail, (F.floor((start + i) / n_head) % F.size(tail)).cast("int")),
            )

        return let(hash_number(doc_key, salt) % n_all, lambda start: F.transform(
            F.sequence(F.lit(0), F.size(k) * 2 - 1), lambda i: name(i, start)
        ))

    return let(keys, over)


def _action(action: Column | str) -> Column:
    return F.lit(action) if isinstance(action, str) else action


def _may_be(action: Column | str, *wanted: str) -> bool:
    """False when a fixed action rules the wanted ones out."""
    return not isinstance(action, str) or action in wanted


def entity_context(items: Column, actions: dict, salt: Column, doc_key: Column) -> Column:
    """What replacing needs to know about the whole document, as one struct."""
    person, company = actions.get("person_name", ""), actions.get("company", "")
    fields = []
    if _may_be(person, "keep_part", "invent"):
        wanted = _action(person).isin("keep_part", "invent")
        entities = F.when(wanted, person_entities(items)).otherwise(F.array().cast(PERSON_ENTITIES))

        def tables(e: Column) -> Column:
            return F.struct(
                person_tables(e).alias("tables"),
                F.when(
                    _action(person) == "invent",
                    invented_names(
                        F.transform(e, lambda x: x["key"]), doc_key, salt, N.INVENTED_FIRST, N.INVENTED_LAST
                    ),
                ).alias("invented"),
            )

        fields.append(let(entities, tables).alias("persons"))
    if _may_be(company, "invent"):
        keys = F.when(_action(company) == "invent", company_keys(items)).otherwise(
            F.array().cast("array<string>")
        )
        fields.append(let(keys, lambda k: F.struct(
            lookup_table(
                F.transform(k, lambda x, i: F.struct(x.alias("key"), i.alias("i"))), lambda x: x["key"]
            ).alias("by_key"),
            invented_names(
                k, doc_key, salt, N.INVENTED_COMPANY_HEAD, N.INVENTED_COMPANY_TAIL
            ).alias("invented"),
        )).alias("companies"))
    return F.struct(*fields, F.lit(0).alias("none"))


def person_replacement(p: Column, context: Column, action: Column) -> Column:
    removed = F.lit(REMOVED["person_name"])
    persons = context["persons"]

    def named(e: Column) -> Column:
        # A lone surname has no first name to keep.
        surname_only = by_surname(p["rule"]) & ~is_full_name(e["key"])
        return (
            F.when(action == "invent", F.initcap(F.get(persons["invented"], e["ord"] - 1)))
            .when(surname_only, removed)
            .otherwise(F.concat_ws(" ", e["shown"], e["num"].cast("string")))
        )

    return F.when(action == "delete", removed).otherwise(let(resolved_person(p, persons["tables"]), named))


def company_replacement(p: Column, context: Column, action: Column) -> Column:
    companies = context["companies"]
    found = let(normal_key(p["value"]), lambda key: lookup(companies["by_key"], lambda e: e["key"], key))
    return F.when(action == "invent", F.initcap(F.get(companies["invented"], found["i"]))).otherwise(p["value"])


def span_replacement(p: Column, context: Column, actions: dict, salt: Column) -> Column:
    """The replacement of one piece; plain text and types without an action stay."""
    v = p["value"]
    inventors = {
        "phone": invent_phone,
        "address": invent_address,
        "financial": fake_digits,
        "id_numbers": fake_digits,
        "date_of_birth": invent_birth_date,
    }
    keepers = {"email": keep_email_domain, "phone": keep_phone_area}
    out = F.when(p["pii_type"].isNull(), v)
    for t, action in actions.items():
        a = _action(action)
        if t == "person_name":
            if _may_be(action, "keep_part", "invent"):
                new = person_replacement(p, context, a)
            else:
                new = F.lit(REMOVED[t])
        elif t == "company":
            new = company_replacement(p, context, a) if _may_be(action, "invent") else v
        else:
            new = F.lit(REMOVED[t])
            if t in inventors and _may_be(action, "invent"):
                new = F.when(a == "invent", inventors[t](v, salt)).otherwise(new)
            if t in keepers and _may_be(action, "keep_part"):
                new = F.when(a == "keep_part", keepers[t](v)).otherwise(new)
        # No action for this type (a null in a per-row rule): the text stays.
        out = out.when(p["pii_type"] == t, F.when(a.isNull(), v).otherwise(new))
    return out.otherwise(v)


def applied_pieces(items: Column, actions: dict, salt: Column | str, doc_key: Column) -> Column:
    """``ARRAY<STRUCT<pii_type, rule, value, replacement>>``; one pass, nothing is shuffled.

    ``actions`` maps a type to a fixed action or to a column (one rule set per
    row, null for none).
    """
    salt = F.lit(salt) if isinstance(salt, str) else salt

    def over(it: Column) -> Column:
        return let(entity_context(it, actions, salt, doc_key), lambda context: F.transform(
            it,
            lambda p: F.struct(
                p["pii_type"].alias("pii_type"),
                p["rule"].alias("rule"),
                p["value"].alias("value"),
                span_replacement(p, context, actions, salt).alias("replacement"),
            ),
        ))

    return let(items, over)


def replaced_text(applied: Column) -> Column:
    return F.array_join(F.transform(applied, lambda p: p["replacement"]), "")
