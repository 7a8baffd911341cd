"""Queries: profiles, rules and the upload registry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inkveil.model import (
    ACTIONS,
    DEFAULT_ACTIONS,
    NAME_BAD_CHARS,
    NAME_EMPTY,
    NAME_TOO_LONG,
    PII_TYPES,
    VALID_ACTIONS,
)
from inkveil.operators import profiles as P
from inkveil.operators import uploads as U
from inkveil.operators.storage import read_contents, remove_files
from inkveil.plans import inputs as I
from inkveil.plans.registry import query, rows, table
from inkveil.scratch import new_folder, written

NOW = dt.datetime(2024, 1, 15, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def now_column():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


LEGAL = "(VALUES " + ", ".join(f"('{t}', '{a}', '{d}')" for t, a, d in VALID_ACTIONS) + ") AS legal(pii_type, action, text)"
TYPE_ORDER = "(VALUES " + ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(PII_TYPES)) + ") AS types(pii_type, ord)"


@query(
    " UNION ALL ".join(
        f"SELECT profile_id, '{t}' AS pii_type, '{a}' AS action, CAST(NULL AS VARCHAR) AS description FROM ({I.PROFILES})"
        for t, a in DEFAULT_ACTIONS.items()
    )
)
def default_rules(spark, sf_dir):
    """The default rules for every tenant."""
    return P.add_default_rules(rows(spark, sf_dir, I.PROFILES))


@query(
    f"SELECT p.profile_id, p.name, r.pii_type, r.action, r.description, p.created_at, "
    f"(SELECT CAST(count(*) + 1 AS INTEGER) FROM customer) AS next_id FROM ({I.PROFILES}) p JOIN ({I.RULES}) r USING (profile_id)"
)
def save_and_load_profiles(spark, sf_dir):
    profiles, rules = rows(spark, sf_dir, I.PROFILES), rows(spark, sf_dir, I.RULES)
    path = new_folder(spark, "profiles")
    P.save_profiles(profiles, rules, profiles.count() + 1, path)
    p, r, next_id = P.load_profiles(spark, path, NOW)
    return p.join(r, "profile_id").select(
        "profile_id", "name", "pii_type", "action", "description", "created_at", F.lit(next_id).alias("next_id")
    )


@query(
    f"""
    WITH p AS ({I.PROFILES}), r AS ({I.REQUESTS}),
    q AS (SELECT *, CASE WHEN profile_id IS NOT NULL THEN profile_id
                         WHEN regexp_full_match(profile, '[0-9]+') THEN CAST(profile AS BIGINT) END AS by_id FROM r)
    SELECT request_id, CAST(p.profile_id AS VARCHAR) AS resolved_id, p.name AS resolved_name,
           CASE WHEN p.profile_id IS NULL THEN 'Profile not found: ' ||
                coalesce(CAST(q.profile_id AS VARCHAR), profile, 'default') END AS error
    FROM q LEFT JOIN p ON (by_id IS NOT NULL AND p.profile_id = by_id)
                       OR (by_id IS NULL AND lower(p.name) = lower(coalesce(profile, 'default')))
    """
)
def resolve_profile(spark, sf_dir):
    found = P.resolve_profile(rows(spark, sf_dir, I.REQUESTS), rows(spark, sf_dir, I.PROFILES))
    return found.select("request_id", F.col("resolved_id").cast("string").alias("resolved_id"), "resolved_name", "error")


NAMES = (
    "SELECT c_name AS name FROM customer UNION ALL "
    "SELECT lower(c_mktsegment) || '_' || CAST(c_custkey AS STRING) AS name FROM customer UNION ALL "
    "SELECT c_mktsegment || chr(10) AS name FROM customer UNION ALL "
    "SELECT repeat('a', 45) || CAST(o_orderkey AS STRING) AS name FROM orders UNION ALL "
    "SELECT substr(lang, 3) AS name FROM documents UNION ALL SELECT text AS name FROM documents"
)


@query(
    f"SELECT name, error = '' AS is_valid, error FROM (SELECT name, CASE WHEN name = '' THEN '{NAME_EMPTY}' "
    f"WHEN length(name) > 50 THEN '{NAME_TOO_LONG}' "
    f"WHEN NOT regexp_full_match(name, '[A-Za-z0-9_-]+') THEN '{NAME_BAD_CHARS}' ELSE '' END AS error FROM ({NAMES}))"
)
def validate_names(spark, sf_dir):
    return P.validate_names(rows(spark, sf_dir, NAMES))


# New profiles asked for by orders: repeated names, taken names, bad names, unknown sources.
CREATIONS = (
    "SELECT o_orderkey AS ord, CASE o_orderkey % 7 WHEN 0 THEN 'bad name ' || CAST(o_orderkey AS STRING) "
    "WHEN 1 THEN 'tenant_' || CAST(o_custkey AS STRING) ELSE 'Team_' || CAST(o_custkey + o_orderkey % 4 AS STRING) END AS name, "
    "CASE o_orderkey % 3 WHEN 0 THEN 'TENANT_' || CAST(o_custkey AS STRING) "
    "WHEN 1 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'nobody' END END AS source FROM orders"
)
_CREATED = f"""
    WITH p AS ({I.PROFILES}), r AS ({CREATIONS}),
    a AS (SELECT r.*, s.profile_id AS source_id, CASE
            WHEN NOT regexp_full_match(r.name, '[A-Za-z0-9_-]+') THEN '{NAME_BAD_CHARS}'
            WHEN t.profile_id IS NOT NULL THEN 'Profile ''' || r.name || ''' already exists'
            WHEN s.profile_id IS NULL THEN 'Source profile not found: ' || coalesce(r.source, 'default') END AS e1
          FROM r LEFT JOIN p t ON lower(t.name) = lower(r.name)
                 LEFT JOIN p s ON lower(s.name) = lower(coalesce(r.source, 'default'))),
    b AS (SELECT *, coalesce(e1, CASE WHEN row_number() OVER (PARTITION BY lower(name), e1 IS NULL ORDER BY ord) > 1
                                      THEN 'Profile ''' || name || ''' already exists' END) AS error FROM a),
    c AS (SELECT *, CASE WHEN error IS NULL THEN CAST((SELECT count(*) FROM customer) + row_number() OVER
                    (PARTITION BY error IS NULL ORDER BY ord) AS INTEGER) END AS profile_id FROM b)
"""


def _creation(spark, sf_dir):
    profiles, rules = rows(spark, sf_dir, I.PROFILES), rows(spark, sf_dir, I.RULES)
    return P.create_profiles(
        profiles, rules, rows(spark, sf_dir, CREATIONS), profiles.count() + 1, now_column()
    )


@query(_CREATED + "SELECT ord, name, CAST(profile_id AS VARCHAR) AS profile_id, error FROM c")
def create_profiles(spark, sf_dir):
    return _creation(spark, sf_dir)[2].withColumn("profile_id", F.col("profile_id").cast("string"))


@query(
    _CREATED + f"SELECT c.profile_id, c.name, {NOW_SQL} AS created_at, u.pii_type, u.action, u.description "
    f"FROM c JOIN ({I.RULES}) u ON u.profile_id = c.source_id WHERE error IS NULL"
)
def created_profile_rules(spark, sf_dir):
    created, new_rules, _ = _creation(spark, sf_dir)
    return created.join(new_rules, "profile_id").select(
        "profile_id", "name", "created_at", "pii_type", "action", "description"
    )


# Rule changes, one per order; one in fifty breaks a rule in one of four ways.
_PAIRS = [f"{t}={a}" for t, a, _ in VALID_ACTIONS]
CHANGES = (
    "SELECT CAST(o_custkey + 1 + CASE WHEN o_orderkey % 97 = 0 THEN 1000000 ELSE 0 END AS INT) AS profile_id, o_orderkey AS ord, "
    "CASE o_orderkey % 200 WHEN 50 THEN 'email' WHEN 100 THEN 'nickname=delete' WHEN 150 THEN 'email=shred' "
    f"WHEN 199 THEN 'email=invent' ELSE {I.pick(_PAIRS, 'o_orderkey')} END AS change FROM orders"
)
_VALID_LISTS = {t: str([a for u, a, _ in VALID_ACTIONS if u == t]) for t in PII_TYPES}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ACTION_LIST = ", ".join(f"'{a}'" for a in ACTIONS)
_TYPE_LIST = ", ".join(f"'{t}'" for t in PII_TYPES)
_LISTS = "(VALUES " + ", ".join(f"('{t}', {_sql_text(v)})" for t, v in _VALID_LISTS.items()) + ") AS lists(pii_type, valid)"
_PARSED = f"""
    WITH p AS ({I.PROFILES}), ch AS ({CHANGES}),
    parts AS (SELECT *, split_part(change, '=', 1) AS t, split_part(change, '=', 2) AS a FROM ch),
    j AS (SELECT parts.*, CASE
            WHEN p.profile_id IS NULL THEN 'Profile not found: ' || CAST(parts.profile_id AS VARCHAR)
            WHEN strpos(change, '=') = 0 THEN 'Invalid format ''' || change || '''. Use: pii_type=action'
            WHEN t NOT IN ({_TYPE_LIST}) THEN 'Invalid PII type ''' || t || ''''
            WHEN a NOT IN ({_ACTION_LIST}) THEN 'Invalid action ''' || a || ''''
            WHEN legal.action IS NULL THEN 'Invalid action ''' || a || ''' for ' || t || '. Valid: ' || lists.valid END AS error
          FROM parts LEFT JOIN p ON p.profile_id = parts.profile_id
               LEFT JOIN {LEGAL} ON legal.pii_type = t AND legal.action = a
               LEFT JOIN {_LISTS} ON lists.pii_type = t),
    v AS (SELECT profile_id, count(error) AS bad FROM j GROUP BY profile_id),
    n AS (SELECT j.profile_id, t AS pii_type, arg_max(a, ord) AS new_action FROM j JOIN v USING (profile_id)
          WHERE bad = 0 GROUP BY 1, 2),
    u AS (SELECT r.profile_id, r.pii_type, coalesce(new_action, r.action) AS action,
                 CASE WHEN new_action IS NULL THEN description END AS description, r.action AS old_action
          FROM ({I.RULES}) r LEFT JOIN n USING (profile_id, pii_type))
"""


def _updated(spark, sf_dir):
    return P.update_rules(
        rows(spark, sf_dir, I.PROFILES), rows(spark, sf_dir, I.RULES), rows(spark, sf_dir, CHANGES), now_column()
    )


@query(_PARSED + "SELECT j.profile_id, ord, change, bad = 0 AS applied, error FROM j JOIN v USING (profile_id)")
def rule_changes(spark, sf_dir):
    return _updated(spark, sf_dir)[2]


@query(
    _PARSED + f"SELECT u.profile_id, u.pii_type, u.action, u.description, CASE WHEN v.bad = 0 THEN {NOW_SQL} ELSE p.modified_at END "
    "AS modified_at FROM u JOIN p USING (profile_id) LEFT JOIN v USING (profile_id)"
)
def update_rules(spark, sf_dir):
    profiles, new_rules, _ = _updated(spark, sf_dir)
    return new_rules.join(profiles.select("profile_id", "modified_at"), "profile_id")


@query(
    _PARSED + "SELECT profile_id, pii_type, old_action, action AS new_action, "
    "pii_type || ' (' || old_action || ' → ' || action || ')' AS change FROM u WHERE action <> old_action"
)
def diff_rules(spark, sf_dir):
    return P.diff_rules(rows(spark, sf_dir, I.RULES), _updated(spark, sf_dir)[1])


# Deletions asked for by suppliers, some of the default profile, some of unknown ones.
DELETIONS = (
    "SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 END AS profile_id, "
    "CASE s_suppkey % 3 WHEN 1 THEN 'TENANT_' || CAST(s_suppkey * 40 AS STRING) END AS profile FROM supplier"
)
_DELETED = f"""
    WITH p AS ({I.PROFILES}), d AS ({DELETIONS}),
    o AS (SELECT request_id, p.profile_id AS resolved_id, CASE WHEN lower(p.name) = 'default' THEN 'Cannot delete the default profile'
            WHEN p.profile_id IS NULL THEN 'Profile not found: ' || coalesce(CAST(d.profile_id AS VARCHAR), profile, 'default') END AS error
          FROM d LEFT JOIN p ON p.profile_id = d.profile_id
                             OR (d.profile_id IS NULL AND lower(p.name) = lower(coalesce(profile, 'default'))))
"""


@query(_DELETED + "SELECT request_id, CAST(resolved_id AS VARCHAR) AS resolved_id, error FROM o")
def delete_profiles(spark, sf_dir):
    outcome = P.delete_profiles(
        rows(spark, sf_dir, I.PROFILES), rows(spark, sf_dir, I.RULES), rows(spark, sf_dir, DELETIONS)
    )[2]
    return outcome.select("request_id", F.col("resolved_id").cast("string").alias("resolved_id"), "error")


@query(
    _DELETED + f"SELECT p.profile_id, p.name, r.pii_type, r.action FROM p JOIN ({I.RULES}) r USING (profile_id) "
    "WHERE p.profile_id NOT IN (SELECT resolved_id FROM o WHERE error IS NULL)"
)
def profiles_after_deletion(spark, sf_dir):
    p, r, _ = P.delete_profiles(
        rows(spark, sf_dir, I.PROFILES), rows(spark, sf_dir, I.RULES), rows(spark, sf_dir, DELETIONS)
    )
    return p.join(r, "profile_id").select("profile_id", "name", "pii_type", "action")


# Any type with any action, one rule per order.
ANY_RULES = (
    f"SELECT o_orderkey AS profile_id, {I.pick(PII_TYPES, 'o_orderkey')} AS pii_type, "
    f"{I.pick(ACTIONS, 'CAST(floor(o_orderkey / 8) AS BIGINT)')} AS action FROM orders"
)


@query(f"SELECT r.* FROM ({ANY_RULES}) r LEFT JOIN {LEGAL} USING (pii_type, action) WHERE legal.text IS NULL")
def validate_rules(spark, sf_dir):
    return P.validate_rules(rows(spark, sf_dir, ANY_RULES))


@query(
    f"SELECT r.profile_id, types.ord, r.pii_type, r.action, coalesce(legal.text, '') AS description "
    f"FROM ({' UNION ALL '.join(f'SELECT profile_id, {chr(39)}{t}{chr(39)} AS pii_type, {t} AS action FROM ({I.WIDE_RULES})' for t in PII_TYPES)}) r "
    f"JOIN {TYPE_ORDER} USING (pii_type) LEFT JOIN {LEGAL} USING (pii_type, action)"
)
def rules_long(spark, sf_dir):
    return P.rules_long(rows(spark, sf_dir, I.WIDE_RULES), ["profile_id"])


@query(
    f"SELECT r.profile_id, types.ord, r.pii_type, r.action, coalesce(r.description, legal.text, '') AS description "
    f"FROM ({I.RULES}) r JOIN {TYPE_ORDER} USING (pii_type) LEFT JOIN {LEGAL} USING (pii_type, action)"
)
def rules_summary(spark, sf_dir):
    return P.summarize_rules(rows(spark, sf_dir, I.RULES), ["profile_id"])


@query(f"SELECT w.*, p.name FROM ({I.WIDE_RULES}) w JOIN ({I.PROFILES}) p USING (profile_id)")
def rules_wide(spark, sf_dir):
    named = rows(spark, sf_dir, I.RULES).join(rows(spark, sf_dir, I.PROFILES).select("profile_id", "name"), "profile_id")
    return P.rules_wide(named, ["profile_id", "name"])


# -- uploads -----------------------------------------------------------------

_IS_ID = "regexp_full_match(file_id, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')"


@query(
    "SELECT source || '.TXT' AS filename, CAST(octet_length(encode(text)) AS BIGINT) AS size, true AS has_id, "
    "'.txt' AS stored_as FROM documents"
)
def register_uploads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(".TXT")).alias("filename"), F.encode("text", "UTF-8").alias("content")
    )
    kept = U.register_uploads(docs, new_folder(spark, "uploads"))
    return kept.select(
        "filename", "size", U.is_file_id(F.col("file_id")).alias("has_id"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), F.col("file_id"), F.lit("")).alias("stored_as"),
    )


@query(
    "SELECT CAST(doc_id AS VARCHAR) || '.TXT' AS filename, doc_id % 3 = 0 AS orphan, "
    "CASE WHEN doc_id % 3 <> 0 THEN text END AS text FROM documents"
)
def stored_uploads(spark, sf_dir):
    """Files on disk: a third lose their row, are found by listing the folder and removed; the others are read back."""
    folder = new_folder(spark, "files")
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".TXT")).alias("filename"), F.encode("text", "UTF-8").alias("content")
    )
    uploads = U.register_uploads(docs, new_folder(spark, "uploads"), folder)
    forgotten = F.regexp_extract("filename", "[0-9]+", 0).cast("long") % 3 == 0
    listing = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    tomorrow = F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    gone = written(remove_files(U.orphans(listing, uploads.where(~forgotten), tomorrow)), "removed").where("removed")
    # Joined before the contents are read, so that they are not shuffled.
    left = read_contents(uploads.join(gone.select("file_id", F.lit(True).alias("gone")), "file_id", "left"))
    return left.select(
        "filename", F.coalesce("gone", F.lit(False)).alias("orphan"), F.col("content").cast("string").alias("text")
    )


@query(
    f"SELECT u.* FROM ({I.UPLOADS}) u WHERE file_id IN (SELECT file_id FROM ({I.ASKED_IDS}))"
)
def get_uploads(spark, sf_dir):
    return U.get_uploads(rows(spark, sf_dir, I.UPLOADS), rows(spark, sf_dir, I.ASKED_IDS))[0]


@query(
    f"SELECT file_id FROM ({I.ASKED_IDS}) WHERE NOT {_IS_ID} OR file_id NOT IN (SELECT file_id FROM ({I.UPLOADS}))"
)
def missing_uploads(spark, sf_dir):
    return U.get_uploads(rows(spark, sf_dir, I.UPLOADS), rows(spark, sf_dir, I.ASKED_IDS))[1]


@query(f"SELECT file_id, filename, size, created_at FROM ({I.UPLOADS})")
def list_uploads(spark, sf_dir):
    return U.list_uploads(rows(spark, sf_dir, I.UPLOADS))[0]


@query(f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ({I.UPLOADS})")
def count_uploads(spark, sf_dir):
    return U.list_uploads(rows(spark, sf_dir, I.UPLOADS))[1]


@query(f"SELECT * FROM ({I.UPLOADS}) WHERE file_id NOT IN (SELECT file_id FROM ({I.ASKED_IDS}))")
def delete_uploads(spark, sf_dir):
    return U.delete_uploads(rows(spark, sf_dir, I.UPLOADS), rows(spark, sf_dir, I.ASKED_IDS))[0]


@query(
    f"SELECT DISTINCT file_id, file_id IN (SELECT file_id FROM ({I.UPLOADS})) AS deleted FROM ({I.ASKED_IDS})"
)
def deleted_uploads(spark, sf_dir):
    return U.delete_uploads(rows(spark, sf_dir, I.UPLOADS), rows(spark, sf_dir, I.ASKED_IDS))[1]


@query(f"SELECT * FROM ({I.UPLOADS}) WHERE epoch_us({NOW_SQL}) - epoch_us(created_at) > 300 * 1000000")
def expire_uploads(spark, sf_dir):
    return U.expire(rows(spark, sf_dir, I.UPLOADS), now_column())[1]


@query(f"SELECT * FROM ({I.UPLOADS}) WHERE epoch_us({NOW_SQL}) - epoch_us(created_at) <= 300 * 1000000")
def live_uploads(spark, sf_dir):
    return U.expire(rows(spark, sf_dir, I.UPLOADS), now_column())[0]


LISTING = (
    f"SELECT '/uploads/' || {I.uuid_of('event_id')} || '.txt' AS path, ts AS modificationTime FROM events"
)
KNOWN = f"SELECT {I.uuid_of('o_orderkey * 2')} AS file_id FROM orders"


@query(
    f"SELECT path, \"modificationTime\", substr(path, 10, 36) AS file_id FROM ({LISTING}) "
    f"WHERE epoch_us({NOW_SQL}) - epoch_us(\"modificationTime\") > 300 * 1000000 "
    f"AND substr(path, 10, 36) NOT IN (SELECT file_id FROM ({KNOWN}))"
)
def orphans(spark, sf_dir):
    return U.orphans(rows(spark, sf_dir, LISTING), rows(spark, sf_dir, KNOWN), now_column())
