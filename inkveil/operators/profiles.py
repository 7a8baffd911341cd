"""Profiles and their rules as tables.

``profiles(profile_id, name, created_at, modified_at)`` and
``rules(profile_id, pii_type, action, description)`` hold any number of
profiles; requests and changes come as tables too, and every failed request
comes back as a row with its error.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.arrays import let, words
from inkveil.model import (
    ACTIONS,
    DEFAULT_ACTIONS,
    NAME_BAD_CHARS,
    NAME_EMPTY,
    NAME_TOO_LONG,
    PII_TYPES,
    PROFILE_JSON_SCHEMA,
    PROFILE_NAME_MAX,
    VALID_ACTIONS,
    action_is_legal,
    type_order,
    valid_actions,
)
from inkveil.operators.numbering import number_rows


def default_rules() -> Column:
    """The 8 default rules as an array of (pii_type, action, description)."""
    return F.array([
        F.struct(
            F.lit(t).alias("pii_type"),
            F.lit(a).alias("action"),
            F.lit(None).cast("string").alias("description"),
        )
        for t, a in DEFAULT_ACTIONS.items()
    ])


def add_default_rules(profiles: DataFrame) -> DataFrame:
    """The default rule rows for every profile of a table."""
    return profiles.select("profile_id", F.explode(default_rules()).alias("r")).select("profile_id", "r.*")


def default_profile(spark: SparkSession, now: dt.datetime) -> tuple[DataFrame, DataFrame, int]:
    """The store a first use creates: profile 1 "default", its rules, next id 2."""
    profiles = spark.createDataFrame(
        [(1, "default", now, now)], "profile_id int, name string, created_at timestamp, modified_at timestamp"
    )
    return profiles, add_default_rules(profiles), 2


# -- load and save ----------------------------------------------------------

def load_profile_json(spark: SparkSession, path: str, now: dt.datetime) -> tuple[DataFrame, DataFrame, int]:
    """Read a profile store kept as one JSON document.

    A missing file gives the default store; a broken one is an error, not a
    silent reset. Illegal pairs are left in, see :func:`validate_rules`.
    """
    try:
        store = spark.read.schema(PROFILE_JSON_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return default_profile(spark, now)
        raise
    rows = store.select("next_id", F.explode("profiles").alias("p"))
    profiles = rows.select(
        F.col("p.id").alias("profile_id"),
        "p.name",
        F.to_timestamp("p.created_at").alias("created_at"),
        F.to_timestamp("p.modified_at").alias("modified_at"),
    )
    rules = rows.select(
        F.col("p.id").alias("profile_id"),
        F.explode(F.array([
            F.struct(
                F.lit(t).alias("pii_type"),
                # A type the document leaves out has its default action.
                F.coalesce(F.col(f"p.config.{t}.action"), F.lit(DEFAULT_ACTIONS[t])).alias("action"),
                F.col(f"p.config.{t}.description").alias("description"),
            )
            for t in PII_TYPES
        ])).alias("r"),
    ).select("profile_id", "r.*")
    next_id = store.agg(F.max("next_id")).first()[0]
    return profiles, rules, next_id


def save_profiles(profiles: DataFrame, rules: DataFrame, next_id: int, path: str) -> None:
    """Write a snapshot; take a new directory for each version."""
    spark = profiles.sparkSession
    profiles.write.mode("errorifexists").parquet(f"{path}/profiles")
    rules.write.mode("errorifexists").parquet(f"{path}/rules")
    spark.createDataFrame([(next_id,)], "next_id int").write.mode("errorifexists").parquet(f"{path}/next_id")


def load_profiles(spark: SparkSession, path: str, now: dt.datetime) -> tuple[DataFrame, DataFrame, int]:
    """Read a snapshot; the default store when there is none.

    A snapshot of which a part is missing (the writing broke off) is an error,
    and so are rules that are not legal.
    """
    parts, missing = {}, []
    for name in ("profiles", "rules", "next_id"):
        try:
            parts[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(name)
    if len(missing) == 3:
        return default_profile(spark, now)
    if missing:
        raise ValueError(f"Incomplete profile snapshot in {path}: no {', '.join(missing)}")
    bad = validate_rules(parts["rules"]).first()
    if bad is not None:
        raise ValueError(f"Invalid action '{bad.action}' for {bad.pii_type} in the snapshot {path}")
    return parts["profiles"], parts["rules"], parts["next_id"].first()[0]


# -- lookup -----------------------------------------------------------------

def profile_key(profile_id: Column, profile: Column, default: str = "default") -> Column:
    """What a request asks for: the id if given, else the name."""
    name = F.coalesce(F.when(profile != "", profile), F.lit(default))
    return F.when(profile_id.isNotNull(), F.concat(F.lit("id:"), profile_id.cast("string"))).otherwise(
        F.concat(F.lit("name:"), F.lower(name))
    )


def profile_keys(profiles: DataFrame) -> DataFrame:
    """The profiles with every ``_key`` they answer to.

    A profile is asked for by its id, by its name in any case, and by its id
    written as a name unless another profile has that name.
    """
    named = F.concat(F.lit("name:"), F.lower("name"))
    number = F.concat(F.lit("name:"), F.col("profile_id").cast("string"))
    taken = profiles.where(F.col("name").rlike("\\A[0-9]+\\z")).select(named.alias("_key"))
    by_name = profiles.select("*", F.explode(F.array(
        F.concat(F.lit("id:"), F.col("profile_id").cast("string")), named
    )).alias("_key"))
    by_number = profiles.withColumn("_key", number).join(taken, "_key", "left_anti")
    return by_name.unionByName(by_number)


# Tables whose files hold up to so many bytes, by Spark's own estimate, are
# broadcast: three keys and eight short actions a profile make a few times that.
BROADCAST_BYTES = 32 << 20


def is_small(*tables: DataFrame) -> bool:
    """Whether the sources that tables are read from are known to be small; runs no job."""
    sizes = [int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables]
    return sum(sizes) <= BROADCAST_BYTES


def resolve_profile(
    requests: DataFrame, profiles: DataFrame, default: str = "default", small: bool | None = None
) -> DataFrame:
    """Add ``resolved_id``, ``resolved_name`` and ``error`` to each request.

    Requests have ``profile_id`` and ``profile`` (either may be null). Further
    columns of ``profiles`` come along. One equi-join on a common key, with
    the profiles broadcast when their files are small (``small`` says so for
    derived tables), so that documents are not shuffled; beyond that AQE
    splits a profile that many requests name.
    """
    more = [c for c in profiles.columns if c not in ("profile_id", "name", "created_at", "modified_at")]
    known = profile_keys(profiles.select("profile_id", "name", *more)).select(
        F.col("profile_id").alias("resolved_id"), F.col("name").alias("resolved_name"), *more, "_key"
    )
    if is_small(profiles) if small is None else small:
        known = F.broadcast(known)
    asked = requests.withColumn("_key", profile_key(F.col("profile_id"), F.col("profile"), default))
    missing = F.concat(
        F.lit("Profile not found: "),
        F.coalesce(F.col("profile_id").cast("string"), F.when(F.col("profile") != "", F.col("profile")), F.lit(default)),
    )
    return (
        asked.join(known, "_key", "left")
        .withColumn("error", F.when(F.col("resolved_id").isNull(), missing))
        .drop("_key")
    )


# -- create, change, delete -------------------------------------------------

def name_error(name: Column) -> Column:
    """Why a profile name is refused; null for a valid one."""
    return (
        F.when(name.isNull() | (name == ""), NAME_EMPTY)
        .when(F.length(name) > PROFILE_NAME_MAX, NAME_TOO_LONG)
        .when(~name.rlike("\\A[A-Za-z0-9_-]+\\z"), NAME_BAD_CHARS)
    )


def validate_names(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Add ``is_valid`` and ``error``."""
    error = name_error(F.col(name_col))
    return df.withColumn("is_valid", error.isNull()).withColumn("error", F.coalesce(error, F.lit("")))


def create_profiles(
    profiles: DataFrame, rules: DataFrame, requests: DataFrame, next_id: int, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create profiles from requests ``(ord, name, source)``; ``source`` null copies "default".

    Returns the new profile rows, their rule rows and one outcome row per
    request ``(ord, name, profile_id, error)``. Requests count in the order of
    ``ord`` (unique): a later one with the same name is a duplicate.
    """
    checked = requests.withColumn("_lower", F.lower("name")).withColumn("_error", name_error(F.col("name")))
    taken = profiles.select(F.lower("name").alias("_lower"), F.lit(True).alias("_taken")).distinct()
    sources = resolve_profile(
        checked.withColumn("profile_id", F.lit(None).cast("long")).withColumn("profile", F.col("source")), profiles
    ).select(
        "ord", "name", "source", "_lower", "_error",
        F.col("resolved_id").alias("_source_id"),
    )
    exists = F.concat(F.lit("Profile '"), F.col("name"), F.lit("' already exists"))
    no_source = F.concat(F.lit("Source profile not found: "), F.coalesce("source", F.lit("default")))
    single = sources.join(taken, "_lower", "left").withColumn(
        "_error",
        F.coalesce(
            F.col("_error"),
            F.when(F.col("_taken"), exists),
            F.when(F.col("_source_id").isNull(), no_source),
        ),
    )
    # Of the requests that pass on their own, the first per name wins. The
    # minimum is taken per task first, so a name asked for often costs little.
    first = single.where(F.col("_error").isNull()).groupBy("_lower").agg(F.min("ord").alias("_first"))
    judged = single.join(first, "_lower", "left").withColumn(
        "error", F.coalesce(F.col("_error"), F.when(F.col("ord") > F.col("_first"), exists))
    ).select("ord", "name", "_source_id", "error")
    accepted = number_rows(judged.where(F.col("error").isNull()), "ord", next_id, "profile_id")
    created = accepted.select("profile_id", "name", now.alias("created_at"), now.alias("modified_at"))
    copied = rules.withColumnRenamed("profile_id", "_source_id")
    new_rules = accepted.select("profile_id", "_source_id").join(copied, "_source_id").select(
        "profile_id", "pii_type", "action", "description"
    )
    outcome = judged.select("ord", "name", "error").join(
        accepted.select("ord", "profile_id"), "ord", "left"
    ).select("ord", "name", "profile_id", "error")
    return created, new_rules, outcome


def parse_changes(changes: DataFrame) -> DataFrame:
    """Read changes written ``pii_type=action``; adds ``pii_type``, ``action``, ``error``."""
    valid_lists = words(str([b for y, b, _ in VALID_ACTIONS if y == ty]) for ty in PII_TYPES)

    def parsed(x: Column) -> Column:
        t, a = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        error = (
            F.when(a.isNull(), F.concat(F.lit("Invalid format '"), t, F.lit("'. Use: pii_type=action")))
            .when(~t.isin(PII_TYPES), F.concat(F.lit("Invalid PII type '"), t, F.lit("'")))
            .when(~a.isin(ACTIONS), F.concat(F.lit("Invalid action '"), a, F.lit("'")))
            .when(
                ~action_is_legal(t, a),
                F.concat(
                    F.lit("Invalid action '"), a, F.lit("' for "), t, F.lit(". Valid: "),
                    F.get(valid_lists, type_order(t) - 1),
                ),
            )
        )
        return let(error, lambda e: F.struct(
            F.when(e.isNull(), t).alias("pii_type"), F.when(e.isNull(), a).alias("action"), e.alias("error")
        ))

    read = changes.withColumn("_read", let(F.split("change", "=", 2), parsed))
    return read.select(*changes.columns, "_read.*")


def update_rules(
    profiles: DataFrame, rules: DataFrame, changes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply changes ``(profile_id, ord, change)``: all of a profile's changes or none.

    Returns profiles (with new ``modified_at``), rules and one outcome row per
    change. The last change of a type wins; a changed rule loses its custom
    description.
    """
    parsed = parse_changes(changes).join(
        profiles.select("profile_id", F.lit(True).alias("_known")), "profile_id", "left"
    ).withColumn("error", F.coalesce(
        F.when(F.col("_known").isNull(), F.concat(F.lit("Profile not found: "), F.col("profile_id").cast("string"))),
        F.col("error"),
    )).drop("_known")
    verdict = parsed.groupBy("profile_id").agg(F.count("error").alias("_bad"))
    good = parsed.join(verdict, "profile_id").where(F.col("_bad") == 0)
    last = good.groupBy("profile_id", "pii_type").agg(F.max_by("action", "ord").alias("_new"))
    # Full: a change of a type that the profile has no rule for makes one.
    new_rules = rules.join(last, ["profile_id", "pii_type"], "full_outer").select(
        "profile_id",
        "pii_type",
        F.coalesce("_new", "action").alias("action"),
        F.when(F.col("_new").isNull(), F.col("description")).alias("description"),
    )
    touched = verdict.where(F.col("_bad") == 0).select("profile_id", F.lit(True).alias("_touched"))
    new_profiles = profiles.join(touched, "profile_id", "left").withColumn(
        "modified_at", F.when(F.col("_touched"), now).otherwise(F.col("modified_at"))
    ).drop("_touched")
    outcome = parsed.join(verdict, "profile_id").select(
        "profile_id", "ord", "change", (F.col("_bad") == 0).alias("applied"), "error"
    )
    return new_profiles, new_rules, outcome


def delete_profiles(
    profiles: DataFrame, rules: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete by request ``(profile_id, profile)``; "default" stays, ids are not used again."""
    found = resolve_profile(requests, profiles)
    protected = F.lower("resolved_name") == "default"
    outcome = found.withColumn(
        "error", F.when(protected, "Cannot delete the default profile").otherwise(F.col("error"))
    )
    gone = outcome.where(F.col("error").isNull()).select(F.col("resolved_id").alias("profile_id")).distinct()
    return (
        profiles.join(gone, "profile_id", "left_anti"),
        rules.join(gone, "profile_id", "left_anti"),
        outcome,
    )


# -- rules ------------------------------------------------------------------

def validate_rules(rules: DataFrame) -> DataFrame:
    """The rule rows whose (type, action) pair is not one of the 18 legal ones."""
    return rules.join(
        F.broadcast(valid_actions(rules.sparkSession)), ["pii_type", "action"], "left_anti"
    )


def rules_long(wide: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per type from one column per type, with the text of each action."""
    long = wide.unpivot(id_cols, PII_TYPES, "pii_type", "action")
    return summarize_rules(long.withColumn("description", F.lit(None).cast("string")), id_cols)


def summarize_rules(rules: DataFrame, id_cols: list[str]) -> DataFrame:
    """Rules in type order with their description: own text, else the table's, else ''."""
    texts = valid_actions(rules.sparkSession).withColumnRenamed("description", "_text")
    return rules.join(F.broadcast(texts), ["pii_type", "action"], "left").select(
        *id_cols,
        type_order(F.col("pii_type")).alias("ord"),
        "pii_type",
        "action",
        F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("_text"), F.lit("")).alias("description"),
    )


def rules_wide(rules: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per profile with one action column per type."""
    return rules.groupBy(*id_cols).pivot("pii_type", PII_TYPES).agg(F.first("action"))


def diff_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed types as ``type (old → new)``."""
    a = old.select("profile_id", "pii_type", F.col("action").alias("old_action"))
    b = new.select("profile_id", "pii_type", F.col("action").alias("new_action"))
    return (
        a.join(b, ["profile_id", "pii_type"], "full_outer")
        .where(~F.col("old_action").eqNullSafe(F.col("new_action")))
        .withColumn("change", F.concat(
            "pii_type", F.lit(" ("), F.coalesce("old_action", F.lit("none")), F.lit(" → "),
            F.coalesce("new_action", F.lit("none")), F.lit(")"),
        ))
    )


def with_rules(df: DataFrame, rules: DataFrame, id_col: str = "profile_id", prefix: str = "action_") -> DataFrame:
    """Add the action of every type, and ``rule_error``, to the rows of a profile or request table.

    A type without a rule has its default action, so that no text passes for
    want of a rule; ``rule_error`` names a rule that is not legal, else null.
    Join it to the profiles, not to the documents: what documents are joined
    with is then one row per profile.
    """
    legal = F.coalesce(action_is_legal(F.col("pii_type"), F.col("action")), F.lit(False))
    bad = F.concat(
        F.lit("Invalid action '"), F.coalesce("action", F.lit("")), F.lit("' for "), F.coalesce("pii_type", F.lit(""))
    )
    wide = rules.groupBy("profile_id").agg(
        *[F.min(F.when(F.col("pii_type") == t, F.col("action"))).alias(prefix + t) for t in PII_TYPES],
        F.min(F.when(~legal, bad)).alias("rule_error"),
    ).withColumnRenamed("profile_id", id_col)
    return df.join(wide, id_col, "left").withColumns(
        {prefix + t: F.coalesce(prefix + t, F.lit(DEFAULT_ACTIONS[t])) for t in PII_TYPES}
    )
