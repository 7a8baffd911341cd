"""The whole way: documents and profiles in, sanitized documents with frontmatter out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import marks as M
from inkveil.functions import replace as R
from inkveil.functions.arrays import built_once
from inkveil.model import PII_TYPES
from inkveil.operators.actions import action_columns, check_salt
from inkveil.operators.output import frontmatter, output_name, prompt_text, rewrite_with, rules_section
from inkveil.operators.profiles import add_default_rules, is_small, resolve_profile, with_rules

RULES_MODEL = "spark-rules"


@built_once
def applied_by_columns(salt: str) -> Column:
    """The pieces of readable documents with replacements by their own action columns."""
    text = F.when(F.col("error").isNull(), F.col("content"))
    items = M.pieces(M.marked(text, PII_TYPES))
    return R.applied_pieces(items, action_columns(), salt, F.col("doc_id"))


def requests_of(documents: DataFrame) -> DataFrame:
    """Documents with the columns a request has; their own error as ``_read_error``."""
    df = documents
    for c, t in (("profile_id", "long"), ("profile", "string"), ("error", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df.withColumnRenamed("error", "_read_error")


def sanitize(
    documents: DataFrame,
    profiles: DataFrame,
    rules: DataFrame,
    now: Column,
    salt: str,
) -> DataFrame:
    """Sanitize documents, each by the profile it asks for.

    ``documents`` follow the document schema, with optional ``profile_id`` and
    ``profile`` columns. Every input row comes out: those that could not be
    read, whose profile is unknown or has a rule that is not legal, with
    ``error`` and no content. ``salt`` keeps invented values from being found
    by trying; it may not be empty, as any profile may invent.
    """
    check_salt(salt)
    asked = requests_of(documents)
    # Profiles and rules meet first, so the documents go through one join.
    known = with_rules(profiles.select("profile_id", "name"), rules)
    ruled = resolve_profile(asked, known, small=is_small(profiles, rules)).withColumn(
        "error", F.coalesce("_read_error", "error", "rule_error")
    )
    head = frontmatter(F.col("source_type"), now, F.lit(RULES_MODEL), F.col("resolved_name"))
    return ruled.withColumn("applied", applied_by_columns(salt)).select(
        "doc_id",
        output_name(F.col("filename")).alias("output_name"),
        "source_type",
        now.alias("sanitization_timestamp"),
        F.lit(RULES_MODEL).alias("model_used"),
        F.col("resolved_name").alias("profile_used"),
        F.when(F.col("applied").isNotNull(), F.concat(head, R.replaced_text(F.col("applied")))).alias("content"),
        "error",
    )


def sanitize_with_model(
    documents: DataFrame,
    profiles: DataFrame,
    rules: DataFrame,
    make_model: Callable[[], Callable[[str, dict], str]],
    now: Column,
    model: str,
    options: dict | None = None,
) -> DataFrame:
    """The way with a model: rules to prompt, prompt to answer, answer with frontmatter.

    Every input row comes out. Rows that could not be read, ask for an unknown
    profile or one with a rule that is not legal are not sent; they and rows
    whose call failed have ``error``, no ``content``, and their text in ``input``.
    Types without a rule take their default one.
    """
    defaults = add_default_rules(profiles).select("profile_id", "pii_type", F.col("action").alias("_default"))
    filled = defaults.join(rules.select("profile_id", "pii_type", "action"), ["profile_id", "pii_type"], "left").select(
        "profile_id", "pii_type", F.coalesce("action", "_default").alias("action")
    )
    errors = with_rules(profiles.select("profile_id"), rules).select("profile_id", "rule_error")
    known = (
        profiles.select("profile_id", "name")
        .join(rules_section(filled, ["profile_id"]), "profile_id", "left")
        .join(errors, "profile_id", "left")
    )
    found = resolve_profile(requests_of(documents), known, small=is_small(profiles, rules))
    refused = F.coalesce("_read_error", "error", "rule_error")
    asked = found.select(
        "doc_id", "filename", "source_type", F.col("content").alias("input"), "resolved_name", refused.alias("_refused"),
        F.when(refused.isNull(), prompt_text(F.coalesce("rules_text", F.lit("")), F.col("content"))).alias("prompt"),
    )
    done = rewrite_with(asked, make_model, options=options)
    head = frontmatter(F.col("source_type"), now, F.lit(model), F.col("resolved_name"))
    return done.select(
        "doc_id",
        output_name(F.col("filename")).alias("output_name"),
        "source_type",
        now.alias("sanitization_timestamp"),
        F.lit(model).alias("model_used"),
        F.col("resolved_name").alias("profile_used"),
        F.when(F.col("response").isNotNull(), F.concat(head, F.col("response"))).alias("content"),
        F.when(F.col("response").isNull(), F.col("input")).alias("input"),
        F.coalesce("_refused", "error").alias("error"),
    )
