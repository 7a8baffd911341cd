"""Actions: replace spans in documents and in plain table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import marks as M
from inkveil.functions import replace as R
from inkveil.functions.arrays import built_once
from inkveil.model import DEFAULT_ACTIONS, PII_TYPES, VALID_ACTIONS
from inkveil.operators.detect import active_types, detect_all


def check_actions(actions: dict) -> None:
    """Refuse fixed actions that are not legal for their type."""
    legal = {(t, a) for t, a, _ in VALID_ACTIONS}
    for t, a in actions.items():
        if t not in PII_TYPES:
            raise ValueError(f"Invalid PII type: {t}")
        if isinstance(a, str) and (t, a) not in legal:
            valid = [x for y, x, _ in VALID_ACTIONS if y == t]
            raise ValueError(f"Invalid action '{a}' for {t}. Valid: {valid}")


def check_salt(salt: str | Column, actions: dict | None = None) -> None:
    """Refuse an empty salt where values may be invented: without one they could be found by trying."""
    invents = actions is None or any(not isinstance(a, str) or a == "invent" for a in actions.values())
    if invents and isinstance(salt, str) and not salt:
        raise ValueError("A salt is needed to invent values")


def action_columns(prefix: str = "action_") -> dict[str, Column]:
    """Actions read from one column per type, as :func:`with_rules` adds them."""
    return {t: F.col(prefix + t) for t in PII_TYPES}


def apply_actions(
    df: DataFrame,
    actions: dict,
    salt: str | Column = "",
    id_col: str = "doc_id",
    pieces_col: str = "pieces",
    out_col: str = "content",
) -> DataFrame:
    """Turn the pieces of each document into the sanitized text; everything else stays.

    Adds ``applied`` (pieces with their replacements) and ``out_col``. Narrow:
    entities are numbered inside the row, the text is never shuffled.
    """
    check_actions(actions)
    check_salt(salt, actions)
    fixed = isinstance(salt, str) and all(isinstance(a, str) for a in actions.values())
    applied = (applied_of if fixed else applied_of.__wrapped__)(pieces_col, tuple(actions.items()), salt, id_col)
    return df.withColumn("applied", applied).withColumn(out_col, R.replaced_text(F.col("applied")))


@built_once
def applied_of(pieces_col: str, actions: tuple, salt: str | Column, id_col: str) -> Column:
    return R.applied_pieces(F.col(pieces_col), dict(actions), salt, F.col(id_col).cast("string"))


def sanitize_text(
    text: Column,
    actions: dict | None = None,
    salt: str | Column = "",
    doc_key: Column | None = None,
    column: str = "",
) -> Column:
    """The sanitized form of a text column, as one expression; ``column`` is the name of a table's column."""
    actions = DEFAULT_ACTIONS if actions is None else actions
    check_actions(actions)
    check_salt(salt, actions)
    types = active_types(actions)
    items = M.pieces(M.marked_value(text, types, column) if column else M.marked(text, types))
    doc_key = F.lit("") if doc_key is None else doc_key
    return R.replaced_text(R.applied_pieces(items, actions, salt, doc_key))


def sanitize_columns(
    df: DataFrame, columns: list[str], actions: dict | None = None, salt: str = "", id_col: str | None = None
) -> DataFrame:
    """Sanitize plain string columns of any table in place; nulls stay null.

    A column's name counts as a table's header does (``ssn``, ``home_phone``,
    ``DateOfBirth``): its values are taken whole.
    Entities are those of one value; ``id_col`` keys the names invented for them.
    """
    fixed = tuple((DEFAULT_ACTIONS if actions is None else actions).items())
    return df.withColumns({c: sanitized_column(c, fixed, salt, id_col) for c in columns})


@built_once
def sanitized_column(column: str, actions: tuple, salt: str, id_col: str | None) -> Column:
    key = None if id_col is None else F.col(id_col).cast("string")
    return sanitize_text(F.col(column), dict(actions), salt, key, column)


def sanitize_documents(
    df: DataFrame,
    actions: dict | None = None,
    salt: str = "",
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "content",
    found: DataFrame | None = None,
) -> DataFrame:
    """Detect and replace in one go; adds ``pieces``, ``applied`` and ``out_col``.

    ``found`` is what :func:`detect_all` returned for ``df`` and the same types (or more), where several
    sets of actions or a check share one detection; the text is not gone over again then.
    """
    actions = DEFAULT_ACTIONS if actions is None else actions
    if found is None:
        found = detect_all(df, actions, text_col)
    return apply_actions(found, actions, salt, id_col, out_col=out_col)


def replaced_spans(applied: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per span of ``applied``: ``(*id_cols, pii_type, rule, value, replacement)``.

    The array is filtered inside ``explode``: exploding the bare column would
    make the optimizer test its size first and so compute it again.
    """
    spans = F.filter("applied", lambda p: p["pii_type"].isNotNull())
    return applied.select(*id_cols, F.explode(spans).alias("p")).select(*id_cols, "p.*")


def removal_counts(applied: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """Replaced spans by type (and by ``id_cols``); summed per task before the shuffle."""
    id_cols = id_cols or []
    return (
        replaced_spans(applied, id_cols)
        .where(F.col("replacement") != F.col("value"))
        .groupBy(*id_cols, "pii_type")
        .agg(F.count("*").alias("replaced"))
    )
