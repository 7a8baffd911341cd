"""CSV files as Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.sources.text import decode_text, table_markdown
from inkveil.sources.unpack import csv_rows


def csv_cells(df: DataFrame) -> DataFrame:
    """Add ``rows`` (``ARRAY<ARRAY<STRING>>``, header first), counts and errors; narrow.

    An empty file or a row longer than the header is an error.
    """
    parsed = df.withColumn("_csv", csv_rows(decode_text(F.col("content"))))
    return csv_columns(parsed, F.col("_csv")).drop("_csv")


def csv_columns(df: DataFrame, parsed: Column) -> DataFrame:
    failed = parsed["error"].isNotNull()
    return df.withColumns({
        "rows": parsed["rows"],
        "row_count": F.when(~failed, F.size(parsed["rows"]) - 1),
        "column_count": F.when(~failed, F.size(F.get(parsed["rows"], F.lit(0)))),
        "error_code": F.when(failed, "CSV_PARSE"),
        "error": F.when(failed, F.concat(F.lit("Failed to parse CSV file: "), parsed["error"])),
    })


def extract_csv(df: DataFrame) -> DataFrame:
    """CSV bytes to a Markdown table; raw cell text is kept."""
    return csv_cells(df).withColumn("source_type", F.lit("csv")).withColumn(
        "content", F.when(F.col("error").isNull(), table_markdown(F.col("rows")))
    ).drop("rows")
