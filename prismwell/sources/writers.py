"""Writers: fixed columns, JSON lines, single documents, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> bool:
    """Write the columns in this order; nothing at all for no rows."""
    if df.isEmpty():
        return False
    df.select(*columns).write.option("header", True).csv(path)
    return True


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def document(df: DataFrame, pretty: bool = True) -> DataFrame:
    """(value): each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """(value): each row as a line of a Markdown table, cells escaped."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))
