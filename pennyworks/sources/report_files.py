"""Reports as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, sort: list[str], path: str) -> None:
    """The column `line` as text under path, in the order of `sort`: part files are ranges, so they follow each other by name. Nulls come first."""
    lines.orderBy(*sort).select("line").write.mode("overwrite").text(path)
