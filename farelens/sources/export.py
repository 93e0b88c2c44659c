"""Write a report to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("json", "parquet")


def export(report: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write a report as JSON records (one object per line) or Parquet.

    NULL fields are written as JSON nulls so that every record carries the report's full shape.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt!r}; use one of {FORMATS}")
    writer = report.write.mode(mode)
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)
