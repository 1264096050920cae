"""Sinks: CSV with declared columns, JSON lines, report folders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declared(df: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """(header, column) pairs in order; a missing column or value is ''."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select(*[value(c).alias(header) for header, c in columns])


def write_crm_csv(df: DataFrame, columns: Iterable[tuple[str, str]], path: str) -> None:
    declared(df, columns).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; nulls are written, text stays as it is."""
    df.write.option("ignoreNullFields", False).json(path)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Each dataset of a report as CSV in a folder of its own."""
    for name, df in parts.items():
        df.write.option("header", True).csv(f"{path}/{name}")


def write_region(df: DataFrame, path: str, partition: str = "region") -> None:
    df.write.partitionBy(partition).parquet(path)
