"""Operators on snapshots of variables: key columns, an order, a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("equal", "changed", "unchanged", "increased", "decreased")


def with_previous(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first of a key isn't a change."""
    return with_previous(rows, keys, order, value).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def value_scan(previous: DataFrame, current: DataFrame, keys: list[str], value: str, mode: str, wanted: object = None) -> DataFrame:
    """Keys found in both snapshots whose value did what mode says (equal: is the wanted one)."""
    a, b = F.col("was"), F.col(value)
    rule = {"equal": b == F.lit(wanted), "changed": a != b, "unchanged": a == b, "increased": b > a, "decreased": b < a}[mode]
    return current.join(previous.select(*keys, F.col(value).alias("was")), keys).where(rule)


def latest(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def known_indices(*sides: DataFrame) -> DataFrame:
    """All positive indices that any side has."""
    out = sides[0].select("idx")
    for s in sides[1:]:
        out = out.union(s.select("idx"))
    return out.where("idx > 0").distinct()
