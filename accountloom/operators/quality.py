"""Checks on tables: cell-level differences, uniqueness, allowed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def golden_diff(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every differing cell as ``(keys, field, got, want)``; a lone row is one entry."""
    fields = [c for c in actual.columns if c not in keys]
    a = actual.select(*keys, F.struct(*fields).alias("a"))
    e = expected.select(*keys, F.struct(*fields).alias("e"))
    both = a.join(e, list(keys), "full_outer")
    lone = F.col("a").isNull() | F.col("e").isNull()
    cells = [F.when(~lone & ~F.col(f"a.{f}").eqNullSafe(F.col(f"e.{f}")), F.struct(
        F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("got"),
        F.col(f"e.{f}").cast("string").alias("want"))) for f in fields]

    def presence(side: str):
        return F.when(F.col(side).isNull(), "missing").otherwise("present")

    cells.append(F.when(lone, F.struct(
        F.lit("<row>").alias("field"), presence("a").alias("got"), presence("e").alias("want"))))
    found = F.filter(F.array(*cells), lambda c: c.isNotNull())
    return both.select(*keys, F.inline(found))


def uniqueness_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def disallowed_values(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows holding a value outside an enumeration, with the column and the value."""
    found = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values),
               F.struct(F.lit(c).alias("field"), F.col(c).alias("value")))
        for c, values in allowed.items()]))
    return df.select("*", F.inline(found))
