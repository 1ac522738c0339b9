"""Distribution gate: a value far beyond the 99th percentile is kept but not trusted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.functions.measures import thousands
from accountloom.operators.ordering import order_statistics

FRACTIONS = {"p99": 0.99, "median": 0.5}


def gate_statistics(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    return order_statistics(df, fields, FRACTIONS)


def cold_note(field: str, value: Column, p99: Column, median: Column, factor: int) -> Column:
    return F.concat(
        F.lit(f"{field} "), thousands(value), F.lit(" exceeds p99 ("), thousands(p99),
        F.lit(f" lb) x {factor}; median is "), thousands(median),
        F.lit(" lb. Probable units error or NAICS misclassification in the self-reported "
              "filing. Excluded from scoring pending human review."))


def water_note(field: str, value: Column, p99: Column, median: Column, factor: int) -> Column:
    return F.concat(
        F.lit(f"{field} "), thousands(value), F.lit(" exceeds p99 ("), thousands(p99),
        F.lit(f" lb) x {factor}; median "), thousands(median),
        F.lit(" lb. Probable units error, bulk storage terminal, or misfiled "
              f"{field.split('_')[0]} plant. Excluded from scoring pending human review."))


def flag_outliers(df: DataFrame, fields: Mapping[str, Column], factor: int, note=cold_note,
                  stats: DataFrame | None = None) -> DataFrame:
    """Add ``validated`` and ``validation_note``; notes of several fields join with " | ".

    The statistics are one row, two values per field; they are read once and become
    constants, so that no later plan carries them.
    """
    row = (gate_statistics(df, fields) if stats is None else stats).first()
    notes = []
    for f, value in fields.items():
        p99, median = (F.lit(row[f"{f}_{k}"]).cast("long") for k in ("p99", "median"))
        notes.append(F.when(value > p99 * factor, note(f, value, p99, median, factor)))
    joined = F.concat_ws(" | ", *notes)
    return df.withColumn("validation_note", joined).withColumn(
        "validated", F.col("validation_note") == "")
