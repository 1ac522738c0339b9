"""Order-dependent operators that stay distributed: modes, ranks, order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.session import pin


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``newest_first``.

    ``row_number() = 1`` lets Spark keep one row per key inside every map task
    before it shuffles, so a key that holds most of the rows costs one row per
    task.
    """
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_seen_mode(df: DataFrame, keys: Sequence[str], value: str, position: str,
                    weight: str | None = None) -> DataFrame:
    """Most frequent value per key; ties go to the value seen first.

    Counts are combined per (key, value) on the map side, so only distinct
    values reach the second step.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    per_value = df.groupBy(*keys, value).agg(count.alias("_n"), F.min(position).alias("_p"))
    return per_value.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col("_p"))).alias(value),
        F.max("_n").alias("n"))


def running_total(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order`` over the whole table.

    The rows are range-partitioned and pinned with their partition number; one
    subtotal per partition gives every partition its offset.  Only the table of
    subtotals, one row per partition, is ever seen by a single task.
    """
    sliced = pin(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()),
                 "ranged")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy("_slice").agg(F.sum(weight).alias("_w"))
               .select(F.col("_slice"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off")))
    inside = (Window.partitionBy("_slice").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (sliced.join(offsets, "_slice")
            .withColumn(name, (F.col("_off") + F.sum(weight).over(inside)).cast("long"))
            .drop("_slice", "_off"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks 1..n without sorting the table in one task; ``order`` must be unique."""
    return running_total(df, order, F.lit(1), name)


def order_statistics(df: DataFrame, fields: Mapping[str, Column], fractions: Mapping[str, float],
                     *, positive_only: bool = True) -> DataFrame:
    """Exact ``sorted[min(n-1, floor(n*p))]`` per field, as a one-row table.

    Columns are ``<field>_n`` and ``<field>_<label>``; an empty population gives 0.
    Equal values are counted on the map side, so the sort sees each distinct
    value once however often it occurs.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value"))
                        for f, c in fields.items()])
    values = df.select(F.inline(entries)).filter(
        F.col("value") > 0 if positive_only else F.col("value").isNotNull())
    ordered = running_total(
        values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("cnt")),
        [F.col("field"), F.col("value")], F.col("cnt"), "upto")
    last = ordered.groupBy("field").agg(F.sum("cnt").alias("n"), F.max("upto").alias("end"))
    # one row per field named by the caller, so this side cannot grow with the data
    placed = ordered.join(F.broadcast(last), "field").withColumn("upto", F.col("upto") - F.col("end") + F.col("n"))
    aggs = []
    for f in fields:
        mine = F.col("field") == f
        aggs.append(F.coalesce(F.max(F.when(mine, F.col("n"))), F.lit(0)).alias(f"{f}_n"))
        for label, p in fractions.items():
            k = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(p))))
            hit = mine & (F.col("upto") > k) & (F.col("upto") - F.col("cnt") <= k)
            aggs.append(F.coalesce(F.max(F.when(hit, F.col("value"))), F.lit(0)).alias(f"{f}_{label}"))
    return placed.agg(*aggs)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A report of ``n`` rows; Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)


def first_seen_names(df: DataFrame, keys: Sequence[str], name: str, shown: Column, position: str,
                     cap: int) -> DataFrame:
    """Names per key without case-only repeats, in first-seen order.

    Returns the first ``cap`` of them plus the number left out; at most ``cap``
    names per key are ever brought together.
    """
    named = df.withColumn("_n", F.trim(name)).filter(F.col("_n") != "").withColumn("_show", shown)
    distinct = (named.groupBy(*keys, F.lower("_n").alias("_low"))
                .agg(F.min_by("_show", position).alias("_show"), F.min(position).alias("_p")))
    counted = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    w = Window.partitionBy(*keys).orderBy("_p")
    kept = (distinct.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_show"))).alias("_l")))
    return kept.join(counted, list(keys)).select(
        *keys, F.transform("_l", lambda s: s["_show"]).alias("names"),
        F.greatest(F.lit(0), F.col("_all") - cap).alias("overflow"))
