"""A ledger of a stream: every delivered row is counted, repeated or late, and none is lost.

The horizon of a micro-batch is the newest event time of all earlier batches minus the
delay.  A row whose window ended at or before the horizon is late.  Any other row whose
key has been counted before, in an earlier batch or earlier in this one, is repeated.  The
rest is counted.  A window is closed once the horizon has passed its end, and then its
counts are final, since later rows of it are late.

All state is in files under one folder in the shared folder, by number of batch:

* ``ledger/batch=n/outcome=.../day=...``  the rows with their outcome
* ``closed/batch=n``                      final counts of the windows that batch n closed
* ``newest/batch=n``                      the newest event time so far

A batch reads only files of smaller numbers and overwrites its own, so one that is
repeated after a failure writes the same again.  What it reads of the ledger are days that
may still have open windows, whatever the length of the stream.
"""

from __future__ import annotations

import datetime
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accountloom.session import pin

OUTCOMES = ("counted", "repeated", "late")


def _hour(at: str) -> Column:
    return F.date_trunc("hour", F.col(at)).cast("timestamp_ntz")


def _end(at: str) -> Column:
    return _hour(at) + F.expr("interval 1 hour")


def _instant(value: datetime.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Ledger:
    """Counts by hour and ``group`` of rows that ``keys`` tell apart; ``at`` is the event time."""

    def __init__(self, folder: str, schema: StructType, *, keys: Sequence[str], at: str, group: Sequence[str],
                 delay_seconds: int) -> None:
        self.folder, self.schema, self.at = folder, schema, at
        self.keys, self.group, self.delay = list(keys), list(group), datetime.timedelta(seconds=delay_seconds)

    def append(self, stream: DataFrame) -> None:
        """Enter everything that is available and not entered yet."""
        (stream.writeStream.foreachBatch(self._enter).option("checkpointLocation", f"{self.folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())

    def rows(self, spark: SparkSession, outcome: str | None = None) -> DataFrame:
        """All rows entered so far with their ``outcome``."""
        entered = self._read(spark)
        return (entered if outcome is None else entered.filter(F.col("outcome") == outcome)).drop("day", "batch")

    def counts(self, spark: SparkSession) -> DataFrame:
        """``window_start``, the group, ``n`` and ``status``: closed and open windows, and late rows by window."""
        by = [_hour(self.at).alias("window_start"), *self.group]
        horizon = self._horizon(spark, None)
        counted = self.rows(spark, "counted")
        if horizon is not None:
            counted = counted.filter(F.coalesce(_end(self.at) > _instant(horizon), F.lit(True)))
        late = self.rows(spark, "late")
        out = [rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit(status))
               for rows, status in ((counted, "open"), (late, "late"))]
        if _exists(spark, f"{self.folder}/closed"):
            closed = spark.read.schema(out[0].schema).parquet(f"{self.folder}/closed/batch=*")
            out.append(closed.withColumn("status", F.lit("closed")).select(*out[0].columns))
        return functools.reduce(DataFrame.unionByName, out)

    def _read(self, spark: SparkSession) -> DataFrame:
        full = StructType([*self.schema.fields]).add("batch", "long").add("outcome", "string").add("day", "date")
        if not _exists(spark, f"{self.folder}/ledger"):
            return spark.createDataFrame([], full)
        return spark.read.schema(full).option("basePath", f"{self.folder}/ledger").parquet(f"{self.folder}/ledger")

    def _horizon(self, spark: SparkSession, before: int | None) -> datetime.datetime | None:
        """Newest event time of the batches before a number, or of all, minus the delay."""
        if not _exists(spark, f"{self.folder}/newest"):
            return None
        seen = spark.read.schema("newest timestamp_ntz, batch long").option("basePath", f"{self.folder}/newest").parquet(
            f"{self.folder}/newest")
        newest = (seen if before is None else seen.filter(F.col("batch") < before)).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay

    def _enter(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        horizon = self._horizon(spark, number)
        at = F.col(self.at).cast("timestamp_ntz")
        late = F.lit(False) if horizon is None else F.coalesce(_end(self.at) <= _instant(horizon), F.lit(False))
        # pinned, so that the numbers of the rows stay as they are
        rows = pin(batch.withColumns({"_late": late, "_row": F.monotonically_increasing_id()}), "batch")
        known = self._read(spark).filter((F.col("batch") < number) & (F.col("outcome") == "counted"))
        if horizon is not None:  # no other days can hold the key of a row that is not late
            known = known.filter(F.col("day").isNull() | (F.col("day") >= _instant(horizon).cast("date") - 1))
        known = known.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        first = rows.filter("not _late").groupBy(*self.keys).agg(F.min(F.struct(self.at, "_row")).getField("_row").alias("_first"))
        new = first.join(known, functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]),
                         "left_anti").select("_first")
        outcome = F.when(F.col("_late"), "late").when(F.col("_first").isNull(), "repeated").otherwise("counted")
        (rows.join(new, F.col("_row") == F.col("_first"), "left")
         .withColumns({"outcome": outcome, "day": at.cast("date")}).drop("_late", "_row", "_first")
         .write.mode("overwrite").partitionBy("outcome", "day").parquet(f"{self.folder}/ledger/batch={number}"))
        (batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{self.folder}/newest/batch={number}"))
        self._close(spark, horizon, self._horizon(spark, number + 1), number)

    def _close(self, spark: SparkSession, before: datetime.datetime | None, now: datetime.datetime | None,
               number: int) -> None:
        """Final counts of the windows that ended after one horizon and up to the next."""
        counted = self._read(spark).filter((F.col("batch") <= number) & (F.col("outcome") == "counted"))
        ended = _end(self.at)
        closing = counted.filter(F.lit(False) if now is None
                                 else (ended <= _instant(now)) & (F.col("day") <= _instant(now).cast("date")))
        if before is not None:
            closing = closing.filter((ended > _instant(before)) & (F.col("day") >= _instant(before).cast("date") - 1))
        (closing.groupBy(_hour(self.at).alias("window_start"), *self.group).agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{self.folder}/closed/batch={number}"))
