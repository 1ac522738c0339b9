"""CSV exports: delimiter, header row below titles, quoted fields, short rows.

A quoted cell may span lines, so where a record starts depends on every quote before it.
A file is still read by many tasks, in two passes over its lines.  The first counts the
quotes of each stretch of the file; the running total over stretches tells which of them
begin inside a quoted cell.  The second then knows for each line whether it starts a
record.  Only lines of records that span several are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountloom.operators.gates import delimiter, plain
from accountloom.session import pin


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Most frequent of , ; tab | on the first line that is not blank."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1)
    found = first.select(delimiter(F.col("value"))).first()
    return found[0] if found else ","


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, record``: the records of quoted text files, in order of ``at`` (stretch, line) in each file.

    A quote opens or closes a quoted cell wherever it stands, a doubled one does both, so
    a line starts a record if an even number of quotes stands before it.  A quote that is
    never closed takes the rest of its file into one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    lines = pin(lines.withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))), "csv-lines")
    # one row per stretch of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    above = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.join(blocks, ["file", "block"]).withColumn(
        "open", (F.col("before") + F.coalesce(F.sum("quotes").over(above), F.lit(0))) % 2 == 1)
    whole = ~F.col("open") & (F.col("quotes") % 2 == 0)
    at = F.struct("block", "line")
    single = counted.filter(whole).select("file", at.alias("at"), F.col("text").alias("record"))

    parts = counted.filter(~whole).withColumn("start", F.when(~F.col("open"), at))
    # the start of the record that a stretch begins in
    lasts = parts.groupBy("file", "block").agg(F.max("start").alias("last")).withColumn(
        "carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = parts.join(lasts, ["file", "block"]).withColumn(
        "owner", F.coalesce(F.last("start", ignorenulls=True).over(upto), "carried"))
    joined = owned.groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct(
        "block", "line", "text"))).alias("lines"))
    several = joined.select("file", "at", F.array_join(F.transform("lines", lambda p: p["text"]), "\n").alias("record"))
    return single.unionByName(several)


def cells_of(record: Column, sep: str) -> Column:
    """The cells of a record, without their quotes; line ends of the file are dropped outside quotes."""
    cut = re.escape(sep)
    cell = rf'{cut}((?:[^"{cut}]++|"(?:[^"]++|"")*+(?:"|\z))*+)'
    bare = F.concat(F.lit(sep), F.regexp_replace(record, r"\r+\z", ""))

    def unquoted(c: Column) -> Column:
        opened = F.regexp_replace(c, r'"((?:[^"]++|"")*+)(?:"|\z)', "$1")
        return F.when(F.contains(c, F.lit('"')), F.replace(opened, F.lit('""'), F.lit('"'))).otherwise(
            F.replace(c, F.lit("\r"), F.lit("")))

    return F.transform(F.regexp_extract_all(bare, F.lit(cell), 1), unquoted)


def read_csv(spark: SparkSession, path: str, *, sep: str | None = None,
             header_words: Sequence[str] = ()) -> DataFrame:
    """All-text rows under trimmed header names, in order; missing cells are ''.

    Without ``header_words`` the first row of each file is its header.  With them the
    header is the first row that holds at least two of the words, and title rows above it
    are left out.  The files of one call have the same columns; the first file's header
    names them.  Blank rows are left out, and so are cells beyond the header.
    """
    sep = sep or detect_delimiter(spark, path)
    rows = read_records(spark, path).withColumn("cells", cells_of(F.col("record"), sep)).drop("record")
    filled = pin(rows.filter(F.exists("cells", lambda c: F.trim(F.regexp_replace(c, r"\s", " ")) != "")), "csv-records")
    candidates = filled
    if header_words:
        wanted = [plain(w) for w in header_words]
        hits = F.size(F.filter("cells", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "").isin(*wanted)))
        candidates = filled.filter(hits >= min(2, len(wanted)))
    heads = candidates.groupBy("file").agg(F.min(F.struct("at", "cells")).alias("head")).select("file", "head.*")
    first = heads.orderBy("file").limit(1).first()
    if first is None:
        raise ValueError(f"{path}: no header row found")
    names = [name.strip() or f"column_{i}" for i, name in enumerate(first["cells"], 1)]
    body = filled.join(heads.select("file", F.col("at").alias("_head")), "file").filter(F.col("at") > F.col("_head"))
    return body.orderBy("file", "at").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
