"""Token ids as Parquet list columns that can be read in part.

``write_token_files`` sorts documents by id, encodes whole texts and writes one
file per slice of the order.  Ids are a list column under dictionary encoding,
counts and offsets are delta encoded, row groups and pages have fixed sizes and
every page has its bounds in the page index, so a reader with a filter on
``doc_id`` fetches only the pages that hold it and a reader of counts fetches no
ids at all.

Defined results: a null text is an empty text and gives the end id alone; rows that
repeat a ``doc_id`` stay, ordered by text; null ids come first; an empty table
gives an empty set of files; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountloom.llm.frames import map_arrow, row_slices
from accountloom.llm.tokens import default_tokenizer, encoder
from accountloom.session import pin

SCHEMA = "slice int, pos int, doc_id long, first_token long, n_tokens long, ids array<int>"
SLICE_BYTES = 4 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1_000


def encode_slices(tokenizer: str, end_id: int):
    """Encode sorted partitions: a slice number, the place in it and the ids of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        pos = tokens = 0
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                offsets, ids = encoder(tokenizer).encode(part.column("text"))
                rows = part.num_rows
                ids = np.insert(ids.astype(np.int32), offsets[1:], end_id)
                offsets = offsets + np.arange(rows + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, number, np.int32)),
                    pa.array(np.arange(pos, pos + rows, dtype=np.int32)),
                    part.column("doc_id"),
                    pa.array(tokens + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ], names=["slice", "pos", "doc_id", "first_token", "n_tokens", "ids"])
                pos += rows
                tokens += int(offsets[-1])

    return run


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2,
                      row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
                      page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of every whole text, with ``end_id`` behind it, in ascending order of id."""
    order = ["doc_id", F.xxhash64("text"), "text"]
    sliced = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.coalesce(F.col("text"), F.lit("")).alias("text"))
              .repartitionByRange(*order[:2]).sortWithinPartitions(*order))
    ids = map_arrow(sliced, encode_slices(tokenizer or default_tokenizer(), end_id), SCHEMA)
    (ids.write.option("compression", "snappy")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .mode("errorifexists").parquet(path))


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """The documents of a set of token files with their place in the whole stream.

    Only the named columns and the small counters are read.  ``start`` counts the ids
    of all documents before; one total per file is all that meets in one task.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (files.groupBy("slice").agg(F.sum("n_tokens").alias("_n"))
             .select("slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return (files.select("slice", "doc_id", "first_token", "n_tokens", *columns)
            .join(bases, "slice")
            .select("doc_id", (F.col("_base") + F.col("first_token")).alias("start"), "n_tokens", *columns))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([
            batch.column("slice"), batch.column("doc_id"), batch.column("first_token"),
            pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["slice", "doc_id", "first_token", "n_tokens", "ids_crc32"])


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids in the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    rows = pin(map_arrow(
        files.select("slice", "doc_id", "first_token", "ids"), _digest,
        "slice int, doc_id long, first_token long, n_tokens long, ids_crc32 long"), "token-digest")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("slice").agg(F.sum("n_tokens").alias("_n"))
             .select("slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return rows.join(bases, "slice").select(
        "doc_id", (F.col("_base") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")
