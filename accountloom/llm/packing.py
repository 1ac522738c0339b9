"""Packing of token ids into sequences of one length by cutting stock.

Every document is encoded once.  Its full stretches of ``length`` tokens are
sequences of their own; what remains is a piece shorter than a sequence.  The
histogram of those pieces, at most ``length`` bins, goes to the cutting-stock
program; the rounded patterns give every length class a number of places, and the
documents of a class take them in the order of their rank.  Pieces beyond the
patterns form one stream that is cut wherever a sequence is full; its last, partly
filled stretch is dealt into sequences whose lengths are powers of two, which need
no padding.

Ranks and stream positions are a base per slice of the encoded table plus a count
inside the slice, so no length, however common, meets in one task.

Defined results: a null text is an empty text and is packed as its end id; equal
rows are packed one by one; an empty table gives no pieces; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm.cutting_stock import class_size, plan_patterns
from accountloom.llm.frames import map_arrow, row_slices
from accountloom.llm.tokens import default_tokenizer, encoder
from accountloom.session import pin

ENCODED = ("slice int, pos int, doc_id long, doc_tokens long, full long, full_before long, "
           "rest int, class int, rank long, ids binary")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids of one document, two bytes each where they fit, compressed."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\1" if wide else b"\0") + zstandard.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 1)


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), "<u4" if data[0] else "<u2").astype("<u4")


def _encode(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        pos = full_before = 0
        ranks = np.zeros(2 * capacity + 1, np.int64)  # rows of each class so far
        for batch in batches:
            for part in row_slices(batch, "text"):
                offsets, ids = encoder(tokenizer).encode(part.column("text"))
                rows = part.num_rows
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(rows + 1)
                counts = np.diff(offsets)
                full, rest = counts // capacity, counts % capacity
                kind = np.where(rest > 0, class_size(rest), 0)
                # the place of each row among the rows of its class, in order
                order = np.argsort(kind, kind="stable")
                sizes = np.bincount(kind, minlength=len(ranks))
                inside = np.empty(rows, np.int64)
                inside[order] = np.arange(rows) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rank = ranks[kind] + inside
                ranks += sizes
                ends = offsets.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, number, np.int32)),
                    pa.array(np.arange(pos, pos + rows, dtype=np.int32)),
                    part.column("doc_id"), pa.array(counts), pa.array(full),
                    pa.array(full_before + np.cumsum(full) - full),
                    pa.array(rest.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(rank),
                    pa.array([pack_ids(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
                ], names=["slice", "pos", "doc_id", "doc_tokens", "full", "full_before", "rest",
                          "class", "rank", "ids"])
                pos += rows
                full_before += int(full.sum())

    return run


class Places:
    """Where the rank-th piece of a class goes: a bounded table, looked up by class and rank."""

    def __init__(self, sizes: np.ndarray, plan: list[tuple[dict[int, int], int]]) -> None:
        rows = []
        taken = {int(s): 0 for s in sizes}
        sequence = 0
        for pattern, times in plan:
            slot = 0
            for i, n in sorted(pattern.items()):
                size = int(sizes[i])
                rows.append((size, taken[size], n, sequence, slot))
                taken[size] += n * times
                slot += n
            sequence += times
        self.sequences = sequence
        self.taken = taken
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.size, self.first, self.per, self.sequence, self.slot = table.T

    def find(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, slot)`` of each piece; sequence -1 where the patterns have no place left."""
        limit = np.zeros(int(max([0, *self.taken])) + 2, np.int64)
        for size, n in self.taken.items():
            limit[size] = n
        placed = (kind < len(limit)) & (rank < limit[np.minimum(kind, len(limit) - 1)]) & (kind > 0)
        sequence, slot = np.full(len(kind), -1, np.int64), np.zeros(len(kind), np.int64)
        if placed.any():
            k, r = kind[placed], rank[placed]
            low, high = (np.searchsorted(self.size, k, side) for side in ("left", "right"))
            at = low + np.zeros(len(k), np.int64)
            top = high - 1
            while (at < top).any():  # last row of the class that starts at or before the rank
                mid = (at + top + 1) // 2
                ahead = self.first[mid] <= r
                at, top = np.where(ahead, mid, at), np.where(ahead, top, mid - 1)
            inside = r - self.first[at]
            sequence[placed] = self.sequence[at] + inside // self.per[at]
            slot[placed] = self.slot[at] + inside % self.per[at]
        return sequence, slot


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("class", "rank")}
            sequence, slot = places.find(col["class"].astype(np.int64), col["rank"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("slice"), batch.column("pos"), batch.column("rest"),
                 pa.array(sequence), pa.array(slot)],
                names=["slice", "pos", "rest", "sequence", "slot"])

    return run


def tail_lengths(tokens: int, capacity: int) -> list[int]:
    """Powers of two, largest first, that add up to the last partly filled sequence."""
    rest = tokens % capacity
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(capacity: int, first_cut: int, first_full: int, stream_tokens: int, with_ids: bool):
    whole = stream_tokens // capacity
    tail = tail_lengths(stream_tokens, capacity)
    edges = whole * capacity + np.cumsum([0, *tail])

    def stream_pieces(at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """``(tokens, sequence, offset)`` of a stretch of the stream."""
        while n > 0:
            if at < whole * capacity:
                sequence, offset = divmod(at, capacity)
                room = capacity - offset
            else:
                k = int(np.searchsorted(edges, at, "right")) - 1
                sequence, offset, room = whole + k, at - int(edges[k]), int(edges[k + 1]) - at
            take = min(n, room)
            yield take, first_cut + sequence, offset
            at, n = at + take, n - take

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "ids"):
                out: list[tuple] = []
                blobs: list[bytes] = []
                for r in part.to_pylist():
                    ids = unpack_ids(r["ids"])
                    pieces = [(capacity, first_full + r["full_at"] + k, 0) for k in range(r["full"])]
                    if r["rest"] and r["sequence"] is not None and r["sequence"] >= 0:
                        pieces.append((r["rest"], r["sequence"], r["offset"]))
                    elif r["rest"]:
                        pieces += stream_pieces(r["stream_at"], r["rest"])
                    start = 0
                    for n, sequence, offset in pieces:
                        raw = ids[start:start + n].tobytes()
                        out.append((r["doc_id"], start, n, zlib.crc32(raw), r["doc_tokens"], sequence, offset))
                        if with_ids:
                            blobs.append(raw)
                        start += n
                names = [f.split()[0] for f in PIECES.split(", ")]
                columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int32)
                    values = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack_documents(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None,
                   end_id: int = 1, cut_tokens: int = 8, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place: ``PIECES``, and ``ids`` on demand.

    ``capacity`` is the sequence length.  Sequence numbers are unique; sequences of the
    patterns come first, then those of the cut stream, then the full stretches.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = pin(map_arrow(texts, _encode(tokenizer or default_tokenizer(), end_id, capacity), ENCODED), "encoded")
    by_slice = (encoded.filter("rest > 0").groupBy("class", "slice").agg(F.count(F.lit(1)).alias("n")))
    # one row per length class, of which there are fewer than ``capacity``
    histogram = sorted((r["class"], r["n"]) for r in
                       by_slice.groupBy("class").agg(F.sum("n").alias("n")).collect())
    sizes = np.array([c for c, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.int64)
    fitting = sizes <= capacity
    plan = plan_patterns(sizes[fitting], demand[fitting], capacity, cut_tokens=cut_tokens)
    places = Places(sizes[fitting], plan)

    earlier = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_slice.select("class", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    rests = (encoded.filter("rest > 0").select("slice", "pos", "rest", "class", "rank")
             .join(bases, ["class", "slice"])
             .select("slice", "pos", "rest", "class", (F.col("rank") + F.col("_base")).alias("rank")))
    placed = pin(map_arrow(
        rests, _place(places), "slice int, pos int, rest int, sequence long, slot long"), "placed")

    in_sequence = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    patterned = placed.filter("sequence >= 0").select(
        "slice", "pos", "sequence", F.coalesce(F.sum("rest").over(in_sequence), F.lit(0)).alias("offset"),
        F.lit(None).cast("long").alias("stream_at"))
    cut = placed.filter("sequence < 0")
    per_slice = cut.groupBy("slice").agg(F.sum("rest").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut_bases = per_slice.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    in_slice = Window.partitionBy("slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    streamed = (cut.select("slice", "pos", F.coalesce(F.sum("rest").over(in_slice), F.lit(0)).alias("_in"))
                .join(cut_bases, "slice")
                .select("slice", "pos", F.lit(None).cast("long").alias("sequence"),
                        F.lit(None).cast("long").alias("offset"),
                        (F.col("_base") + F.col("_in")).alias("stream_at")))
    tokens = cut.agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("n")).collect()[0]["n"]
    cut_sequences = tokens // capacity + len(tail_lengths(tokens, capacity))

    full_bases = (encoded.groupBy("slice").agg(F.sum("full").alias("n"))
                  .select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_full")))
    whole = (encoded.select("slice", "pos", "doc_id", "doc_tokens", "full", "full_before", "rest", "ids")
             .join(patterned.unionByName(streamed), ["slice", "pos"], "left")
             .join(full_bases, "slice")
             .select("doc_id", "doc_tokens", "full", "rest", "sequence", "offset", "stream_at", "ids",
                     (F.col("_full") + F.col("full_before")).alias("full_at")))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return map_arrow(
        whole, _cut(capacity, places.sequences, places.sequences + cut_sequences, tokens, with_ids), schema)
