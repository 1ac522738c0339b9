"""Scoring of texts by a weighted backoff automaton over smoothed word n-grams.

A state is a context of up to ``order - 1`` words.  It has an arc for every word seen
behind it, weighted with the smoothed probability, and a failure arc to the state
without its oldest word, weighted with what the context leaves for other words:

    P(w | context) = (count(context w) + m * P(w | shorter)) / (count(context) + m)

The root gives ``(count(w) + 1) / (N + V + 1)``.  Documents stand in blocks of bounded
size.  A block asks the counted n-grams, spread over buckets by hash, for the part of
the automaton that its texts can reach, and then walks its texts from left to right,
one step of all of them at a time, carrying states and adding log-probabilities.
No part of the model is whole on any machine; blocks and buckets grow in number with
the input, never in size.

Defined results: a null text is an empty text, one end token; without training
documents every word has the probability 1; a null id belongs to the training fold;
equal rows are counted and scored one by one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.llm.frames import map_arrow, row_slices, worker_path
from accountloom.llm.word_hashes import mix, token_hashes

BLOCK_BYTES = 6 << 20
BUCKET_KEYS = 1 << 20
CELL = "block int, bucket int, keys binary, counts binary"
ANSWER = "block int, bucket int, counts binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed; their upper planes are nearly empty."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted keys stand in order of their bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class BlockNgrams:
    """The n-grams of a block of texts: one sorted list of keys, and the key that ends at each token."""

    def __init__(self, texts: pa.Array, order: int) -> None:
        self.tokens, self.rows = token_hashes(texts)
        size = len(self.tokens)
        lengths = np.diff(self.rows)
        self.position = np.arange(size) - np.repeat(self.rows[:-1], lengths)
        keys = []
        running = np.zeros(size, np.uint64)
        for n in range(1, order + 1):  # extend every n-gram to the left by one word
            running[n - 1:] = mix(running[n - 1:] * np.uint64(0xD6E8FEB86659FD93)
                                  + self.tokens[:size - n + 1] + np.uint64(n))
            keys.append(running.copy())
        valid = [self.position >= n for n in range(order)]
        self.keys = np.unique(np.concatenate([k[v] for k, v in zip(keys, valid)]))
        self.at = []  # per order: place of the n-gram that ends at the token, -1 if it starts before the text
        for k, v in zip(keys, valid):
            place = np.full(size, -1, np.int64)
            place[v] = np.searchsorted(self.keys, k[v])
            self.at.append(place)

    def counts(self, training: np.ndarray) -> np.ndarray:
        """How often each key occurs in the rows that are learnt from."""
        learnt = np.repeat(training, np.diff(self.rows))
        total = np.zeros(len(self.keys), np.int64)
        for place in self.at:
            total += np.bincount(place[learnt & (place >= 0)], minlength=len(total))
        return total

    def walk(self, counts: np.ndarray, words: int, types: int, strength: Sequence[float]) -> np.ndarray:
        """Log10-probability of each text: one pass from left to right, all texts in step."""
        order = len(self.at)
        count = [np.where(p >= 0, counts[p], 0).astype(float) if len(counts) else np.zeros(len(p)) for p in self.at]
        lengths = np.diff(self.rows)
        by_length = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max()) if len(lengths) else 0
        alive = np.searchsorted(-lengths[by_length], -np.arange(1, longest + 1), "right")
        begin = self.rows[:-1][by_length]
        total = np.zeros(len(lengths))
        # the context of every length that the texts stand in: the count of its words so far
        state = [np.zeros(len(lengths)) for _ in range(order)]
        for step in range(longest):
            n = int(alive[step])
            here = begin[:n] + step
            weight = (count[0][here] + 1) / (words + types + 1)
            for k in range(1, order):
                context = state[k - 1][:n]
                m = strength[k - 1]
                # the arc if the word was seen behind this context, else the failure arc
                weight = np.where(context > 0, (count[k][here] + m * weight) / (context + m), weight)
            total[:n] += np.log10(weight)
            for k in range(order - 1):
                state[k][:n] = count[k][here]
        scores = np.empty(len(lengths))
        scores[by_length] = total
        return scores


def _vocabulary_cells(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", BLOCK_BYTES):
                tokens, _ = token_hashes(part.column("text"))
                keys, counts = np.unique(tokens, return_counts=True)
                yield _cells(0, keys, counts, buckets)

    return run


def _cells(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(keys)] if len(keys) else [0]
    rows = list(zip(edges[:-1], edges[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array([block] * len(rows), pa.int32()),
        pa.array([int(bucket[a]) for a, _ in rows], pa.int32()),
        pa.array([pack_sorted(keys[a:b]) for a, b in rows], pa.binary()),
        pa.array([pack(counts[a:b]) for a, b in rows], pa.binary())],
        names=["block", "bucket", "keys", "counts"])


def _merged(cells: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the cells, the place of each of their keys among all, and the total of each key."""
    keys = [unpack_sorted(k) for k in cells.column("keys").to_pylist()]
    counts = np.concatenate([unpack(c) for c in cells.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return [len(k) for k in keys], place, np.bincount(place, weights=counts.astype(float), minlength=len(distinct))


def _count_types(cells: pa.Table) -> pa.Table:
    _, _, totals = _merged(cells)
    return pa.table({"words": pa.array([int(totals.sum())]), "types": pa.array([len(totals)])})


def _answer(cells: pa.Table) -> pa.Table:
    sizes, place, totals = _merged(cells)
    ends = np.cumsum(sizes).tolist()
    return pa.table({
        "block": cells.column("block").cast(pa.int32()), "bucket": cells.column("bucket").cast(pa.int32()),
        "counts": pa.array([pack(totals[place[b - n:b]].astype(np.uint64)) for n, b in zip(sizes, ends)], pa.binary())})


def _texts(block: pa.Table) -> pa.Array:
    column = block.column("text").combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _ask(order: int, buckets: int):
    def run(block: pa.Table) -> pa.Table:
        grams = BlockNgrams(_texts(block), order)
        training = block.column("training").to_numpy().astype(bool)
        return pa.Table.from_batches([
            _cells(block.column("block")[0].as_py(), grams.keys, grams.counts(training), buckets)])

    return run


def _score(order: int, strength: Sequence[float], words: int, types: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                              ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                              ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        grams = BlockNgrams(_texts(block), order)
        answers = answers.sort_by("bucket")
        counts = np.concatenate([unpack(c) for c in answers.column("counts").to_pylist()]).astype(np.int64)
        seen = counts[grams.at[0]]
        base = np.log10((seen + 1) / (words + types + 1))
        begin = grams.rows[:-1]
        return pa.table({
            "doc_id": block.column("doc_id"),
            "held_out": pa.array(~block.column("training").to_numpy().astype(bool)),
            "n_tokens": pa.array(np.diff(grams.rows)),
            "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(block.num_rows, words, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, begin)),
            "score": pa.array(grams.walk(counts, words, types, strength))})

    return run


def score_documents(docs: DataFrame, training: Column, *, order: int = 2,
                    strength: Sequence[float] = (400.0,)) -> DataFrame:
    """Learn from the rows where ``training`` holds and score every row: ``SCORES``.

    ``strength`` has the weight m of each context length from one word up, in
    observations: how much evidence outweighs the shorter context.
    """
    if len(strength) < order - 1:
        raise ValueError("strength needs a value for every context length")
    worker_path(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(training, F.lit(True)).alias("training"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    buckets = max(1, math.ceil(size / 6 * order / BUCKET_KEYS))

    words = map_arrow(rows.filter("training").select("text"), _vocabulary_cells(buckets), CELL)
    totals = (words.groupBy("bucket").applyInArrow(_count_types, "words long, types long")
              .agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
                   F.coalesce(F.sum("types"), F.lit(0)).alias("types")).collect()[0])

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    blocked = rows.select(block.alias("block"), "doc_id", "text", "training")
    asked = blocked.groupBy("block").applyInArrow(_ask(order, buckets), CELL)
    answers = asked.groupBy("bucket").applyInArrow(_answer, ANSWER)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, tuple(strength), totals["words"], totals["types"]), SCORES)
