"""Collocations by language, counted in HAT-tries.

Every task reads slices of whole texts into one trie per language, whose keys are ids of
the task's own word list.  When the tries hold too many phrases, the largest subtrees are
taken out and written as a run, sorted by words and cut into prefix partitions.  All runs
of a partition meet in one task, which merges them and keeps the phrases that occur often
enough.  Scores, containment and ranks are joins and aggregates over those.

A prefix partition belongs to the first two words of a phrase.  The phrases below one such
prefix spread by their third word over ``fan`` neighbouring partitions; ``fan`` grows with
the number of partitions, so that a pair that opens a third of all phrases makes its
partitions about six times as large as the others, at any size of the input.

Defined results: a null text is empty and has no phrase; a null language is ``und``; an
empty language is a language of its own; repeated rows count each time; texts of any
length are read whole; documents without words add nothing, and a table without words
gives no rows; only ``text`` and ``lang`` are read, so other columns may have any name.
Equal scores stand by count, then by the bytes of the phrase.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm.frames import map_arrow, row_slices, worker_path
from accountloom.llm.hat_trie import DEPTH, HatTrie, path_keys, path_words
from accountloom.session import pin

SLICE_BYTES = 2 << 20
PART_BYTES = 3 << 20
HELD_PHRASES = 1 << 20
HELD_WORDS = 400_000
_NOTHING = pa.scalar(b"", pa.large_binary())
RUN = "lang string, part int, run binary"
COUNTED = "lang string, words int, phrase binary, f long"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PIECES = bytes.maketrans(_BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(_BREAKS) + b"abcdefghijklmnopqrstuvwxyz")


class _Words:
    """Ids of the words a task has met, from 1 on; 0 stands for no word."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.sorted: list[bytes] = []
        self.hashes = np.zeros(1, np.uint64)

    def read(self, tokens: list[bytes]) -> np.ndarray:
        """Ids of all words in order, with a 0 between pieces."""
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        stop = self.ids.get(b".")
        return np.where(ids == stop, 0, ids) if stop else ids

    def tables(self) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """By id: words, words behind a space, places in byte order, and hashes."""
        new = list(itertools.islice(self.ids, len(self.sorted), None))
        self.hashes = np.concatenate((self.hashes, np.fromiter(map(zlib.crc32, new), np.uint64, len(new))))
        self.sorted = sorted(self.sorted + sorted(new))  # two sorted runs, which the sort merges
        rank = np.zeros(len(self.sorted) + 1, np.int64)
        rank[np.fromiter(map(self.ids.__getitem__, self.sorted), np.int64, len(self.sorted))] = np.arange(
            1, len(self.sorted) + 1)
        words = pa.array([b"", *self.ids], pa.large_binary())
        behind = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), words, _NOTHING)
        return words, pa.concat_arrays([words[:1], behind[1:]]), rank, self.hashes


def _chunks(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in stretches of about ``limit`` bytes that cut no word."""
    low = 0
    while low < len(text):
        high = low + limit
        if high < len(text):
            near = max(text.rfind(c, low, high) for c in (b" ", b"\t", b"."))
            if near < 0:
                ahead = [p for p in (text.find(c, high) for c in (b" ", b"\t", b".")) if p >= 0]
                near = min(ahead, default=len(text) - 1)
            high = near + 1
        yield text[low:high]
        low = high


def _phrases_of(ids: np.ndarray, longest: int, carried: int = 0) -> np.ndarray:
    """Keys of all phrases inside pieces that end behind the first ``carried`` words, sorted."""
    whole, ends = ids > 0, np.arange(len(ids)) >= carried
    keys = []
    for n in range(1, longest + 1):
        if len(ids) >= n:
            words = [ids[i:len(ids) - n + 1 + i] for i in range(n)]
            inside = ends[n - 1:].copy()
            for i in range(n):
                inside &= whole[i:len(ids) - n + 1 + i]
            keys.append(path_keys(*(w[inside] for w in words)))
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def partition_of(first: np.ndarray, second: np.ndarray, third: np.ndarray, parts: int) -> np.ndarray:
    """The prefix partition of phrases given by hashes of their words (0: no word)."""
    prefix = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)
    fan = np.uint64(parts // 16 + 1)
    below = np.where(third == 0, np.uint64(0), (third * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % fan)
    return ((prefix + below) % np.uint64(parts)).astype(np.int64)


def _runs(lang: str, keys: np.ndarray, counts: np.ndarray, tables, parts: int) -> Iterator[tuple[str, int, bytes]]:
    """The phrases as sorted runs, one for each prefix partition."""
    words, behind, rank, hashes = tables
    ids = path_words(keys)
    part = partition_of(*(hashes[i] for i in ids), parts)
    order = np.lexsort((path_keys(*(rank[i] for i in ids)), part))
    ids, part, counts = [i[order] for i in ids], part[order], counts[order]
    phrases = pc.binary_join_element_wise(words.take(pa.array(ids[0])), behind.take(pa.array(ids[1])),
                                          behind.take(pa.array(ids[2])), _NOTHING)
    offsets = np.frombuffer(phrases.buffers()[1], np.int64)[:len(phrases) + 1]
    data = memoryview(phrases.buffers()[2])
    packer = zstandard.ZstdCompressor(level=1)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lengths = np.diff(offsets[a:b + 1]).astype("<u4")
        yield lang, int(part[a]), packer.compress(b"".join((
            np.array([b - a], "<u4").tobytes(), lengths.tobytes(), counts[a:b].astype("<u8").tobytes(),
            data[offsets[a]:offsets[b]])))


def _read_run(run: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.decompress(run)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 12 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    starts = np.concatenate(([4 + 12 * n], ends[:-1]))
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], np.frombuffer(raw, "<u8", n, 4 + 4 * n)


def _count_phrases(longest: int, parts: int, held: int, burst: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tries, size = _Words(), {}, 0

        def spill(keep: int) -> Iterator[pa.RecordBatch]:
            if not tries:
                return
            tables = words.tables()
            for lang, trie in tries.items():
                keys, counts = trie.spill(keep * len(trie) // max(size, 1))
                if len(keys):
                    rows = list(zip(*_runs(lang, keys, counts, tables, parts)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())],
                        names=["lang", "part", "run"])

        for batch in batches:
            for part in row_slices(batch, "text", slice_bytes):
                texts = defaultdict(list)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    texts[lang].append(text)
                for lang, whole in texts.items():
                    carried: list[bytes] = []
                    for chunk in _chunks(b".".join(whole).translate(_PIECES), slice_bytes):
                        tokens = carried + chunk.replace(b".", b" . ").split()
                        if lang not in tries:
                            tries[lang] = HatTrie(burst)
                        tries[lang].add(_phrases_of(words.read(tokens), longest, len(carried)))
                        carried = tokens[1 - longest:] if longest > 1 else []
                        size = sum(map(len, tries.values()))
                        if len(words.ids) > HELD_WORDS:  # a new word list needs empty tries
                            yield from spill(0)
                            words, tries, size = _Words(), {}, 0
                        elif size > held:
                            yield from spill(held // 4)
                            tries = {lang: trie for lang, trie in tries.items() if len(trie)}
        yield from spill(0)

    return run


def _merge_runs(least: int):
    def run(group: pa.Table) -> pa.Table:
        out = {"lang": [], "words": [], "phrase": [], "f": []}
        by_lang = defaultdict(list)
        for lang, packed in zip(group.column("lang").to_pylist(), group.column("run").to_pylist()):
            by_lang[lang].append(packed)
        for lang, runs in by_lang.items():
            phrases, counts = [], []
            for packed in runs:
                more, n = _read_run(packed)
                phrases += more
                counts.append(n)
            # the sort finds the sorted runs and merges them
            order = sorted(range(len(phrases)), key=phrases.__getitem__)
            merged = pa.array(phrases, pa.large_binary()).take(pa.array(order))
            del phrases
            fresh = np.ones(len(merged), bool)
            fresh[1:] = pc.not_equal(merged[1:], merged[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(fresh)
            totals = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), starts)
            merged = merged.take(pa.array(starts))
            words = 1 + pc.count_substring(merged, b" ").to_numpy()
            kept = np.flatnonzero(totals >= least)
            out["lang"] += [lang] * (len(kept) + 1)
            out["words"] += [*words[kept].tolist(), 0]
            out["phrase"] += [*merged.take(pa.array(kept)).to_pylist(), b""]
            out["f"] += [*totals[kept].tolist(), int(totals[words == 1].sum())]
        return pa.table(out, pa.schema([("lang", pa.string()), ("words", pa.int32()),
                                        ("phrase", pa.binary()), ("f", pa.int64())]))

    return run


def phrase_counts(docs: DataFrame, *, longest: int = 3, least: int = 10,
                  held: int = HELD_PHRASES, burst: int = 1 << 14, part_bytes: int = PART_BYTES,
                  slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``lang, words, phrase, f``: every phrase of up to ``longest`` words that occurs ``least`` times.

    Rows with ``words`` 0 hold numbers of words; their sum by language is the number of all
    its word occurrences, rare words included.
    """
    if not 1 <= longest <= DEPTH:
        raise ValueError("phrases have one to three words")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    parts = max(1, math.ceil(size / part_bytes))
    worker_path(docs.sparkSession)
    runs = map_arrow(rows, _count_phrases(longest, parts, held, burst, slice_bytes), RUN)
    return (runs.groupBy("part").applyInArrow(_merge_runs(least), COUNTED)
            .withColumn("phrase", F.col("phrase").cast("string")))


def collocations(docs: DataFrame, *, least: int = 10, top: int = 2000, contained: int = 50) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: ``lang, rank, phrase, a, l, r, n, score, words, cut``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words;
    the score is ``floor(1000000 a a / (l r))``.  A phrase goes if a longer one with at
    least ``contained`` percent of its count holds it.
    """
    counted = pin(phrase_counts(docs, least=least), "phrases")
    totals = counted.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    found = counted.filter("words > 0")
    part = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    phrase, last = F.col("phrase"), F.substring_index("phrase", " ", -1)
    first = F.substring_index("phrase", " ", 1)

    def cut(rows: DataFrame, number: int, left, right) -> DataFrame:
        """Counts of both parts and the score of one cut."""
        for name, text in (("l", left), ("r", right)):
            looked = part.select(F.col("lang").alias("_lang"), "part", F.col("part_f").alias(name))
            rows = rows.join(looked, (F.col("lang") == F.col("_lang")) & (text == F.col("part"))).drop("_lang", "part")
        wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
        rows = rows.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * (wide["a"] * wide["a"]).cast("decimal(31,0)"))
        rows = rows.withColumn("under", wide["l"] * wide["r"])
        return rows.withColumn("cut", F.struct(F.expr("over div under").alias("score"), F.lit(number).alias("k"), "l", "r")
                               ).drop("over", "under", "l", "r")

    candidates = found.filter("words > 1").withColumnRenamed("f", "a")
    pairs = cut(candidates.filter("words = 2"), 1, first, last)
    triples = candidates.filter("words = 3")
    behind = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    both = cut(cut(triples, 1, first, behind).withColumnRenamed("cut", "cut_1"), 2,
               F.substring_index("phrase", " ", 2), last)
    triples_scored = both.withColumn("cut", F.least("cut_1", "cut")).drop("cut_1")
    around = triples.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), behind)).alias("phrase"),
                            F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = (pairs.join(around, ["lang", "phrase"], "left")
             .filter(F.col("longer").isNull()
                     | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(contained).cast("decimal(3,0)") * F.col("a")))
             .drop("longer"))
    scored = alone.unionByName(triples_scored).select("lang", phrase, "a", "words", "cut.*")
    # a language may have most phrases: each of its 32 shares keeps its first ones before they meet
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(32))
    first = (scored.withColumn("share", share)
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
             .filter(F.col("rank") <= top).drop("share"))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                    "words", F.col("k").alias("cut")))
