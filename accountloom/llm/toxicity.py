"""Toxicity of whole texts by a bidirectional gated recurrent network over all their windows.

A text is its words (letters, digits and everything beyond ASCII, A-Z lower-cased) in
overlapping windows of ``WIDTH`` words, one every ``STRIDE``.  The network scores each
window; the highest logit is the text's, and a line fitted on documents that the network
has not seen turns it into a probability under the true share of toxic documents.

Labels are learnt by several instances: a toxic document is toxic in some window.  At
first that is the window with the words that are commonest in toxic documents against
others; then the network chooses the windows itself, the most toxic one of every document,
clean documents included, and learns again.

The network is fitted on at most ``sample`` labelled documents of each label, chosen by a
hash of their ids; only some of their windows, of fixed width, reach the driver.  Shares of
labels count all labelled training rows, and every text is scored whole.

Defined results: a null text is empty; a text without words is one empty window; texts
beyond ``PIECE`` bytes are read in pieces that overlap by ``WIDTH`` words (a word beyond
that size counts as several); equal texts have equal scores; a document with several labels
is toxic if one of them says so; null labels and ids label nothing, and null ids are scored;
without labelled documents of both kinds every score is the share of toxic ones (0 without
any); an empty table gives no rows.  Of ``docs`` only the kept columns and ``text`` are read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm import recurrent
from accountloom.llm.frames import map_arrow, row_slices
from accountloom.session import pin

WIDTH, STRIDE = 32, 16
SLICE_BYTES = 1 << 20
PIECE = 1 << 20
SEED = 11

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))
CHOSEN = "number long, label int, logit float, words binary, chars binary, sizes binary"


@dataclass
class ToxicityModel:
    weights: recurrent.Weights | None
    slope: float
    offset: float
    share: float

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(logits), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits.astype(float) + self.offset, -500, 500)))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces; each begins ``WIDTH`` words before the end of the last."""
    low = 0
    while True:
        high = low + PIECE
        if high >= len(text):
            yield text[low:]
            return
        cut = text.rfind(b" ", low + PIECE // 2, high)
        high = cut if cut >= 0 else high
        yield text[low:high]
        back = high
        for _ in range(WIDTH):
            at = text.rfind(b" ", low + PIECE // 2, back)
            if at < 0:
                break
            back = at
        low = back if back > low else high


class SliceWindows:
    """All windows of some texts over the list of their distinct words."""

    def __init__(self, texts: list[bytes | None]) -> None:
        ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        owner, tokens, lengths = [], [], []
        for row, text in enumerate(texts):
            for piece in _pieces((text or b"").translate(_WORDS)):
                words = piece.split()
                owner.append(row)
                lengths.append(len(words))
                tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        length = np.array(lengths, np.int64)
        count = np.maximum(1, -(-(length - WIDTH) // STRIDE) + 1)
        owners = np.repeat(np.arange(len(length)), count)
        nth = np.arange(len(owners)) - np.repeat(np.cumsum(count) - count, count)
        begin = (np.cumsum(length) - length)[owners] + nth * STRIDE
        left = length[owners] - nth * STRIDE
        all_tokens = np.concatenate([*tokens, np.zeros(WIDTH, np.int32)])
        step = np.arange(WIDTH)
        self.at = np.where(step < left[:, None], all_tokens[begin[:, None] + step], np.int32(-1))
        self.row = np.array(owner, np.int64)[owners]
        self.rows = len(texts)
        found = list(ids)
        self.words = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % recurrent.WORD_BUCKETS
        data = np.frombuffer(b"\0" + b"\0".join(found) + b"\0", np.uint8).astype(np.int64)
        middle = np.flatnonzero(data)
        code = (data[middle - 1] << 16 | data[middle] << 8 | data[middle + 1]) * 0x9E3779B1 & 0xFFFFFFFF
        self.chars = code * recurrent.CHAR_BUCKETS >> 32
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))

    def logits(self, weights: recurrent.Weights) -> np.ndarray:
        entered = recurrent.inputs(weights, self.words, self.chars, self.sizes)
        return recurrent.logits(weights, recurrent.projected(weights, entered), self.at)

    def prior_logits(self, prior: np.ndarray) -> np.ndarray:
        """The strongest word of each window, and a little of all of them."""
        weight = np.append(prior[self.words], np.float32(0))[self.at]
        return weight.max(axis=1) + 0.05 * np.maximum(weight, 0).sum(axis=1)

    def highest(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text, its highest logit and the first window that has it."""
        order = np.lexsort((np.arange(len(logits)), -logits, self.row))
        first = order[np.concatenate(([True], np.diff(self.row[order]) > 0))] if len(order) else order
        return logits[first], first

    def packed(self, window: int) -> tuple[bytes, bytes, bytes]:
        at = self.at[window]
        at = at[at >= 0]
        starts = np.cumsum(self.sizes) - self.sizes
        chars = [self.chars[starts[i]:starts[i] + self.sizes[i]] for i in at]
        return (self.words[at].astype("<i4").tobytes(),
                np.concatenate(chars or [np.zeros(0)]).astype("<i4").tobytes(), self.sizes[at].astype("<i4").tobytes())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, SliceWindows]]:
    for batch in batches:
        for part in row_slices(batch, "text", SLICE_BYTES):
            yield part, SliceWindows(part.column("text").cast(pa.large_binary()).to_pylist())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents each word bucket occurs."""
    counts = np.zeros((2, recurrent.WORD_BUCKETS), np.int64)
    for part, windows in _texts(batches):
        labels = part.column("label").to_numpy()
        real = windows.at >= 0
        pairs = np.unique(np.repeat(windows.row, WIDTH)[real.ravel()] * recurrent.WORD_BUCKETS
                          + windows.words[windows.at[real]])
        np.add.at(counts, (labels[pairs // recurrent.WORD_BUCKETS], pairs % recurrent.WORD_BUCKETS), 1)
    label, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[label, bucket])],
        names=["label", "bucket", "docs"])


def _chosen_windows(score, others: bool):
    """The highest window of each document and, with ``others``, one more of each clean one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, windows in _texts(batches):
            logits, first = windows.highest(score(windows))
            number, label = part.column("number").to_pylist(), part.column("label").to_pylist()
            rows = [(number[i], label[i], float(logits[i]), *windows.packed(int(first[i]))) for i in range(len(number))]
            if others:
                begin = np.searchsorted(windows.row, np.arange(windows.rows + 1))
                for i in range(len(number)):
                    if not label[i]:
                        window = begin[i] + number[i] % (begin[i + 1] - begin[i])
                        rows.append((number[i], 0, 0.0, *windows.packed(int(window))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float32(),
                                                            pa.binary(), pa.binary(), pa.binary()))],
                names=["number", "label", "logit", "words", "chars", "sizes"])

    return run


def _network_windows(weights: recurrent.Weights, others: bool):
    return _chosen_windows(lambda windows: windows.logits(weights), others)


def _windows(chosen: pa.Table) -> recurrent.Windows:
    """Collected windows, in an order that does not depend on tasks."""
    chosen = chosen.sort_by([("number", "ascending"), ("words", "ascending")])
    words, chars, sizes = ([np.frombuffer(b, "<i4").astype(np.int64) for b in chosen.column(c).to_pylist()]
                           for c in ("words", "chars", "sizes"))
    length = np.array([len(w) for w in words], np.int64)
    step = np.arange(WIDTH)
    at = np.where(step < length[:, None], (np.cumsum(length) - length)[:, None] + step, -1)
    none = np.zeros(0, np.int64)
    return recurrent.Windows(at, np.concatenate([*words, none]), np.concatenate([*chars, none]),
                             np.concatenate([*sizes, none]), chosen.column("label").to_numpy().astype(np.float32))


def fit_line(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds: Newton steps, halved until they help, with a weak pull to (1, 0)."""
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    start = np.array([1.0, 0.0])

    def loss(line: np.ndarray) -> float:
        odds = x @ line
        return float(weight @ (np.logaddexp(0, odds) - labels * odds) + 0.05 * np.sum((line - start) ** 2))

    line = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2),
                               x.T @ (weight * (p - labels)) + 0.1 * (line - start))
        size = 1.0
        while size > 1e-6 and loss(line - size * step) > loss(line):
            size /= 2
        line = line - size * step
    return max(float(line[0]), 1e-3), float(line[1])


def fit(docs: DataFrame, labels: DataFrame, training: Column, *, sample: int = 4_000, epochs: int = 5,
        rounds: int = 2) -> ToxicityModel:
    """Learn from the documents where ``training`` holds (a column of ``docs``) and ``labels.toxic`` is known.

    ``sample`` bounds the documents of each label that the network and its line are fitted on;
    ``rounds`` is how often the network chooses the windows and learns again.
    """
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")))
    rows = docs.filter(F.coalesce(training, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id").join(known, "doc_id").distinct()
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return ToxicityModel(None, 1.0, 0.0, share)
    number = F.xxhash64(F.col("doc_id"), F.lit(SEED)).bitwiseAND(F.lit((1 << 62) - 1))
    order = Window.partitionBy("label").orderBy("number", "doc_id")
    picked = (ids.withColumn("number", number).withColumn("nth", F.row_number().over(order))
              .filter(F.col("nth") <= sample).drop("nth"))
    # at most 2 * sample ids of three numbers each; one text per id, the one with the least hash
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text")
    held = pin(rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "number").agg(text.alias("text")), "labelled")
    learnt, line = held.filter("number % 5 > 0"), held.filter("number % 5 = 0")

    docs_of = {r["label"]: r["count"] for r in learnt.groupBy("label").count().collect()}
    if len(docs_of) < 2:
        return ToxicityModel(None, 1.0, 0.0, share)
    found = (map_arrow(learnt.select("label", "text"), _word_counts, "label int, bucket int, docs long")
             .groupBy("label", "bucket").agg(F.sum("docs").alias("docs")).toArrow())  # at most two rows per bucket
    seen = np.zeros((2, recurrent.WORD_BUCKETS))
    seen[found.column("label").to_numpy(), found.column("bucket").to_numpy()] = found.column("docs").to_numpy()
    smooth = 4.0
    prior = (np.log((seen[1] + smooth) / (docs_of[1] + 2 * smooth))
             - np.log((seen[0] + smooth) / (docs_of[0] + 2 * smooth))).astype(np.float32)

    parts = learnt.select("number", "label", "text")
    first = _windows(map_arrow(parts, _chosen_windows(lambda w: w.prior_logits(prior), True), CHOSEN).toArrow())
    weights = recurrent.train(recurrent.new_weights(SEED, prior), first, seed=SEED, epochs=epochs)
    for turn in range(1, 1 + rounds):
        again = _windows(map_arrow(parts, _network_windows(weights, True), CHOSEN).toArrow())
        weights = recurrent.train(weights, again, seed=SEED + turn, epochs=max(1, epochs // 2), rate=0.002)

    last = map_arrow(line.select("number", "label", "text"), _network_windows(weights, False), CHOSEN)
    apart = last.select("number", "label", "logit").toArrow().sort_by("number")
    truth = apart.column("label").to_numpy().astype(float)
    weight = np.where(truth > 0, share / max(truth.mean(), 1e-9), (1 - share) / max(1 - truth.mean(), 1e-9)) \
        if len(truth) else truth
    slope, offset = fit_line(apart.column("logit").to_numpy().astype(float), truth, weight)
    return ToxicityModel(weights, slope, offset, share)


def _predict(model: ToxicityModel, keep: tuple[str, ...], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, windows in _texts(batches):
            logits = (windows.highest(windows.logits(model.weights))[0] if model.weights is not None
                      else np.zeros(part.num_rows))
            scores = model.scores(logits)
            count = np.bincount(windows.row, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32)), pa.array(count.astype(np.int64))],
                names=[*keep, "score", "predicted", "windows"])

    return run


def score_texts(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
                keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``windows``.

    Columns of these names in ``docs`` give way to the results; ``keep`` names the others
    that stay, all where it is not given.
    """
    made = {"score", "predicted", "windows"}
    kept = [c for c in docs.columns if c.lower() not in made and (keep is None or c in keep)]
    named = docs.select(*kept, *([] if "text" in kept else ["text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in named.dtypes if c in kept)
    return map_arrow(named, _predict(model, tuple(kept), threshold),
                     ", ".join(filter(None, [schema, "score double, predicted int, windows long"])))
