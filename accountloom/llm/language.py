"""Language identification by the nearest of several centroids per language.

A text becomes hashed letter n-grams, weighted by term frequency and inverse
document frequency and normalised.  Document frequencies cover every training
document.  Each language's centroids are clustered from a bounded sample, at most
``sample`` documents chosen by a hash of their id.  A text takes the language of the
centroid with the largest cosine and is rejected when that is well below a low
quantile of the cosines of all training documents of the language and its length.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected; without any training document every text is; equal texts get equal
results; rows with a null id are predicted and never learnt from; other columns are
not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm.frames import map_arrow, row_slices

BINS = 4096
NGRAMS = (1, 2, 3)
SEGMENT = 1 << 21
ROWS = 256
LENGTHS = 32  # classes of text length: octaves of the number of n-grams
BINS_OF_COSINES = 1000
ENOUGH = 20  # training documents from which a length class has a floor of its own


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed letter n-grams per text, and which texts have a letter.

    Everything that is not a letter bounds a word; n-grams lie within a word and one
    boundary on either side.
    """
    counts = np.zeros((len(texts), BINS), np.float32)
    lettered = np.zeros(len(texts), bool)
    row_codes, row_ids = [], []
    held = 0

    def flush() -> None:
        nonlocal held
        if not row_codes:
            return
        codes = np.concatenate(row_codes).astype(np.uint64)
        rows = np.concatenate(row_ids)
        row_codes.clear()
        row_ids.clear()
        held = 0
        letter = codes > 0
        for n in NGRAMS:
            if len(codes) < n:
                continue
            here = letter[:len(codes) - n + 1].copy()
            mixed = np.full(len(here), n, np.uint64)
            for k in range(n):
                mixed = mixed * np.uint64(0x100000001B3) + codes[k:len(codes) - n + 1 + k]
                if k:
                    here |= letter[k:len(codes) - n + 1 + k]
            if n == 3:  # a boundary in the middle joins two words
                here &= letter[1:-1]
            same = rows[:len(here)] == rows[n - 1:]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            cell = (mixed >> np.uint64(52)).astype(np.int64) + rows[:len(here)] * BINS
            counts.reshape(-1)[:] += np.bincount(cell[here & same], minlength=counts.size).astype(np.float32)

    for row, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_letters()[codes], codes, 0)
        lettered[row] = codes.any()
        for low in range(0, len(codes), SEGMENT):  # two codes of overlap: no n-gram is lost or doubled
            part = codes[low:low + SEGMENT + 2]
            if low + SEGMENT < len(codes):
                _add_segment(counts[row], part)
            elif low:
                _add_segment(counts[row], part)
            else:
                row_codes.append(part)
                row_ids.append(np.full(len(part), row, np.int64))
                held += len(part)
        if held > SEGMENT:
            flush()
    flush()
    return counts, lettered


def _add_segment(counts: np.ndarray, part: np.ndarray) -> None:
    """Add the n-grams that start in the first ``SEGMENT`` codes of a piece of a very long text."""
    codes = part.astype(np.uint64)
    letter = codes > 0
    for n in NGRAMS:
        size = min(SEGMENT, len(codes) - n + 1)
        if size <= 0:
            continue
        here = np.zeros(size, bool)
        mixed = np.full(size, n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + codes[k:size + k]
            here |= letter[k:size + k]
        if n == 3:
            here &= letter[1:size + 1]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((mixed >> np.uint64(52)).astype(np.int64)[here], minlength=BINS).astype(np.float32)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.maximum(length, 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    return _unit(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for part in row_slices(batch, "text", 4 << 20):
            for low in range(0, part.num_rows, ROWS):
                rows = part.slice(low, ROWS)
                yield rows, pc.fill_null(rows.column("text"), "").to_pylist()


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, docs = np.zeros(BINS, np.int64), 0
    for _, texts in _text_rows(batches):
        counts, lettered = ngram_counts(texts)
        held += (counts > 0).sum(axis=0)
        docs += int(lettered.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, BINS, dtype=np.int32)), pa.array(np.concatenate(([docs], held)))],
        names=["bin", "docs"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _text_rows(batches):
        counts, _ = ngram_counts(texts)
        yield pa.RecordBatch.from_arrays(
            [rows.column("lang"), pa.array([c.tobytes() for c in counts], pa.binary()), rows.column("_h"), rows.column("_n")],
            names=["lang", "counts", "_h", "_n"])


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means from spread-out seeds."""
    mean = _unit(points.mean(axis=0, keepdims=True))
    seeds = [int((points @ mean[0]).argmax())]
    while len(seeds) < min(k, len(points)):
        nearest = (points @ points[seeds].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        seeds.append(int(nearest.argmin()))
    centroids = points[seeds]
    for _ in range(rounds):
        member = (points @ centroids.T).argmax(axis=1)
        centroids = _unit(np.stack([points[member == j].mean(axis=0) if (member == j).any() else centroids[j]
                                    for j in range(len(centroids))]))
    return centroids.astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # one per centroid
    centroids: np.ndarray
    floors: np.ndarray  # least cosine that is not rejected, per centroid and length class
    idf: np.ndarray


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1, dtype=np.float64), 1)).astype(np.int64), LENGTHS - 1)


def _nearest(counts: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """The centroid with the largest cosine, and that cosine."""
    cosines = vectors(counts, model.idf) @ model.centroids.T
    best = cosines.argmax(axis=1)
    return best, cosines[np.arange(len(best)), best]


def _cosine_counts(model: LanguageModel):
    """How many documents of each language and length class have which cosine, where the label is the prediction."""
    names, number = np.unique(np.array(model.languages), return_inverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(names) * LENGTHS * BINS_OF_COSINES, np.int64)
        for rows, texts in _text_rows(batches):
            counts, lettered = ngram_counts(texts)
            if not lettered.any():
                continue
            best, top = _nearest(counts[lettered], model)
            label = np.array(rows.column("lang").to_pylist(), object)[lettered]
            right = np.array([model.languages[k] for k in best], object) == label
            level = np.clip(top * BINS_OF_COSINES, 0, BINS_OF_COSINES - 1).astype(np.int64)
            cell = (number[best] * LENGTHS + _length_class(counts[lettered])) * BINS_OF_COSINES + level
            np.add.at(held, cell[right], 1)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["cell", "docs"])

    return run


def _sample_hash() -> Column:
    return F.xxhash64("doc_id", F.lit("language sample"))


def floors_of(seen: np.ndarray, quantile: float, leniency: float) -> np.ndarray:
    """Floors per length class from counts of cosines per length class.

    A class with fewer than ``ENOUGH`` documents takes in the shorter ones next to it,
    whose cosines are smaller; with fewer even so, its floor is lower in proportion.  Classes shorter than any document fall with the square
    root of the length, as the cosines of few n-grams do.
    """
    out, filled = np.zeros(LENGTHS), np.flatnonzero(seen.sum(axis=1))
    if not len(filled):
        return out
    for k in range(filled[0], LENGTHS):
        low = k
        while low > filled[0] and seen[low:k + 1].sum() < ENOUGH:
            low -= 1
        total = seen[low:k + 1].sum(axis=0).cumsum()
        level = np.searchsorted(total, max(1, quantile * total[-1])) / BINS_OF_COSINES
        out[k] = leniency * level * min(1, total[-1] / ENOUGH)
    for k in range(filled[0]):
        out[k] = out[filled[0]] * 2 ** ((k - filled[0]) / 2)
    return out


def fit(docs: DataFrame, training: Column, *, sample: int = 400, clusters: int = 4, quantile: float = 0.005,
        leniency: float = 0.7) -> LanguageModel:
    """Learn from the rows of ``docs`` where ``training`` holds and ``lang`` is not null.

    ``sample`` documents per language at most, and no more than half, make its centroids.
    A text is rejected below ``leniency`` times this ``quantile`` of the cosines of all
    other training documents of its language and length class, or of its length class
    where the language has fewer than ``ENOUGH``.
    """
    learn = docs.filter(training & F.col("lang").isNotNull())
    partial = map_arrow(learn.select("text"), _document_frequencies, "bin int, docs long")
    # one row per bin, BINS + 1 in all
    totals = {r["bin"]: r["docs"] for r in partial.groupBy("bin").agg(F.sum("docs").alias("docs")).collect()}
    frequency = np.array([totals.get(b, 0) for b in range(BINS)], np.float32)
    idf = (np.log((1 + totals.get(-1, 0)) / (1 + frequency)) + 1).astype(np.float32)

    ranked = learn.filter(F.col("text").rlike(r"\p{L}")).select(
        "text", "lang", _sample_hash().alias("_h"), "doc_id")
    first = Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text"))
    chosen = ranked.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 2 * sample)
    counted = map_arrow(chosen.select("lang", "text", "_h", "_n"), _sparse,
                        "lang string, counts binary, _h long, _n int")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_n").head(min(sample, (len(group) + 1) // 2))
        counts = np.stack([np.frombuffer(c, np.float32) for c in group["counts"]])
        found = cluster(vectors(counts, idf), clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tobytes() for c in found],
                             "border": group["_h"].iloc[-1]})

    rows = counted.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, border long").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    matrix = (np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows])
              if rows else np.zeros((0, BINS), np.float32))
    languages = tuple(r["lang"] for r in rows)
    model = LanguageModel(languages, matrix, np.zeros((len(rows), LENGTHS)), idf)
    if not rows:
        return model
    names, number = np.unique(np.array(languages), return_inverse=True)
    seen = np.zeros(len(names) * LENGTHS * BINS_OF_COSINES, np.int64)
    border = F.create_map(*[F.lit(x) for lang, h in {(r["lang"], r["border"]) for r in rows} for x in (lang, h)])
    others = learn.filter(_sample_hash() > border[F.col("lang")])
    cells = map_arrow(others.select("text", "lang"), _cosine_counts(model), "cell long, docs long")
    for r in cells.groupBy("cell").agg(F.sum("docs").alias("docs")).collect():  # a few thousand per language at most
        seen[r["cell"]] = r["docs"]
    seen = seen.reshape(len(names), LENGTHS, BINS_OF_COSINES)
    own = seen.sum(axis=2, keepdims=True) >= ENOUGH  # elsewhere the documents of all languages count
    floors = np.stack([floors_of(s, quantile, leniency) for s in np.where(own, seen, seen.sum(axis=0))])
    return LanguageModel(languages, matrix, floors[number], idf)


def _predict(model: LanguageModel, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _text_rows(batches):
            counts, lettered = ngram_counts(texts)
            known = lettered & bool(len(model.languages))
            lang = np.full(len(texts), "und", object)
            score = np.zeros(len(texts))
            rejected = np.ones(len(texts), bool)
            if known.any():
                best, top = _nearest(counts[known], model)
                lang[known] = [model.languages[b] for b in best]
                score[known] = np.clip(top, 0, 1)
                rejected[known] = top < model.floors[best, _length_class(counts[known])]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*keep, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Columns of these names in ``docs`` give way to the results.
    """
    made = {"lang_pred", "score", "rejected"}
    kept = [c for c in docs.columns if c not in made]
    named = docs.select(*kept)
    if text != "text":
        named = named.withColumn("text", F.col(text))
        kept = named.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in named.dtypes)
    return map_arrow(named, _predict(model, tuple(kept)),
                     f"{schema}, lang_pred string, score double, rejected boolean")


def held_out(modulus: int, remainder: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
