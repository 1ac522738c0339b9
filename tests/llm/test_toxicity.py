"""The recurrent network against numeric gradients, and toxicity scores on held-out texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accountloom.llm import recurrent as R
from accountloom.llm import toxicity as T
from accountloom.llm.language import held_out

DOCS = "doc_id long, text string, score string, Predicted int"
LABELS = "doc_id long, toxic int, text string"
CLEAN = [f"{a}{b}{c}" for a in ("lo", "mi", "ra") for b in ("ten", "sur", "val") for c in ("", "is", "o", "um")]
TOXIC = ["grobnak", "grobnaks", "zwirfel"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.choice([1, 5, 30, 90, 200]))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(TOXIC))
        docs.append((i, " ".join(words).capitalize() + ".", "clash", 7))
        labels.append((i, int(toxic), "clash"))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    rng = random.Random(2)
    before, after = (" ".join(rng.choice(CLEAN) for _ in range(10_000)) for _ in range(2))
    extra = [(None, "mis grobnak", "", 0), (5000, None, "", 0), (5001, "", "", 0), (5002, " .,! ", "", 0),
             (5003, docs[8][1], "", 0), (5004, f"{before} Zwirfel! {after}", "", 0),
             (5005, f"{before} {after}", "", 0), (5006, "x" * 1_500_000, "", 0), (8, docs[8][1], "", 0)]
    rows = spark.createDataFrame(docs + extra, DOCS).repartition(4)
    known = spark.createDataFrame(labels + [(None, 1, ""), (3, None, ""), (4, 0, ""), (9_999_999, 1, "")], LABELS)
    model = T.fit(rows, known, ~held_out(4, 2), sample=300, epochs=6)
    got = T.score_texts(rows.withColumn("held_out", held_out(4, 2)), model)
    assert [c for c, _ in got.dtypes] == ["doc_id", "text", "held_out", "score", "predicted", "windows"]
    return got.select("doc_id", "held_out", "score", "predicted", "windows").collect(), dict(
        (i, t) for i, t, _ in labels), len(docs) + len(extra)


def test_held_out_accuracy(scored):
    rows, labels, n = scored
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = [p for p, t in test if t]
    clean = [p for p, t in test if not t]
    assert len(caught) > 30 and np.mean(caught) >= 0.95 and np.mean(clean) <= 0.03


def test_edge_cases(scored):
    rows, _, _ = scored
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5000]["score"] == by_id[5001]["score"] == by_id[5002]["score"] < 0.3
    assert abs(by_id[5003]["score"] - by_id[8]["score"]) < 1e-5          # equal texts
    assert by_id[5004]["predicted"] == 1 and by_id[5005]["predicted"] == 0  # one word of 20,001
    assert by_id[5004]["windows"] >= 20_000 // T.STRIDE and by_id[5006]["windows"] >= 1
    assert by_id[None]["predicted"] == 1


def test_without_both_labels_the_share_is_the_score(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0), (2, None, "", 0)], DOCS)
    for labels, share in (([], 0.0), ([(1, 1, ""), (2, 1, "")], 1.0), ([(1, 0, "")], 0.0)):
        model = T.fit(docs, spark.createDataFrame(labels, LABELS), F.lit(True))
        assert {r["score"] for r in T.score_texts(docs, model).collect()} == {share}
    empty = docs.limit(0)
    assert T.score_texts(empty, T.fit(empty, spark.createDataFrame([], LABELS), F.lit(True))).collect() == []


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 32, 33, 48, 49, 500):
        windows = T.SliceWindows([b" ".join(b"w%d" % i for i in range(n)), b"other"])
        at = windows.at[windows.row == 0]
        seen = [set(row[row >= 0].tolist()) for row in at]
        assert set().union(*seen) == set(range(n))
        assert all(len(a & b) == T.WIDTH - T.STRIDE for a, b in zip(seen, seen[1:-1]))
        assert (windows.row == 1).sum() == 1


def test_long_texts_are_read_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 1000)
    words = [b"w%d" % i for i in range(3000)]
    pieces = [p.split() for p in T._pieces(b" ".join(words))]
    place = {w: i for i, w in enumerate(words)}
    ends = [(place[p[0]], place[p[-1]]) for p in pieces]
    assert ends[0][0] == 0 and ends[-1][1] == 2999
    assert all(a[1] - b[0] + 1 == T.WIDTH for a, b in zip(ends, ends[1:]))
    assert b"".join(T._pieces(b"x" * 4500)) == b"x" * 4500


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(R, "SHUT", 60.0)
    rng = np.random.default_rng(0)
    length = np.array([5, 5, 3, 1, 0, 4])
    at = np.where(np.arange(5) < length[:, None], rng.integers(0, 9, (6, 5)), -1)
    sizes = rng.integers(1, 4, 9)
    windows = R.Windows(at, rng.integers(0, 30, 9), rng.integers(0, 50, sizes.sum()), sizes,
                        rng.integers(0, 2, 6).astype(float))
    weights = {k: v.astype(float) for k, v in R.new_weights(1, rng.normal(0, 1, R.WORD_BUCKETS)).items()}
    rows, each = np.arange(6), np.ones(6)
    _, grad = R.gradients(weights, windows, rows, each)
    for name, values in weights.items():
        flat = values.reshape(-1)
        for i in np.argsort(-np.abs(grad[name]).reshape(-1))[:4]:
            kept = flat[i]
            losses = []
            for shift in (1e-3, -1e-3):
                flat[i] = kept + shift
                losses.append(R.gradients(weights, windows, rows, each)[0])
            flat[i] = kept
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[name].reshape(-1)[i], abs=2e-4)


def test_line_is_calibrated():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 3, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * logits - 2)))).astype(float)
    slope, offset = T.fit_line(logits, labels, np.ones(20_000))
    assert slope == pytest.approx(0.7, abs=0.05) and offset == pytest.approx(-2, abs=0.1)
