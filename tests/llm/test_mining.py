"""Phrase mining and hard negatives against brute force, and their edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from accountloom.llm import phrases
from accountloom.llm.hard_negatives import inner_products, mine_hard_negatives
from accountloom.llm.hat_trie import HatTrie, path_keys, path_words

DOCS = "text string, lang string, phrase string, a long"


# --- HAT-trie -----------------------------------------------------------------

def test_trie_counts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    first = np.where(rng.random(20_000) < 0.4, 7, rng.integers(1, 300, 20_000))
    keys = path_keys(first, rng.integers(0, 40, 20_000), rng.integers(0, 40, 20_000))
    trie, total = HatTrie(burst=64), Counter()
    for part in np.array_split(keys, 13):
        trie.add(np.sort(part))
        if len(trie) > 2_000:
            taken, counts = trie.spill(1_000)
            assert len(trie) <= 1_000
            total.update(dict(zip(taken.tolist(), counts.tolist())))
    assert max(len(c) for c in trie.root.containers()) <= 64
    taken, counts = trie.spill(0)
    total.update(dict(zip(taken.tolist(), counts.tolist())))
    assert len(trie) == 0 and total == Counter(keys.tolist())


def test_burst_container_of_one_word_becomes_a_node():
    trie = HatTrie(burst=4)
    keys = path_keys(np.full(50, 9), np.full(50, 3), np.arange(50))
    trie.add(keys)
    assert sorted(k for c in trie.root.containers() for k in c) == keys.tolist()
    assert [w.tolist()[0] for w in path_words(keys[5:6])] == [9, 3, 5]


# --- phrases ------------------------------------------------------------------

def brute_counts(rows, longest=3):
    found = Counter()
    for text, lang, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    found[(lang if lang is not None else "und", tuple(words[i:i + n]))] += 1
    return found


def brute_collocations(rows, least, top, contained):
    found = brute_counts(rows)
    out = []
    for lang in {k[0] for k in found}:
        f = {w: n for (g, w), n in found.items() if g == lang}
        total = sum(n for w, n in f.items() if len(w) == 1)
        candidates = {w: n for w, n in f.items() if len(w) > 1 and n >= least}
        kept = []
        for w, a in candidates.items():
            if any(len(v) > len(w) and 100 * b >= contained * a
                   and any(v[i:i + len(w)] == w for i in range(len(v))) for v, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), a, f[w[:k]], f[w[k:]], score))
        out += [(lang, i + 1, p.decode(), a, left, right, total, s)
                for i, (_, _, p, a, left, right, s) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def text_rows():
    rng = np.random.default_rng(5)
    words = ["The", "of", "New", "york", "état", "a\x01b", "x", "city", " wide", "ice"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!? "]
    rows = []
    for i in range(120):
        size = int(rng.integers(1, 60))
        text = "".join(words[j] + marks[m] for j, m in zip(rng.integers(0, 10, size), rng.integers(0, 10, size)))
        rows.append((text + "New York City" * int(i % 3 == 0), ["en", "fr", None, ""][i % 4], "clash", 1))
    return rows + [(None, "en", None, None), ("", "en", "", 0), ("...", "xx", "", 0), rows[0], rows[0]]


@pytest.mark.parametrize("sizes", [{}, {"held": 40, "burst": 4, "part_bytes": 200, "slice_bytes": 37}])
def test_counts_equal_brute_force(spark, sizes):
    rows = text_rows()
    got = phrases.phrase_counts(spark.createDataFrame(rows, DOCS).repartition(3), least=2, **sizes).collect()
    want = brute_counts(rows)
    assert {(r["lang"], r["phrase"]): r["f"] for r in got if r["words"]} == {
        (g, " ".join(w)): n for (g, w), n in want.items() if n >= 2}
    totals = Counter()
    for r in got:
        if not r["words"]:
            totals[r["lang"]] += r["f"]
    words = Counter()
    for (lang, w), n in want.items():
        if len(w) == 1:
            words[lang] += n
    assert totals == words


def test_collocations_equal_brute_force(spark):
    rows = text_rows()
    got = phrases.collocations(spark.createDataFrame(rows, DOCS), least=3, top=15)
    assert sorted(tuple(r)[:8] for r in got.collect()) == brute_collocations(rows, 3, 15, 50)


def test_a_long_text_is_read_in_chunks_without_losing_phrases(spark):
    text = " ".join(["one", "two", "three", "four"] * 50_000)
    got = {r["phrase"]: r["f"] for r in phrases.phrase_counts(
        spark.createDataFrame([(text, "en", "", 0)], DOCS), slice_bytes=1 << 12).collect()}
    assert got["one two three"] == 50_000 and got["four one two"] == 49_999 and got["four"] == 50_000


def test_no_documents_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_a_hot_prefix_spreads_over_partitions():
    n = np.arange(1, 100_001, dtype=np.uint64) * np.uint64(0x9E3779B1)
    one = np.full(len(n), 12345, np.uint64)
    part = phrases.partition_of(one, one, n, 640)
    sizes = np.bincount(part, minlength=640)
    assert (sizes > 0).sum() == 41 and sizes.max() < 1.2 * len(n) / 41


# --- hard negatives -----------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<double>, score long, id string"


def brute_negatives(rows, positives=5, top=10, low=30, high=90):
    usable = [(r[0], r[1], [int(np.floor(256 * x)) for x in r[2]]) for r in rows
              if r[0] is not None and r[1] is not None and r[2] is not None
              and all(x is not None and np.isfinite(x) for x in r[2])]
    out = []
    for name, label, v in usable:
        if name % 10:
            continue
        scored = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -2**63), i, g) for i, g, w in usable]
        own = sorted((s, i) for s, i, g in scored if g == label and i != name)[:positives]
        for p, i in own:
            fits = sorted((s, j) for s, j, g in scored if g != label and low * -p <= 100 * -s <= high * -p)[:top]
            out += [(name, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def vector_rows(n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), (np.round(rng.normal(0, 1, 6), 1) + 0.3).tolist(), 1, "clash") for i in range(n)]
    rows += [(n + i, 2, [1.0, 0.5, 0.5, 0.5, 0.5, 0.5], 1, "") for i in range(40)]  # one common vector
    rows += [rows[10], rows[20], rows[35], rows[35]]                                 # repeated rows and anchors
    rows += [(None, 1, [1.0], 1, ""), (1000, None, [1.0], 1, ""), (1001, 1, None, 1, ""),
             (1002, 1, [None, 1.0], 1, ""), (1003, 1, [float("nan")], 1, ""), (1004, 1, [float("-inf")], 1, ""),
             (1010, 1, [], 1, ""), (1020, 2, [2.0, 1.0], 1, ""), (-10, 1, [0.5] * 9, 1, "")]
    return rows


def negatives(spark, rows):
    got = mine_hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 10 == 0)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("blocks", [None, 64])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr("accountloom.llm.hard_negatives.ROW_VALUES", blocks * 8)
        monkeypatch.setattr("accountloom.llm.hard_negatives.ANCHOR_VALUES", blocks)
    rows = vector_rows()
    assert negatives(spark, rows) == brute_negatives(rows)


def test_negatives_with_values_beyond_doubles(spark):
    rows = vector_rows(60, 4) + [(2000, 1, [1e5, 3e7, 1.0], 1, ""), (2010, 1, [2e7 + 0.1, 1e7], 1, ""),
                                 (2020, 0, [1e30, -1e30], 1, ""), (2021, 0, [1e30], 1, "")]
    assert negatives(spark, rows) == brute_negatives(rows)


def test_no_vectors_no_negatives(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(1, 1, [1.0], 1, "")]) == []


def test_inner_products_are_exact():
    rng = np.random.default_rng(2)
    a, b = (np.floor(rng.normal(0, 1, (5, 7)) * 10.0 ** rng.integers(0, 9, (5, 1))) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert inner_products(a, b).tolist() == np.clip(np.array(want, object), -2**63, 2**63 - 1).tolist()
