"""The set-similarity join and the groups against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from accountloom.operators import research as X
from accountloom.operators.matching import score_pairs, similar_names
from accountloom.operators.similar_sets import connected_components, similar_pairs


def brute_pairs(rows, cut):
    out = {}
    for (k, a, x), (g, b, y) in itertools.combinations(rows, 2):
        x, y = {w for w in x or [] if w}, {w for w in y or [] if w}
        if k is not None and k == g and x and y and None not in (a, b) and len(x & y) / len(x | y) >= cut:
            out[frozenset((a, b))] = round(len(x & y) / len(x | y), 9)
    return out


def our_pairs(spark, rows, cut):
    df = spark.createDataFrame(rows, "k string, id string, words array<string>")
    got = similar_pairs(df, "id", "words", cut, ["k"]).collect()
    assert len({frozenset((r["left"], r["right"])) for r in got}) == len(got)
    return {frozenset((r["left"], r["right"])): round(r["similarity"], 9) for r in got}


def random_sets(n, seed, stock=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(stock)]
    return [("k", f"n{i}", ["every"] * (rng.random() < 0.9) + rng.choices(
        words, [1 / (j + 1) for j in range(stock)], k=rng.choice([0, 1, 2, 3, 3, 4, 5, 9]))) for i in range(n)]


@pytest.mark.parametrize("cut", [0.25, 0.5, 0.8, 1.0])
def test_pairs_equal_brute_force(spark, cut):
    rows = random_sets(400, 3) + [("other", "n1", ["every", "w1"]), (None, "x", ["every"]), (None, "y", ["every"]),
                                  ("k", None, ["every"]), ("k", "z", None), ("k", "e", []), ("k", "u", [None, "w1"])]
    want = brute_pairs(rows, cut)
    assert our_pairs(spark, rows, cut) == want and want


def test_two_thousand_names_equal_brute_force(spark):
    rows = random_sets(2_000, 5, stock=900)
    assert our_pairs(spark, rows, 0.6) == brute_pairs(rows, 0.6)


def test_a_word_in_all_names_makes_no_pairs(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("id"), F.array(
        F.lit("hot"), F.lit("common"), F.concat(F.lit("a"), (F.col("id") / 2).cast("int").cast("string")),
        F.concat(F.lit("b"), "id")).alias("words"))
    pairs = similar_pairs(rows, "id", "words", 0.6, ["k"])
    assert pairs.count() == n / 2  # two names share their third word; all share the first two
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_equal_token_sets_are_linked_to_their_first_name(spark):
    names = ["Acme Harbour", "Harbour Acme Foods", "acme harbour group", "Acme Northgate", "Foods", "", None,
             "Northgate Acme Harbour"]
    got = {(r["account"], r["other"]): (round(r["similarity"], 6), r["acceptable"]) for r in similar_names(
        spark.createDataFrame([(n,) for n in names], "n string"), "n", 0.4).collect()}
    assert got == {("Acme Harbour", "Harbour Acme Foods"): (1.0, True), ("Acme Harbour", "acme harbour group"): (1.0, True),
                   ("Acme Harbour", "Northgate Acme Harbour"): (0.666667, True),
                   ("Acme Northgate", "Northgate Acme Harbour"): (0.666667, True)}


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_every_pair_of_names_above_the_cut(spark, block):
    """Names with equal tokens included: two of one class, and each of them with each of another."""
    rng = random.Random(6)
    stock = ["acme", "harbour", "harbor", "northgate", "northgates", "zed", "kinsbury", "kingsbury", "depot", "west"]
    names = {" ".join(rng.choices(stock, k=rng.choice([1, 2, 3]))) + rng.choice(["", " Foods", " Group", " inc"]) for _ in range(70)}
    df = spark.createDataFrame([(n,) for n in [*names, None, "", "Foods"]], "n string")
    got = similar_names(df, "n", 0.4, every_pair=True, block=block).collect()
    words = {n: {w for w in n.lower().split() if w not in ("foods", "group", "inc")} for n in names}
    want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in names for b in names if a < b}
    want = {p: round(s, 6) for p, s in want.items() if s >= 0.4}
    assert len(got) == len(want) and {(r["account"], r["other"]): round(r["similarity"], 6) for r in got} == want
    assert len({p for p, s in want.items() if s == 1}) > 15
    scored = score_pairs(spark.createDataFrame(list(want), "a string, b string"), "a", "b").collect()
    assert {(r["account"], r["other"]): (round(r["score"], 6), r["acceptable"]) for r in got} == {
        (r["a"], r["b"]): (round(r["score"], 6), r["acceptable"]) for r in scored}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 520)]
    edges += [(None, 1), (5, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_signals_with_similar_titles_are_one(spark):
    rows = [(1, "a", "d", "Plant fire in Ohio"), (2, "a", "d", "Fire in Ohio plant!"), (3, "a", "d", "Ohio plant fire, again"),
            (4, "a", "d", "Plant fire again reported"), (5, "b", "d", "Plant fire in Ohio"), (6, "a", "d", "New chief officer"),
            (7, "a", None, "Plant fire in Ohio"), (8, "a", None, "Plant fire in Ohio"), (9, "a", "d", None), (10, "a", "d", "")]
    df = spark.createDataFrame(rows, "id int, account string, day string, title string")
    got = {r["id"]: (r["title_words"], r["reports"], r["titles"])
           for r in X.dedup_signals(df, ["account", "day"], "title", ["id"], 0.6).collect()}
    assert got == {1: ("fire in ohio plant", 4, 3), 5: ("fire in ohio plant", 1, 1), 6: ("chief new officer", 1, 1),
                   7: ("fire in ohio plant", 2, 1), 9: ("", 2, 1)}
