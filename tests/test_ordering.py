"""Modes, ranks and order statistics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from accountloom.functions.measures import half_even
from accountloom.operators import ordering as O
from accountloom.operators.outliers import flag_outliers


@pytest.mark.parametrize("values,mode", [("baba", "b"), ("abba", "a"), ("abcc", "c")])
def test_first_seen_mode(spark, values, mode):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate(values)], "k string, v string, pos int")
    assert O.first_seen_mode(df.repartition(5), ["k"], "v", "pos").first()["v"] == mode


@pytest.mark.parametrize("x,y", [(0.5, 0), (1.5, 2), (2.5, 2), (3.5, 4), (2.4, 2)])
def test_half_even(spark, x, y):
    assert spark.range(1).select(half_even(F.lit(x))).first()[0] == y


@pytest.mark.parametrize("n", [1, 2, 3, 100, 258])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    data = [rng.choice([0, 5, 7, 7, 7, rng.randrange(1, 1000)]) for _ in range(n)] + [3]
    df = spark.createDataFrame([(v, -v) for v in data], "v int, w int").repartition(4)
    got = O.order_statistics(df, {"v": F.col("v"), "w": F.col("w")}, {"p99": 0.99, "median": 0.5, "p0": 0.0}).first()
    ordered = sorted(v for v in data if v > 0)
    for label, p in (("p99", 0.99), ("median", 0.5), ("p0", 0.0)):
        assert got[f"v_{label}"] == ordered[min(len(ordered) - 1, int(len(ordered) * p))]
        assert got[f"w_{label}"] == 0
    assert got["v_n"] == len(ordered) and got["w_n"] == 0


def test_global_rank_matches_a_sort(spark):
    rows = [(random.Random(i).randrange(5), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(16)
    got = {(r.a, r.b): r["rank"] for r in O.global_rank(df, [F.desc("a"), F.asc("b")]).collect()}
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert got == want


def test_first_seen_names_caps_and_counts(spark):
    names = ["Alpha", "ALPHA ", "beta", " ", "gamma", "Beta", "delta"]
    df = spark.createDataFrame([("k", n, i) for i, n in enumerate(names)], "k string, n string, ord int").repartition(3)
    got = O.first_seen_names(df, ["k"], F.col("n"), F.trim("n"), "ord", 3).first()
    assert got["names"] == ["Alpha", "beta", "gamma"] and got["overflow"] == 1


def flags(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    return flag_outliers(df, {"v": F.col("v")}, 10).filter("not validated").collect()


def test_gate_flags_one_value_among_many(spark):
    hits = flags(spark, [20_000 + i for i in range(257)] + [89_000_000])
    assert [h["v"] for h in hits] == [89_000_000]
    assert hits[0]["validation_note"].startswith("v 89,000,000 exceeds p99 (20,255 lb) x 10; median is 20,129 lb.")


def test_gate_is_inert_on_few_rows(spark):
    assert flags(spark, [20_000] * 7 + [89_000_000]) == []


def test_gate_on_nothing(spark):
    assert flags(spark, [0, 0]) == []
