"""The search index against a scan of the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from accountloom.operators.search import build_index, search, searchable

STOCK = ["Demand", "charges", "charge", "Peak,", "the", "THE", "café", "a\tb", "kWh/day", "x", "recharge\n", "Ünder"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = [(k, str(i), " ".join(rng.choice(STOCK) for _ in range(rng.randrange(0, 9))))
            for i in range(150) for k in ("brief", "account")]
    rows += [("brief", None, "demand"), ("brief", "none", None), ("brief", "7", "again demand"), ("brief", "7", "again demand")]
    df = spark.createDataFrame(rows, "k string, id string, body string")
    path = str(tmp_path_factory.mktemp("index") / "index")
    build_index([searchable(df.filter(F.col("k") == k), k, "id", F.col("body")) for k in ("brief", "account")], path, 8)
    return path, rows


@pytest.mark.parametrize("words", [["demand"], ["charge"], ["the", "charge", "PEAK"], ["k", "/d"], ["É"], ["a", "b"],
                                   ["nothing"], ["the", "nothing"], ["again"]])
def test_search_equals_the_scan(spark, indexed, words):
    path, rows = indexed
    want = {(k, i) for k, i, t in rows if i is not None and t is not None and all(w.lower() in t.lower() for w in words)}
    got = [(r["kind"], r["key"]) for r in search(spark, path, words).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r["kind"], r["key"]) for r in search(spark, path, words, ["brief"]).collect()} == {w for w in want if w[0] == "brief"}


def test_only_the_folders_of_a_words_terms_are_read(spark, indexed):
    path, _ = indexed
    found = search(spark, path, ["again"])
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/postings" in line]
    # one folder is named, and nothing else is read but the terms
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d\)", line) for line in scans)
    assert all("/postings" in line or "/terms" in line for line in plan.splitlines() if "FileScan" in line)


def test_words_with_white_space_are_refused(spark, indexed):
    for words in (["two words"], [""], [" x"]):
        with pytest.raises(ValueError):
            search(spark, indexed[0], words)
    assert search(spark, indexed[0], []).collect() == []
