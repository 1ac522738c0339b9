"""Atomic appends: two writers at once, repeated runs, half-done writes, tenants and samples."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from accountloom.operators import access as A
from accountloom.operators import gates as G
from accountloom.operators import identity as I
from accountloom.sources.commit_log import CommitLog

SCHEMA = "k string, v int"


def rows_of(spark, low, high, value=0):
    return spark.range(low, high).select(F.col("id").cast("string").alias("k"), F.lit(value).alias("v"))


def test_concurrent_and_repeated_appends_leave_each_key_once(spark, tmp_path):
    path = str(tmp_path / "t")
    errors = []

    def write(value):
        try:
            log = CommitLog(spark, path, SCHEMA)
            log.append(rows_of(spark, value * 5, value * 5 + 20, value), ["k"])
            log.append(rows_of(spark, value * 5, value * 5 + 20, value), ["k"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = CommitLog(spark, path, SCHEMA)
    keys = [r["k"] for r in log.read().collect()]
    assert not errors and sorted(map(int, keys)) == list(range(35))
    assert [m["version"] for m in log.manifests()] == list(range(1, len(log.manifests()) + 1))
    assert not log.append(rows_of(spark, 0, 35), ["k"])


def test_a_taken_number_is_not_taken_again(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"), SCHEMA)
    assert log._put(1, log._stage(rows_of(spark, 0, 3)), None)
    assert not log._put(1, log._stage(rows_of(spark, 3, 6)), None)
    assert log.read().count() == 3 and len(log.manifests()) == 1


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"), SCHEMA)
    log._stage(rows_of(spark, 0, 5))  # a writer that died before its commit
    assert log.read().count() == 0
    log.append(rows_of(spark, 0, 5), ["k"])
    assert log.read().count() == 5


def test_files_of_an_older_table_count(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_of(spark, 0, 4).write.json(path)
    log = CommitLog(spark, path, SCHEMA, "json")
    assert log.append(rows_of(spark, 2, 6, 1).union(rows_of(spark, 2, 6, 1)), ["k"])
    assert sorted((r["k"], r["v"]) for r in log.read().collect()) == [
        ("0", 0), ("1", 0), ("2", 0), ("3", 0), ("4", 1), ("5", 1)]
    assert log.read(after=1).count() == 0


def test_an_audit_batch_enters_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    for batch in ("a", "a", "b", None, None):
        I.append_audit(rows_of(spark, 0, 2), path, batch)
    assert CommitLog(spark, path, SCHEMA).read().count() == 8


def test_a_tenant_reads_its_own_folder(spark, tmp_path):
    path = str(tmp_path / "accounts")
    A.write_by_tenant(rows_of(spark, 0, 100).withColumn("tenant_id", F.col("k").cast("int") % 4), path)
    mine = A.read_tenant(spark, path, 3)
    assert mine.count() == 25
    assert "PartitionFilters: [isnotnull(tenant_id" in mine._jdf.queryExecution().executedPlan().toString()
    none = A.read_tenant(spark, path, None)
    assert none.count() == 0 and "FileScan" not in none._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_have_exact_sizes(spark, parts):
    sizes = {"a": 900, "b": 10, "c": 1, "d": 33}
    rows = [(f"{s}{i}", s, float(i % 3 == 0)) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, s string, ok double").repartition(parts)
    got = {r["s"]: r for r in G.sample_audit(df, "k", "s", F.col("ok"), 0.1).collect()}
    assert {s: (r["audited"], r["population"]) for s, r in got.items()} == {
        s: (math.ceil(n / 10), n) for s, n in sizes.items()}
    assert got["c"]["margin"] == 0 and 0.05 < got["a"]["margin"] < 0.12
    assert abs(got["a"]["accuracy"] - 1 / 3) < 2 * got["a"]["margin"]
