"""The ledger of a stream against a row-by-row account."""

import datetime
import random

import pytest

from accountloom.streaming.events import read_events, work_folder
from accountloom.streaming.ledger import OUTCOMES, Ledger

SCHEMA = "id long, ts timestamp_ntz, kind string"
START = datetime.datetime(2024, 1, 1)
DELAY = 3 * 3600


def deliveries(seed, triggers=5, n=60):
    rng = random.Random(seed)
    out, sent = [], []
    for t in range(triggers):
        batch = []
        for _ in range(n):
            if sent and rng.random() < 0.3:
                batch.append(rng.choice(sent))  # again
            else:
                hour = t * 4 + rng.choice([0, 1, 2, 3, -2, -5, -9])
                batch.append((len(sent) + len(batch) * 1000 + t * 100_000, START + datetime.timedelta(
                    hours=hour, seconds=rng.randrange(3600)), rng.choice("ab")))
        batch += [(7_000_000, None, "a"), (None, START + datetime.timedelta(hours=t * 4), "b")]
        sent += batch[:-2]
        out.append(batch)
    return out


def account(batches):
    """What each delivery must become, as counts per (row, outcome)."""
    newest, counted, out = None, set(), {}
    for batch in batches:
        horizon = newest and newest - datetime.timedelta(seconds=DELAY)
        for row in sorted(batch, key=lambda r: (r[1] is not None, r[1] or START)):
            end = row[1] and row[1].replace(minute=0, second=0, microsecond=0) + datetime.timedelta(hours=1)
            if end and horizon and end <= horizon:
                what = "late"
            elif row[0] in counted:
                what = "repeated"
            else:
                what = "counted"
                counted.add(row[0])
            out[row, what] = out.get((row, what), 0) + 1
        newest = max([newest or START] + [r[1] for r in batch if r[1]])
    return out, newest


def run(spark, batches):
    home = work_folder(spark, "ledger-test")
    schema = spark.createDataFrame([], SCHEMA).schema
    ledger = Ledger(f"{home}/ledger", schema, keys=["id"], at="ts", group=["kind"], delay_seconds=DELAY)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.mode("append").parquet(f"{home}/landing")
        ledger.append(read_events(spark, f"{home}/landing", schema))
    return ledger


@pytest.mark.parametrize("seed", [1, 2])
def test_every_delivery_has_one_outcome(spark, seed):
    batches = deliveries(seed)
    ledger = run(spark, batches)
    want, newest = account(batches)
    got = {}
    for r in ledger.rows(spark).collect():
        key = (r["id"], r["ts"], r["kind"]), r["outcome"]
        got[key] = got.get(key, 0) + 1
    assert got == want and sum(got.values()) == sum(map(len, batches)) and {k[1] for k in got} == set(OUTCOMES)

    counts = {}
    for ((_, ts, kind), what), n in want.items():
        if what != "repeated":
            window = ts and ts.replace(minute=0, second=0, microsecond=0)
            status = "late" if what == "late" else "closed" if window and window + datetime.timedelta(
                hours=1) <= newest - datetime.timedelta(seconds=DELAY) else "open"
            counts[window, kind, status] = counts.get((window, kind, status), 0) + n
    assert {(r["window_start"], r["kind"], r["status"]): r["n"] for r in ledger.counts(spark).collect()} == counts


def test_a_repeated_batch_replaces_itself(spark):
    batches = deliveries(3, triggers=2)
    ledger = run(spark, batches)
    before = sorted(map(str, ledger.rows(spark).collect())), sorted(map(str, ledger.counts(spark).collect()))
    ledger._enter(spark.createDataFrame(batches[1], SCHEMA), 1)  # as after a failure behind the write
    assert (sorted(map(str, ledger.rows(spark).collect())), sorted(map(str, ledger.counts(spark).collect()))) == before


def test_nothing_delivered(spark):
    ledger = run(spark, [[], []])
    assert ledger.rows(spark).count() == 0 and ledger.counts(spark).count() == 0
