"""Mapping rules, gate and sidecar."""

import pytest
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.operators import judgments as J
from accountloom.plans.triage import judge_missing, previous_snapshot, run_triage
from accountloom.sources import sidecar as SC
from accountloom.sources import sinks

LABELS = {"elevated": R.BUFFER_ELEVATED, "wet-well": R.BUFFER_WET_WELL, "mixed": R.BUFFER_MIXED}
SHED = {"elevated": 12, "wet-well": 9, "mixed": 8}
V = {"rules_version": "r1", "prompt_version": "p1", "model_version": "m1"}


def accounts(spark, rows):
    return spark.createDataFrame(
        [(n, 50 + SHED[b], SHED[b], LABELS[b], i) for i, (n, b) in enumerate(rows, 1)],
        "account string, icp_score long, sheddability long, buffer_class string, rank int")


def judgments(spark, rows):
    return spark.createDataFrame(
        [(n, s, (top, p, cont, 0.9), "m1", "p1", "h-" + n, "r-" + n, at) for n, s, top, p, cont, at in rows],
        "account string, source string, judgments struct<buffer_level_top:int,buffer_p_top:double,"
        "continuous_p_yes:double,regulated_p_yes:double>, model_version string, prompt_version string,"
        "request_hash string, response_hash string, judged_at string")


CASES = [
    ("elevated", 4, 0.9, 0.1, "engine", 20, "lifted", "calibrated_high_lift"),
    ("wet-well", 4, 0.9, 0.1, "engine", 9, "demote", "judge_contradicts_rule_demote"),
    ("elevated", 0, 0.9, 0.1, "engine", 9, "keep", "wet_well_physics_floor"),
    ("elevated", 4, 0.9, 0.7, "engine", 10, "human-review", "continuous_suspect_demote"),
    ("elevated", 4, 0.9, 0.1, "mock", 12, "keep", "mock_source_no_lift"),
    ("elevated", 4, 0.9, 0.1, "live", 12, "keep", "legacy_live_frozen_no_lift"),
    ("elevated", 3, 0.9, 0.1, "engine", 12, "confirm-candidate", "agree_keep_cap"),
    ("wet-well", 4, 0.25, 0.1, "engine", 9, "keep", "insufficient_evidence_keep_cap"),
    ("elevated", 4, 0.29, 0.1, "engine", 12, "keep", "agree_keep_cap"),
]


def test_mapping_rules(spark):
    a = accounts(spark, [(f"a{i}", c[0]) for i, c in enumerate(CASES)] + [("missing", "mixed")])
    j = judgments(spark, [(f"a{i}", c[4], c[1], c[2], c[3], "2026-01-01") for i, c in enumerate(CASES)])
    got = {r["account"]: r for r in J.compose(a, j).collect()}
    for i, c in enumerate(CASES):
        r = got[f"a{i}"]
        assert (r["shed"], r["disposition"], r["note"]) == (c[5], c[6], c[7]), c
        assert r["final_score"] == 50 + c[5] and r["qualification_basis"] == "deterministic"
    assert got["missing"]["disposition"] == "no_judgment" and got["missing"]["delta"] == 0


def test_latest_judgment_wins(spark):
    j = judgments(spark, [("a", "engine", 4, 0.9, 0.1, "2026-01-01"), ("a", "engine", 0, 0.9, 0.1, "2026-02-01")])
    assert J.latest_judgments(j).first()["judgments"]["buffer_level_top"] == 0


def snapshot(spark, rows, **over):
    v = {**V, **over}
    return spark.createDataFrame([(n, s, *v.values()) for n, s in rows],
                                 "account string, score long, rules_version string, prompt_version string, model_version string")


@pytest.mark.parametrize("over,moved,passed", [
    ({"rules_version": "r0"}, 6, False), ({"prompt_version": "p0"}, 6, False), ({"model_version": "m0"}, 6, False),
    ({}, 6, True), ({"rules_version": "r0"}, 5, True)])
def test_gate(spark, over, moved, passed):
    names = [f"n{i}" for i in range(6)]
    a = accounts(spark, [(n, "elevated") for n in names])
    j = judgments(spark, [(n, "engine", 4, 0.9, 0.1, "2026") for n in names])
    snap = snapshot(spark, [(n, 62 if i < moved else 70) for i, n in enumerate(names)], **over)
    t = run_triage(a, j, snap, versions=V)
    assert t.verdict.first()["passed"] is passed and t.verdict.first()["moved"] == moved
    kinds = {r["disposition"] for r in t.results.collect()}
    assert kinds == ({"lifted"} if passed else {"quarantined_fallback"})
    pinned = {(r["rules_version"], r["score"]) for r in t.snapshot.collect()}
    assert pinned == ({("r1", 70)} if passed else {(over.get("rules_version", "r1"), 62)})


def test_first_run_has_no_snapshot(spark, tmp_path):
    empty = previous_snapshot(spark, str(tmp_path / "none"))
    a = accounts(spark, [("x", "elevated")])
    t = run_triage(a, judgments(spark, [("x", "engine", 4, 0.9, 0.1, "2026")]), empty, versions=V)
    assert t.verdict.first()["passed"]
    sinks.write_snapshot(t.snapshot, str(tmp_path / "snap"), "run-1", "2026-01-01")
    back = previous_snapshot(spark, str(tmp_path / "snap"))
    assert [tuple(r) for r in back.select("account", "score", "rules_version").collect()] == [("x", 70, "r1")]
    sinks.write_triage(t.results, str(tmp_path / "triage"))
    assert tuple(spark.read.csv(str(tmp_path / "triage"), header=True).columns) == sinks.TRIAGE_COLUMNS


def evidence(spark, names):
    sites = [("k", n, "Austin", "TX", i) for i, n in enumerate(names)]
    a = spark.createDataFrame([("k", "Utility", "22131", "TX", 3, 10, 1)],
                              "account_key string, account string, primary_naics string, state_list string, sites long, chlorine_lb long, rank int")
    s = spark.createDataFrame(sites, "account_key string, facility_name string, city string, state string, ord long")
    return a, s


@pytest.mark.parametrize("names,level,p", [
    (["Elm Pump Station"], 4, 0.65), (["Elm Reservoir", "Oak Sewer Plant"], 2, 0.55), (["Oak Sewer"], 0, 0.72),
    (["Oak Treatment"], 3, 0.6), (["Nothing"], 1, 0.55)])
def test_rule_judge(spark, names, level, p):
    a, s = evidence(spark, names)
    row = J.judge_by_rules(J.build_states(a, s), "2026").first()
    assert (row["judgments"]["buffer_level_top"], row["judgments"]["buffer_p_top"], row["source"]) == (level, p, "mock")


def test_ties_go_to_the_lowest_level(spark):
    answers = F.struct(F.struct(F.lit(2.0).alias("score"), F.create_map(
        F.lit(3), F.lit(0.4), F.lit(1), F.lit(0.4), F.lit(0), F.lit(0.2)).alias("probabilities")).alias("buffer_class"),
        F.lit(0.123456).alias("process_continuous"), F.lit(0.5).alias("regulated_utility"))
    j = spark.range(1).select(J.normalise_answers(answers).alias("j")).first()["j"]
    assert j["buffer_level_top"] == 1 and j["continuous_p_yes"] == 0.1235
    assert list(j["buffer_probabilities"]) == [0, 1, 3]


def test_sidecar_only_grows_by_unseen_requests(spark, tmp_path):
    path = str(tmp_path / "sidecar")
    assert SC.read_sidecar(spark, path).count() == 0
    a, s = evidence(spark, ["Elm Reservoir"])
    judge_missing(a, s, path, limit=5, judged_at="2026-01-01")
    judge_missing(a, s, path, limit=5, judged_at="2026-02-01")
    assert [r["judged_at"] for r in SC.read_sidecar(spark, path).collect()] == ["2026-01-01"]
    judge_missing(a, s, path, limit=5, judged_at="2026-03-01", model_version="other")
    assert SC.read_sidecar(spark, path).count() == 2


def test_hash_follows_content(spark):
    a, s = evidence(spark, ["Elm", "Oak"])
    b = J.build_states(a, s.repartition(3))
    h = [J.with_request_hash(x, p, m).first()["request_hash"] for x, p, m in (
        (J.build_states(a, s), "p", "m"), (b, "p", "m"), (b, "p2", "m"), (b, "p", "m2"))]
    assert h[0] == h[1] and len(set(h)) == 3 and len(h[0]) == 16


def test_newest_snapshot_is_the_one_taken_last(spark, tmp_path):
    path = str(tmp_path / "snap")
    for run, at, score in (("run-9", "2026-01-09", 1), ("run-10", "2026-01-10", 2), ("007", "2026-01-08", 3)):
        sinks.write_snapshot(snapshot(spark, [("x", score)]), path, run, at)
    back = sinks.read_snapshot(spark, path).collect()
    assert [(r["account"], r["score"]) for r in back] == [("x", 2)] and back[0]["rules_version"] == "r1"
    assert {r["run"] for r in sinks.read_all_snapshots(spark, path).collect()} == {"run-9", "run-10", "007"}
    with pytest.raises(ValueError):
        sinks.write_snapshot(snapshot(spark, [("x", 9)]), path, "run-9", "2026-02-01")


def test_accounts_outside_the_limit_have_a_row(spark):
    names = [f"n{i}" for i in range(5)]
    a = accounts(spark, [(n, "elevated") for n in names])
    j = judgments(spark, [(n, "engine", 4, 0.9, 0.1, "2026") for n in names])
    t = run_triage(a, j, snapshot(spark, []), limit=2, versions=V)
    got = {r["account"]: (r["disposition"], r["delta"]) for r in t.results.collect()}
    assert got == {"n0": ("lifted", 8), "n1": ("lifted", 8), **{n: ("not_targeted", 0) for n in names[2:]}}
    assert {r["account"] for r in t.snapshot.collect()} == {"n0", "n1"}
    everyone = run_triage(a, j, snapshot(spark, []), versions=V)
    assert {r["disposition"] for r in everyone.results.collect()} == {"lifted"}


def test_rule_judge_sees_names_beyond_the_request(spark):
    a, s = evidence(spark, [f"Elm {i}" for i in range(20)] + ["Oak Sewer"])
    states = J.build_states(a, s)
    row = states.first()
    assert len(row["site_names_sample"]) == R.MAX_SITE_NAMES and row["additional_sites_not_listed"] == 13
    assert J.judge_by_rules(states, "2026").first()["judgments"]["buffer_level_top"] == 0
