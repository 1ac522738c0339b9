"""Judgment triage: evidence, cached or fresh judgments, composition, gate, snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.operators import judgments as J
from accountloom.operators.ordering import top_n
from accountloom.sources import sidecar as SC
from accountloom.sources import sinks

VERSION_COLUMNS = "account string, score bigint, rules_version string, prompt_version string, model_version string"


@dataclass(frozen=True)
class Triage:
    results: DataFrame
    verdict: DataFrame
    snapshot: DataFrame


def targets(accounts: DataFrame, limit: int | None) -> DataFrame:
    """The best-ranked accounts, or all of them without a limit."""
    return accounts if limit is None else top_n(accounts, limit, F.asc("rank"))


def judge_missing(accounts: DataFrame, sites: DataFrame, sidecar_path: str, *, limit: int | None, judged_at: str,
                  prompt_version: str = R.PROMPT_VERSION, model_version: str = "rule-judge") -> None:
    """Answer, by the rule judge, the top accounts whose evidence is not in the sidecar."""
    spark = accounts.sparkSession
    states = J.build_states(targets(accounts, limit), sites)
    asked = J.with_request_hash(states, prompt_version, model_version)
    _, todo = J.split_by_cache(asked, SC.read_sidecar(spark, sidecar_path))
    rows = J.judge_by_rules(todo.drop("request_hash"), judged_at, prompt_version, model_version)
    SC.append_sidecar(rows, sidecar_path)


def previous_snapshot(spark: SparkSession, path: str) -> DataFrame:
    try:
        return sinks.read_snapshot(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION_COLUMNS)


def run_triage(accounts: DataFrame, sidecar: DataFrame, snapshot: DataFrame, *, limit: int | None = None,
               versions: dict[str, str], budget: int = R.SHIFT_BUDGET) -> Triage:
    """Compose the accounts and hold them against the pinned snapshot.

    With a limit only the best-ranked accounts are judged; every other account has a
    ``not_targeted`` row with its own score.
    """
    chosen = targets(accounts, limit)
    results = J.compose(chosen, J.latest_judgments(sidecar), versions["rules_version"])
    verdict = J.gate_verdict(results, snapshot, versions, budget)
    shown = J.quarantine(results, verdict)
    if limit is not None:
        others = J.compose(accounts.join(chosen.select("account"), "account", "left_anti"),
                           sidecar.limit(0), versions["rules_version"])
        shown = shown.unionByName(others.withColumns({
            "disposition": F.lit("not_targeted"), "note": F.lit("outside the judged accounts")}))
    return Triage(shown, verdict, J.next_snapshot(results, snapshot, verdict, versions))
