"""Stored judgments joined onto accounts under versioned rules, with a regression gate.

Scoring reads a judgment table and never calls a judge.  A judgment may lower
trust freely and raise a cap on one narrow path only; it never changes the
basis on which an account may be exported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.measures import fingerprint
from accountloom.operators.ordering import first_seen_names, latest_per_key

MARKS = {"elevated": R.RULE_JUDGE_ELEVATED, "sewer": R.RULE_JUDGE_SEWER,
         "treatment": R.RULE_JUDGE_TREATMENT, "industrial": R.RULE_JUDGE_INDUSTRIAL}
STATE_FIELDS = ("account", "vertical_naics", "states", "site_count", "total_chlorine_lb",
                "site_names_sample", "additional_sites_not_listed")


# --- evidence ----------------------------------------------------------------

def build_states(accounts: DataFrame, sites: DataFrame, cap: int = R.MAX_SITE_NAMES) -> DataFrame:
    """One evidence row per account: its figures, its first ``cap`` site names, and marks.

    The names are the text of a request and have a length; the marks, which patterns
    occur among the names, are over all sites.
    """
    place = F.concat(F.trim("facility_name"), F.lit(" ("), F.coalesce("city", F.lit("?")),
                     F.lit(", "), F.coalesce("state", F.lit("?")), F.lit(")"))
    names = first_seen_names(sites, ["account_key"], F.col("facility_name"), place, "ord", cap)
    low = F.lower(place)
    marks = sites.groupBy("account_key").agg(F.struct(*[
        F.coalesce(F.bool_or(low.rlike(p)), F.lit(False)).alias(n) for n, p in MARKS.items()]).alias("marks"))
    named = accounts.join(names, "account_key", "left").join(marks, "account_key", "left")
    return named.select(
        "account_key", "account", F.col("primary_naics").alias("vertical_naics"),
        F.col("state_list").alias("states"), F.col("sites").alias("site_count"),
        F.col("chlorine_lb").alias("total_chlorine_lb"),
        F.coalesce("names", F.array().cast("array<string>")).alias("site_names_sample"),
        F.coalesce("overflow", F.lit(0)).alias("additional_sites_not_listed"),
        F.coalesce("marks", F.struct(*[F.lit(False).alias(n) for n in MARKS])).alias("marks"))


def with_request_hash(states: DataFrame, prompt_version: str, model_version: str) -> DataFrame:
    """Content hash of the evidence; a new prompt or model is a new request."""
    body = F.to_json(F.struct(*sorted(STATE_FIELDS)))
    return states.withColumn(
        "request_hash", fingerprint(F.lit(prompt_version), F.lit(model_version), body))


def split_by_cache(states: DataFrame, sidecar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(already judged, still to judge)`` by request hash."""
    seen = sidecar.select("request_hash").distinct()
    return (states.join(seen, "request_hash", "left_semi"),
            states.join(seen, "request_hash", "left_anti"))


# --- answers -----------------------------------------------------------------

def rule_judge(marks: Column) -> Column:
    """Deterministic stand-in judge over site names: level, probabilities, two yes-probabilities."""
    elevated, sewer, industrial = marks["elevated"], marks["sewer"], marks["industrial"]

    def answer(case: str) -> Column:
        level, spread = R.RULE_JUDGE_SPREADS[case]
        levels = F.create_map(*[x for i, p in enumerate(spread) for x in (F.lit(i), F.lit(p))])
        return F.struct(F.lit(float(level)).alias("score"), levels.alias("probabilities"))

    buffer = (F.when(elevated & ~sewer, answer("elevated"))
              .when(elevated & sewer, answer("elevated_and_sewer"))
              .when(sewer, answer("sewer"))
              .when(marks["treatment"], answer("treatment"))
              .otherwise(answer("nothing")))
    return F.struct(
        buffer.alias("buffer_class"),
        F.when(industrial, 0.85).otherwise(0.06).alias("process_continuous"),
        F.when(industrial, 0.3).otherwise(0.9).alias("regulated_utility"))


def normalise_answers(answers: Column) -> Column:
    """Flat judgment: most probable level (lowest on a tie) and rounded probabilities."""
    entries = F.map_entries(answers["buffer_class"]["probabilities"])
    best = F.array_max(F.transform(entries, lambda e: F.struct(
        e["value"].alias("p"), (-e["key"]).alias("neg"))))
    ordered = F.map_from_entries(F.transform(
        F.array_sort(entries), lambda e: F.struct(e["key"], F.round(e["value"], 4))))
    return F.struct(
        answers["buffer_class"]["score"].cast("int").alias("buffer_level_selected"),
        (-best["neg"]).cast("int").alias("buffer_level_top"),
        F.round(best["p"], 4).alias("buffer_p_top"),
        ordered.alias("buffer_probabilities"),
        F.round(answers["process_continuous"], 4).alias("continuous_p_yes"),
        F.round(answers["regulated_utility"], 4).alias("regulated_p_yes"))


def judge_by_rules(states: DataFrame, judged_at: str, prompt_version: str = R.PROMPT_VERSION,
                   model_version: str = "rule-judge") -> DataFrame:
    """Sidecar rows from the rule judge, tagged ``mock`` so that they can never move a score."""
    answered = with_request_hash(states, prompt_version, model_version).withColumn(
        "answers", rule_judge(F.col("marks")))
    return answered.select(
        "request_hash", fingerprint(F.to_json("answers")).alias("response_hash"),
        F.lit(prompt_version).alias("prompt_version"), F.lit(model_version).alias("model_version"),
        F.lit("mock").alias("source"), "account",
        F.struct(*STATE_FIELDS).alias("state"), "answers",
        normalise_answers(F.col("answers")).alias("judgments"),
        F.lit(judged_at).alias("judged_at"))


def latest_judgments(sidecar: DataFrame, tie_break: Sequence[str] = ("request_hash",)) -> DataFrame:
    """Newest judgment per account."""
    return latest_per_key(sidecar, ["account"],
                          [F.desc("judged_at"), *[F.desc(c) for c in tie_break]])


# --- composition -------------------------------------------------------------

def buffer_label(buffer: Column) -> Column:
    return (F.when(buffer.startswith("elevated"), "elevated_any")
            .when(buffer.startswith("wet-well"), "wet_well_only")
            .when(buffer.startswith("mixed"), "mixed").otherwise("unknown"))


def level_name(level: Column) -> Column:
    return F.coalesce(
        F.try_element_at(F.array(*map(F.lit, R.LEVEL_NAMES)), level.cast("int") + 1),
        level.cast("string"))


def agreement(level: Column, label: Column) -> Column:
    """An elevated label agrees with either elevated level; others must be the same word."""
    return F.when(label == "elevated_any", level >= 3).otherwise(level_name(level) == label)


def compose(accounts: DataFrame, judgments: DataFrame,
            rules_version: str = R.RULES_VERSION) -> DataFrame:
    """Final score of every account.

    ``accounts`` carry ``account``, ``icp_score``, ``sheddability`` and
    ``buffer_class``; ``judgments`` hold one row per account.
    """
    j = judgments.select(
        "account", "source", F.col("judgments.buffer_level_top").alias("top"),
        F.col("judgments.buffer_p_top").alias("p"),
        F.col("judgments.continuous_p_yes").alias("continuous_p_yes"),
        F.col("judgments.regulated_p_yes").alias("regulated_p_yes"),
        "model_version", "prompt_version", "request_hash", "response_hash",
        F.lit(True).alias("judged"))
    basis = (F.col("qualification_basis") if "qualification_basis" in accounts.columns
             else F.lit("deterministic"))
    base = accounts.select(
        "account", F.col("icp_score").alias("baseline_score"),
        F.col("parts_total").alias("_parts") if "parts_total" in accounts.columns
        else F.col("icp_score").alias("_parts"),
        F.col("sheddability").alias("baseline_shed"), buffer_label(F.col("buffer_class")).alias("rule_buffer"),
        basis.alias("qualification_basis"))
    c = F.col
    rows = base.join(j, "account", "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    rows = rows.withColumn("agr", F.when(c("judged"), agreement(c("top"), c("rule_buffer"))))
    shed = c("baseline_shed")
    confident = c("p") >= R.P_LIFT
    note = (F.when(~c("judged"), "sidecar miss")
            .when(c("source") == "mock", "mock_source_no_lift")
            .when(c("source") != "engine", "legacy_live_frozen_no_lift")
            .when(c("continuous_p_yes") >= R.TAU_CONTINUOUS, "continuous_suspect_demote")
            .when((c("top") == 4) & confident & (c("rule_buffer") == "elevated_any"), "calibrated_high_lift")
            .when(c("top") == 0, "wet_well_physics_floor")
            .when(~c("agr") & confident, "judge_contradicts_rule_demote")
            .when(c("agr"), "agree_keep_cap").otherwise("insufficient_evidence_keep_cap"))
    rows = rows.withColumn("note", note)
    new_shed = (F.when(c("note").endswith("_demote"), F.least(shed, F.lit(R.DEMOTE_CAP)))
                .when(c("note") == "calibrated_high_lift",
                      F.when(shed <= 15, F.greatest(shed, F.lit(R.LIFTED_CAP))).otherwise(shed))
                .when(c("note") == "wet_well_physics_floor", F.least(shed, F.lit(R.WET_WELL_CAP)))
                .otherwise(shed))
    rows = rows.withColumns({
        "shed": new_shed.cast("long"),
        "lifted": c("note") == "calibrated_high_lift",
        "review_flag": F.when(c("continuous_p_yes") >= R.TAU_CONTINUOUS, "continuous_suspect").otherwise(""),
        "agreement": F.when(c("agr"), "yes").when(~c("agr"), "no").otherwise("")})
    rows = rows.withColumn("confirm_candidate", F.coalesce(
        ~c("lifted") & c("agr") & (c("source") == "engine") & confident, F.lit(False)))
    disposition = (F.when(~c("judged"), "no_judgment")
                   .when(c("review_flag") != "", "human-review")
                   .when((c("agreement") == "no") & c("note").contains("demote"), "demote")
                   .when(c("confirm_candidate"), "confirm-candidate")
                   .when(c("lifted"), "lifted").otherwise("keep"))
    final = F.least(F.lit(100), c("_parts") - c("baseline_shed") + c("shed")).cast("long")
    return rows.withColumns({"final_score": final, "disposition": disposition}).select(
        "account", "baseline_score", "final_score",
        (c("final_score") - c("baseline_score")).alias("delta"), "baseline_shed", "shed", "lifted",
        "disposition", "agreement", "rule_buffer",
        F.when(c("judged"), level_name(c("top"))).alias("judge_buffer_top"),
        c("p").alias("judge_p_top"), "continuous_p_yes", "regulated_p_yes", "confirm_candidate",
        "review_flag", "source", "note", F.lit(rules_version).alias("rules_version"),
        "model_version", "prompt_version", "request_hash", "response_hash", "qualification_basis",
        "judged")


# --- regression gate ---------------------------------------------------------

VERSIONS = ("rules_version", "prompt_version", "model_version")


def gate_verdict(results: DataFrame, snapshot: DataFrame, versions: dict[str, str],
                 budget: int = R.SHIFT_BUDGET) -> DataFrame:
    """One row: labelled scores that moved, whether any version changed, and the verdict."""
    now = results.select("account", "final_score")
    moved = snapshot.join(now, "account").agg(
        F.count_if(F.col("final_score") != F.col("score")).alias("moved"))
    changed = F.lit(False)
    for v in VERSIONS:
        changed = changed | ~F.col(v).eqNullSafe(F.lit(versions[v]))
    armed = snapshot.agg(F.coalesce(F.bool_or(changed), F.lit(False)).alias("armed"))
    return moved.select("moved", armed.scalar().alias("armed")).withColumn(
        "passed", ~(F.col("armed") & (F.col("moved") > budget)))


def quarantine(results: DataFrame, verdict: DataFrame) -> DataFrame:
    """Strip every judgment-derived point when the gate failed."""
    failed = ~verdict.select("passed").scalar()

    def swap(c: str, value: Column) -> Column:
        return F.when(failed, value).otherwise(F.col(c)).alias(c)

    changed = {
        "final_score": F.col("baseline_score"), "delta": F.lit(0).cast("long"),
        "shed": F.col("baseline_shed").cast("long"), "lifted": F.lit(False),
        "disposition": F.lit("quarantined_fallback"),
        "note": F.concat(F.lit("eval_gate_fail:"), "note")}
    return results.select(*[swap(c, changed[c]) if c in changed else F.col(c) for c in results.columns])


def next_snapshot(results: DataFrame, snapshot: DataFrame, verdict: DataFrame,
                  versions: dict[str, str]) -> DataFrame:
    """The snapshot to pin: it only advances when the gate passed."""
    passed = verdict.select("passed").scalar()
    fresh = results.select("account", F.col("final_score").alias("score"),
                           *[F.lit(versions[v]).alias(v) for v in VERSIONS])
    return fresh.filter(passed).unionByName(snapshot.select(*fresh.columns).filter(~passed))


def run_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("source", F.lit("missing")).alias("source"), "disposition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lifted").alias("lifted"))
