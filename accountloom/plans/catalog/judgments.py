"""Queries over stored judgments: evidence, answers, composition and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.measures import fingerprint
from accountloom.operators import judgments as J
from accountloom.operators.ordering import top_n
from accountloom.plans.catalog import query
from accountloom.plans.catalog.water import ACCOUNTS_SQL, water_run
from accountloom.sources import sidecar as SC
from accountloom.streaming.events import work_folder

VERSIONS = {"rules_version": R.RULES_VERSION, "prompt_version": R.PROMPT_VERSION,
            "model_version": "judge-1"}


def _accounts(spark, folder) -> DataFrame:
    return water_run(spark, folder).accounts.withColumn("sheddability", F.col("icp.components.sheddability"))


def _states(spark, folder) -> DataFrame:
    run = water_run(spark, folder)
    return J.build_states(run.accounts, run.keyed_sites.withColumn("account_key", F.col("key")))


def _digit(n: int) -> Column:
    """The n-th hexadecimal digit of the key's hash, as a number."""
    return F.expr(f"locate(substr(sha2(account_key, 256), {n}, 1), '0123456789abcdef') - 1")


def _digit_sql(n: int) -> str:
    return f"(strpos('0123456789abcdef', substr(sha256(account_key), {n}, 1)) - 1)"


def _sidecar(accounts: DataFrame) -> DataFrame:
    """A judgment table that follows from the accounts: two rows per account, so
    that the newer one must win, over every level, source and probability.  One
    account in sixteen has none."""
    turn = accounts.filter(_digit(5) != 3).select(
        "account_key", "account", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    level = (_digit(1) + F.col("turn")) % 5
    origin = _digit(2) + F.col("turn")
    return turn.select(
        fingerprint(F.col("account_key"), F.col("turn").cast("string")).alias("request_hash"),
        fingerprint(F.col("account"), F.col("turn").cast("string")).alias("response_hash"),
        F.lit(R.PROMPT_VERSION).alias("prompt_version"), F.lit("judge-1").alias("model_version"),
        F.when(origin < 2, "mock").when(origin < 4, "live").otherwise("engine").alias("source"),
        "account",
        F.struct(
            level.cast("int").alias("buffer_level_top"),
            F.when(_digit(3) < 9, 0.91).otherwise(0.42).alias("buffer_p_top"),
            F.when(_digit(4) < 2, 0.7).otherwise(0.12).alias("continuous_p_yes"),
            F.lit(0.9).alias("regulated_p_yes")).alias("judgments"),
        F.when(F.col("turn") == 0, "2026-01-01T00:00:00Z").otherwise("2026-02-01T00:00:00Z").alias("judged_at"))


_SIDE = ACCOUNTS_SQL + f""",
side AS (SELECT account, turn,
    CASE WHEN {_digit_sql(2)} + turn < 2 THEN 'mock' WHEN {_digit_sql(2)} + turn < 4 THEN 'live' ELSE 'engine' END AS source,
    ({_digit_sql(1)} + turn) % 5 AS top,
    CASE WHEN {_digit_sql(3)} < 9 THEN 0.91 ELSE 0.42 END::DOUBLE AS p,
    CASE WHEN {_digit_sql(4)} < 2 THEN 0.7 ELSE 0.12 END::DOUBLE AS cont,
    substr(sha256(account_key || chr(31) || turn), 1, 16) AS request_hash,
    substr(sha256(account || chr(31) || turn), 1, 16) AS response_hash
  FROM accounts, (VALUES (0), (1)) t(turn) WHERE {_digit_sql(5)} <> 3),
latest AS (SELECT * FROM side WHERE turn = 1),
j0 AS (
  SELECT a.account, icp_score AS baseline_score, sheddability AS baseline_shed, source, top, p, cont,
    request_hash, response_hash,
    meter_size + price_exposure + sheddability + operating_signal + channel_fit AS parts,
    CASE WHEN buffer_class LIKE 'elevated%' THEN 'elevated_any' WHEN buffer_class LIKE 'wet-well%' THEN 'wet_well_only'
         WHEN buffer_class LIKE 'mixed%' THEN 'mixed' ELSE 'unknown' END AS rule_buffer, l.account IS NOT NULL AS judged,
    CASE top WHEN 0 THEN 'wet_well_only' WHEN 1 THEN 'unknown' WHEN 2 THEN 'mixed' WHEN 3 THEN 'elevated_weak' WHEN 4 THEN 'elevated_strong' END AS top_name
  FROM accounts a LEFT JOIN latest l ON a.account = l.account),
j1 AS (SELECT *, CASE WHEN rule_buffer = 'elevated_any' THEN top >= 3 ELSE top_name = rule_buffer END AS agr FROM j0),
j2 AS (SELECT *, CASE WHEN NOT judged THEN 'sidecar miss' WHEN source = 'mock' THEN 'mock_source_no_lift' WHEN source = 'live' THEN 'legacy_live_frozen_no_lift'
    WHEN cont >= 0.5 THEN 'continuous_suspect_demote'
    WHEN top = 4 AND p >= 0.85 AND rule_buffer = 'elevated_any' THEN 'calibrated_high_lift'
    WHEN top = 0 THEN 'wet_well_physics_floor'
    WHEN NOT agr AND p >= 0.85 THEN 'judge_contradicts_rule_demote'
    WHEN agr THEN 'agree_keep_cap' ELSE 'insufficient_evidence_keep_cap' END AS note FROM j1),
j3 AS (SELECT *, CASE WHEN note IN ('continuous_suspect_demote', 'judge_contradicts_rule_demote') THEN least(baseline_shed, 10)
    WHEN note = 'calibrated_high_lift' AND baseline_shed <= 15 THEN greatest(baseline_shed, 20)
    WHEN note = 'wet_well_physics_floor' THEN least(baseline_shed, 9) ELSE baseline_shed END::BIGINT AS shed,
    note = 'calibrated_high_lift' AS lifted FROM j2),
results AS (SELECT account, baseline_score, least(100, parts - baseline_shed + shed)::BIGINT AS final_score,
    baseline_shed, shed, lifted, rule_buffer, top_name AS judge_buffer_top, p AS judge_p_top, cont AS continuous_p_yes,
    CASE WHEN judged THEN 0.9::DOUBLE END AS regulated_p_yes, source, note, request_hash, response_hash, judged,
    CASE WHEN agr THEN 'yes' WHEN NOT agr THEN 'no' ELSE '' END AS agreement,
    coalesce(NOT lifted AND agr AND source = 'engine' AND p >= 0.85, false) AS confirm_candidate,
    CASE WHEN cont >= 0.5 THEN 'continuous_suspect' ELSE '' END AS review_flag,
    CASE WHEN NOT judged THEN 'no_judgment' WHEN cont >= 0.5 THEN 'human-review' WHEN NOT agr AND note LIKE '%demote%' THEN 'demote'
      WHEN NOT lifted AND agr AND source = 'engine' AND p >= 0.85 THEN 'confirm-candidate'
      WHEN lifted THEN 'lifted' ELSE 'keep' END AS disposition FROM j3)"""


def _composed(spark, folder) -> DataFrame:
    accounts = _accounts(spark, folder)
    parts = sum((F.col(f"icp.components.{c}") for c in (
        "meter_size", "price_exposure", "sheddability", "operating_signal", "channel_fit")), F.lit(0))
    return J.compose(accounts.withColumn("parts_total", parts), J.latest_judgments(_sidecar(accounts)))


@query("judgment_compose", _SIDE + """
SELECT *, final_score - baseline_score AS delta, 'optb-v1' AS rules_version, CASE WHEN judged THEN 'judge-1' END AS model_version,
  CASE WHEN judged THEN 'uc1-water-v1' END AS prompt_version, 'deterministic' AS qualification_basis FROM results""")
def judgment_compose(spark, folder):
    return _composed(spark, folder)


@query("judgment_counts", _SIDE + """
SELECT coalesce(source, 'missing') AS source, disposition, count(*) AS n, count(*) FILTER (lifted) AS lifted FROM results GROUP BY ALL""")
def judgment_counts(spark, folder):
    return J.run_counts(_composed(spark, folder))


def _old_snapshot(results: DataFrame) -> DataFrame:
    return results.select("account", F.col("baseline_score").alias("score"),
                          F.lit("optb-v0").alias("rules_version"),
                          F.lit(R.PROMPT_VERSION).alias("prompt_version"),
                          F.lit("judge-1").alias("model_version"))


@query("judgment_gate", _SIDE + """,
v AS (SELECT count(*) FILTER (final_score <> baseline_score) AS moved FROM results)
SELECT account, CASE WHEN moved > 5 THEN baseline_score ELSE final_score END AS final_score,
  CASE WHEN moved > 5 THEN 'quarantined_fallback' ELSE disposition END AS disposition,
  CASE WHEN moved > 5 THEN 'eval_gate_fail:' || note ELSE note END AS note,
  CASE WHEN moved > 5 THEN false ELSE lifted END AS lifted FROM results, v""")
def judgment_gate(spark, folder):
    """A rules change against a pinned snapshot: too many moves strip every lift."""
    results = _composed(spark, folder)
    verdict = J.gate_verdict(results, _old_snapshot(results), VERSIONS)
    return J.quarantine(results, verdict).select(
        "account", "final_score", "disposition", "note", "lifted")


@query("judgment_gate_verdict", _SIDE + """
SELECT count(*) FILTER (final_score <> baseline_score) AS moved, true AS armed,
  count(*) FILTER (final_score <> baseline_score) <= 5 AS passed FROM results""")
def judgment_gate_verdict(spark, folder):
    results = _composed(spark, folder)
    return J.gate_verdict(results, _old_snapshot(results), VERSIONS)


def _near_snapshot(spark, folder, results: DataFrame) -> DataFrame:
    """A pinned snapshot that differs from the results in three accounts, within the budget."""
    ranks = water_run(spark, folder).accounts.select("account", "rank")
    return results.join(ranks, "account").select(
        "account", (F.col("final_score") + F.when(F.col("rank") <= 3, 1).otherwise(0)).alias("score"),
        F.lit("optb-v0").alias("rules_version"), F.lit(R.PROMPT_VERSION).alias("prompt_version"),
        F.lit("judge-1").alias("model_version"))


@query("judgment_gate_passing", _SIDE + """
SELECT account, final_score, disposition, note, lifted, 3 AS moved, 'optb-v1' AS pinned_rules FROM results""")
def judgment_gate_passing(spark, folder):
    """A rules change that moves few labelled scores: results stay and the snapshot advances."""
    results = _composed(spark, folder)
    snapshot = _near_snapshot(spark, folder, results)
    verdict = J.gate_verdict(results, snapshot, VERSIONS)
    pinned = J.next_snapshot(results, snapshot, verdict, VERSIONS).select(
        "account", F.col("rules_version").alias("pinned_rules"))
    return J.quarantine(results, verdict).join(pinned, "account").select(
        "account", "final_score", "disposition", "note", "lifted",
        verdict.select(F.col("moved").cast("int")).scalar().alias("moved"), "pinned_rules")


@query("judgment_snapshot", _SIDE + """,
v AS (SELECT count(*) FILTER (final_score <> baseline_score) AS moved FROM results)
SELECT account, CASE WHEN moved > 5 THEN baseline_score ELSE final_score END AS score,
  CASE WHEN moved > 5 THEN 'optb-v0' ELSE 'optb-v1' END AS rules_version FROM results, v""")
def judgment_snapshot(spark, folder):
    """A failed gate does not advance the pinned snapshot."""
    results = _composed(spark, folder)
    snapshot = _old_snapshot(results)
    verdict = J.gate_verdict(results, snapshot, VERSIONS)
    return J.next_snapshot(results, snapshot, verdict, VERSIONS).select("account", "score", "rules_version")


_STATES = ACCOUNTS_SQL + """,
first_names AS (SELECT key, trim(facility_name) || ' (' || city || ', ' || state || ')' AS shown, ord,
    row_number() OVER (PARTITION BY key, lower(trim(facility_name)) ORDER BY ord) AS rn FROM keyed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS pos, count(*) OVER (PARTITION BY key) AS n
  FROM first_names WHERE rn = 1),
states_of AS (
  SELECT key AS account_key, string_agg(shown, ' | ' ORDER BY pos) FILTER (pos <= 8) AS names, greatest(0, max(n) - 8) AS overflow
  FROM numbered GROUP BY key)"""


@query("judgment_states", _STATES + """
SELECT a.account_key, account, primary_naics AS vertical_naics, state_list AS states, sites AS site_count,
  chlorine_lb AS total_chlorine_lb, names, overflow FROM accounts a JOIN states_of USING (account_key)""")
def judgment_states(spark, folder):
    return _states(spark, folder).select(
        "account_key", "account", "vertical_naics", "states", "site_count", "total_chlorine_lb",
        F.array_join("site_names_sample", " | ").alias("names"),
        F.col("additional_sites_not_listed").alias("overflow"))


_KIND = "CASE WHEN d < 3 THEN ' Reservoir' WHEN d < 6 THEN ' Sewer' WHEN d < 9 THEN ' Treatment' WHEN d < 11 THEN ' Reservoir Sewer' WHEN d < 12 THEN ' Fertilizer' ELSE '' END"


@query("judgment_rule_judge", _STATES + f""",
every AS (SELECT key AS account_key, trim(facility_name) || ' (' || city || ', ' || state || ')' AS shown FROM keyed),
suffixed AS (SELECT account_key, shown || {_KIND} AS shown FROM (SELECT *, {_digit_sql(6)} AS d FROM every)),
t AS (SELECT account, lower(string_agg(shown, ' | ')) AS names FROM accounts JOIN suffixed USING (account_key) GROUP BY account),
f AS (SELECT account, regexp_matches(names, 'elevat|storage tank|pumping station|pump station|distribution|reservoir|standpipe|boost') AS elev,
  regexp_matches(names, 'sewer|wastewater|waste water|pollution control') AS sewer,
  regexp_matches(names, 'treatment|plant|wwtp|reclamation|resource recovery') AS treat,
  regexp_matches(names, 'fertilizer|chemical|refinery|mill|plant site [0-9]') AS ind FROM t)
SELECT account, 'mock' AS source,
  CASE WHEN elev AND NOT sewer THEN 4 WHEN elev THEN 2 WHEN sewer THEN 0 WHEN treat THEN 3 ELSE 1 END::INTEGER AS top,
  CASE WHEN elev AND NOT sewer THEN 0.65 WHEN elev THEN 0.55 WHEN sewer THEN 0.72 WHEN treat THEN 0.6 ELSE 0.55 END::DOUBLE AS p_top,
  CASE WHEN ind THEN 0.85 ELSE 0.06 END::DOUBLE AS continuous_p_yes, CASE WHEN ind THEN 0.3 ELSE 0.9 END::DOUBLE AS regulated_p_yes FROM f""")
def judgment_rule_judge(spark, folder):
    """Sites whose names carry the words of every branch, by a hash of the account."""
    run = water_run(spark, folder)
    sites = run.keyed_sites.withColumn("account_key", F.col("key")).withColumn("d", _digit(6)).withColumn(
        "facility_name", F.concat("facility_name", F.expr(_KIND)))
    rows = J.judge_by_rules(J.build_states(run.accounts, sites), "2026-01-01T00:00:00Z")
    return rows.select("account", "source", F.col("judgments.buffer_level_top").alias("top"),
                       F.col("judgments.buffer_p_top").alias("p_top"),
                       F.col("judgments.continuous_p_yes").alias("continuous_p_yes"),
                       F.col("judgments.regulated_p_yes").alias("regulated_p_yes"))


@query("judgment_request_hashes", _STATES + """
SELECT account, substr(sha256('uc1-water-v1' || chr(31) || 'judge-1' || chr(31) || to_json({
    'account': account, 'additional_sites_not_listed': overflow, 'site_count': sites,
    'site_names_sample': string_split(names, ' | '), 'states': state_list, 'total_chlorine_lb': chlorine_lb,
    'vertical_naics': primary_naics})), 1, 16) AS request_hash
FROM accounts JOIN states_of USING (account_key)""")
def judgment_request_hashes(spark, folder):
    """Content hash of each account's evidence, prompt version and model version."""
    return J.with_request_hash(_states(spark, folder), R.PROMPT_VERSION, "judge-1").select("account", "request_hash")


@query("judgment_cache_split", ACCOUNTS_SQL + """
SELECT account, sites > 3 AS cached FROM accounts""")
def judgment_cache_split(spark, folder):
    """Evidence already judged (larger accounts here) against evidence still to judge."""
    states = J.with_request_hash(_states(spark, folder), R.PROMPT_VERSION, "judge-1")
    sidecar = states.filter("site_count > 3").select("request_hash")
    done, todo = J.split_by_cache(states, sidecar)
    return done.select("account", F.lit(True).alias("cached")).unionByName(
        todo.select("account", F.lit(False).alias("cached")))


@query("judgment_sidecar", ACCOUNTS_SQL + "SELECT account, '2026-01-01T00:00:00Z' AS judged_at, 'mock' AS source FROM accounts")
def judgment_sidecar(spark, folder):
    """Two runs append to one sidecar; the second finds every request answered."""
    path = f"{work_folder(spark, 'sidecar')}/rows"
    for judged_at in ("2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"):
        SC.append_sidecar(J.judge_by_rules(_states(spark, folder), judged_at), path)
    return SC.read_sidecar(spark, path).select("account", "judged_at", "source")


@query("judgment_targets", ACCOUNTS_SQL + "SELECT account, rank FROM accounts ORDER BY rank LIMIT 50")
def judgment_targets(spark, folder):
    """The labelled set: the fifty best-ranked accounts."""
    return top_n(water_run(spark, folder).accounts, 50, F.asc("rank")).select("account", "rank")


@query("judgment_top_scores", _SIDE + """
SELECT account, final_score, disposition FROM results JOIN (SELECT account, rank FROM accounts) USING (account)
ORDER BY final_score DESC, rank LIMIT 12""")
def judgment_top_scores(spark, folder):
    results = _composed(spark, folder).join(
        water_run(spark, folder).accounts.select("account", "rank"), "account")
    return top_n(results, 12, F.desc("final_score"), F.asc("rank")).select(
        "account", "final_score", "disposition")


@query("export_eligibility", _SIDE + """
SELECT account, CASE WHEN lifted THEN 'judged' ELSE 'deterministic' END AS basis, NOT lifted AS eligible,
  CASE WHEN lifted THEN 'judged, pending confirmation' END AS held_reason FROM results""")
def export_eligibility(spark, folder):
    """Lifted accounts rest on a judgment alone here, so they are listed as held."""
    from accountloom.operators.gates import export_split

    rows = _composed(spark, folder).withColumn(
        "qualification_basis", F.when(F.col("lifted"), "judged").otherwise("deterministic"))
    eligible, held = export_split(rows)
    return eligible.unionByName(held).select(
        "account", F.col("qualification_basis").alias("basis"), "eligible", "held_reason")


@query("snapshot_round_trip", ACCOUNTS_SQL + """
SELECT account, icp_score AS score, 'optb-v1' AS rules_version FROM accounts""")
def snapshot_round_trip(spark, folder):
    """Two runs are pinned; the one taken last is read, whatever the runs are called."""
    from accountloom.sources import sinks

    scores = water_run(spark, folder).accounts.select("account", F.col("icp_score").alias("score"))
    pinned = scores.withColumns({k: F.lit(v) for k, v in VERSIONS.items()})
    path = work_folder(spark, "snapshots")
    sinks.write_snapshot(pinned.withColumn("score", F.lit(0).cast("long")), path, "run-9", "2026-01-09T00:00:00Z")
    sinks.write_snapshot(pinned, path, "run-10", "2026-01-10T00:00:00Z")
    return sinks.read_snapshot(spark, path).select("account", "score", "rules_version")
