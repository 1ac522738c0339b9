"""Queries over the water vertical."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom.plans import water as W
from accountloom.plans.catalog import query
from accountloom.plans.catalog import registry_sql as S
from accountloom.plans.catalog.demo import WATER_DEMO
from accountloom.sources.driver_tables import filings, landed_at

_RUNS: dict = {}


def fresh_water_run(spark, folder) -> W.WaterRun:
    rows = filings(spark, folder).withColumn("ammonia_lb", F.col("charge_lb"))
    return W.run_water(rows, WATER_DEMO)


def water_run(spark, folder) -> W.WaterRun:
    """One run per application and state of the landed tables; see ``registry_run``."""
    at = (spark.sparkContext.applicationId, folder, landed_at(spark, folder))
    if at not in _RUNS:
        _RUNS[at] = fresh_water_run(spark, folder)
    return _RUNS[at]


_RULED = """CASE WHEN regexp_matches(lower(reported), '^red bolt|(^|[^a-z0-9])large bolt') THEN 'Bolt Utilities Holdings'
              WHEN regexp_matches(lower(reported), '(^|[^a-z0-9])small (ring|plate)') THEN 'Small Works Authority' END"""


def _gate(f: str, label: str) -> str:
    return f"""CASE WHEN {f} > {f}_p99 * 10 THEN '{f} ' || format('{{:,}}', {f}) || ' exceeds p99 ('
      || format('{{:,}}', {f}_p99) || ' lb) x 10; median ' || format('{{:,}}', {f}_median)
      || ' lb. Probable units error, bulk storage terminal, or misfiled {label} plant. '
      || 'Excluded from scoring pending human review.' END"""


def _stat(f: str) -> str:
    return f"""
pop_{f} AS (SELECT {f} AS v, row_number() OVER (ORDER BY {f}) - 1 AS rn, count(*) OVER () AS n
  FROM kept JOIN spellings USING (reported) WHERE key IS NOT NULL AND {f} > 0),
stat_{f} AS (SELECT
  coalesce(max(v) FILTER (rn = least(n - 1, floor(n * 0.99::DOUBLE)::BIGINT)), 0) AS {f}_p99,
  coalesce(max(v) FILTER (rn = least(n - 1, floor(n * 0.5::DOUBLE)::BIGINT)), 0) AS {f}_median
  FROM pop_{f})"""


_BASE = "WITH " + ",".join([S.LINES, S.FILINGS]) + """,
rows0 AS (
  SELECT *, charge_lb AS ammonia_lb,
    CASE WHEN regexp_matches(concat_ws(' ', facility_name, parent_name, operator_name), '(?i)\\bhot plate\\b|\\bcold rod')
         THEN 'continuous process — plates and rods — continuous/unsuitable process, refused at ingestion'
         WHEN regexp_matches(concat_ws(' ', facility_name, parent_name, operator_name), '(?i)\\bnew anvil(s)?\\b')
         THEN 'anvil forging, not water service — continuous/unsuitable process, refused at ingestion' END AS excluded,
    coalesce(parent_name, operator_name, facility_name) AS reported
  FROM filings WHERE NOT is_deregistered),
kept AS (SELECT * FROM rows0 WHERE excluded IS NULL),
named AS (SELECT * FROM kept)"""

_SITES = ",".join([_BASE, S.spellings(_RULED), _stat("chlorine_lb"), _stat("ammonia_lb")]) + f""",
sites AS (
  SELECT *, validation_note = '' AS validated FROM (
    SELECT kept.*, concat_ws(' | ', {_gate('chlorine_lb', 'chlorine')}, {_gate('ammonia_lb', 'ammonia')}) AS validation_note,
      CASE WHEN chlorine_lb >= 300000 THEN 8000 WHEN chlorine_lb >= 100000 THEN 5000
           WHEN chlorine_lb >= 40000 THEN 3000 WHEN chlorine_lb >= 10000 THEN 1500
           WHEN program_level = 1 THEN 2000 WHEN program_level = 2 THEN 1200 ELSE 500 END::BIGINT AS est_peak_kw,
      CASE WHEN regexp_matches(facility_name, '(?i)\\b(gizmo|gear)\\b') THEN 'wet-well / inflow detention (inferred)'
           WHEN regexp_matches(facility_name, '(?i)\\b(widget|ring)\\b') THEN 'elevated storage network (inferred)'
           WHEN naics LIKE 'Brand#1%' THEN 'elevated storage network (inferred)'
           WHEN naics LIKE 'Brand#2%' THEN 'wet-well / inflow detention (inferred)'
           ELSE 'buffer unknown' END AS buffer_class
    FROM kept, stat_chlorine_lb, stat_ammonia_lb))"""


def _mode(col: str) -> str:
    return f"""
mode_{col} AS (
  SELECT key, {col} AS primary_{col} FROM (
    SELECT key, {col}, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(ord)) AS rn
    FROM keyed GROUP BY key, {col}) WHERE rn = 1)"""


_ROLLED = _SITES + """,
keyed AS (SELECT sites.*, key, shown, resolved_by FROM sites JOIN spellings USING (reported) WHERE key IS NOT NULL),
own AS (SELECT key, shown AS account FROM (
  SELECT key, shown, row_number() OVER (PARTITION BY key ORDER BY resolved_by <> 'rule', ord) AS rn FROM keyed) WHERE rn = 1),
classes AS (SELECT key, buffer_class, count(*) AS n FROM keyed WHERE validated GROUP BY ALL),
top_class AS (SELECT key, CASE WHEN count(*) FILTER (n = mx) > 1 THEN 'mixed portfolio (per-station audit required)'
    ELSE max(buffer_class) FILTER (n = mx) END AS buffer_class
  FROM (SELECT *, max(n) OVER (PARTITION BY key) AS mx FROM classes) GROUP BY key),""" + ",".join(
    map(_mode, ("state", "rto", "naics"))) + """,
totals AS (SELECT key, min(ord) AS first_ord, count(*) AS sites, count(*) FILTER (validated) AS ok_sites,
    coalesce(sum(chlorine_lb) FILTER (validated), 0)::BIGINT AS chlorine_lb,
    coalesce(sum(ammonia_lb) FILTER (validated), 0)::BIGINT AS ammonia_lb,
    coalesce(max(chlorine_lb) FILTER (validated), 0)::BIGINT AS max_site_chlorine_lb,
    coalesce(sum(est_peak_kw) FILTER (validated), 0)::BIGINT AS est_peak_kw_total,
    count(DISTINCT state) AS states, string_agg(DISTINCT state, ',' ORDER BY state) AS state_list,
    sum(accidents)::BIGINT AS accidents, count(*) FILTER (validated AND accidents > 0) AS sites_with_accidents,
    count(*) FILTER (validated AND recent_accidents > 0) AS recent_accident_sites
  FROM keyed GROUP BY key),
buckets AS (
  SELECT *, key AS account_key, false AS is_customer, sites - ok_sites AS unvalidated_sites, false AS buffer_confirmed,
    primary_state IN ('NATION_1', 'NATION_4', 'NATION_8', 'NATION_9', 'NATION_15') AS dereg_state,
    ok_sites > 1 AS multi_site,
    regexp_matches(account, '(?i)\\b(bolt|rod|authority|region\\w*)\\b') AS is_authority,
    CASE substr(primary_naics, 1, 7) WHEN 'Brand#1' THEN 'Group 1' WHEN 'Brand#2' THEN 'Group 2' ELSE 'Other' END AS vertical,
    ok_sites > 0 AND (est_peak_kw_total >= 1000 OR ok_sites >= 2) AS admitted
  FROM totals JOIN own USING (key) JOIN mode_state USING (key) JOIN mode_rto USING (key)
    JOIN mode_naics USING (key) LEFT JOIN top_class USING (key)),
scored AS (
  SELECT *, least(25, round_even(est_peak_kw_total / 400, 0)::BIGINT) AS meter_size,
    least(25, CASE WHEN primary_rto IN ('ASIA', 'EUROPE') THEN 12 WHEN primary_rto IN ('AMERICA', 'AFRICA') THEN 8 ELSE 5 END
      + CASE WHEN dereg_state THEN 6 ELSE 0 END)::BIGINT AS price_exposure,
    CASE WHEN buffer_class LIKE 'elevated%' THEN 12 WHEN buffer_class LIKE 'wet-well%' THEN 9
         WHEN buffer_class LIKE 'mixed%' THEN 8 ELSE 4 END::BIGINT AS sheddability,
    least(15, sites_with_accidents * 4 + CASE WHEN recent_accident_sites > 0 THEN 3 ELSE 0 END)::BIGINT AS operating_signal,
    least(10, CASE WHEN multi_site THEN 2 ELSE 0 END + CASE WHEN states > 1 THEN 4 ELSE 0 END
      + CASE WHEN is_authority THEN 4 ELSE 0 END)::BIGINT AS channel_fit
  FROM buckets WHERE admitted),
accounts AS (
  SELECT *, least(100, meter_size + price_exposure + sheddability + operating_signal + channel_fit)::BIGINT AS icp_score,
    row_number() OVER (ORDER BY est_peak_kw_total DESC, chlorine_lb DESC, first_ord) AS rank FROM scored)"""

ACCOUNT = ("account_key", "account", "is_customer", "sites", "unvalidated_sites", "chlorine_lb",
           "ammonia_lb", "max_site_chlorine_lb", "est_peak_kw_total", "buffer_class",
           "buffer_confirmed", "states", "state_list", "primary_state", "primary_rto",
           "dereg_state", "multi_site", "is_authority", "accidents", "sites_with_accidents",
           "recent_accident_sites", "primary_naics", "vertical")
_PARTS = "meter_size, price_exposure, sheddability, operating_signal, channel_fit"
ACCOUNTS_SQL = _ROLLED


@query("water_icp_rank", _ROLLED + f"SELECT {', '.join(ACCOUNT)}, icp_score, rank, {_PARTS} FROM accounts")
def water_icp_rank(spark, folder):
    return fresh_water_run(spark, folder).accounts.select(*ACCOUNT, "icp_score", "rank", "icp.components.*")


@query("water_site_measures", _SITES + """
SELECT facility_id, chlorine_lb::BIGINT AS chlorine_lb, ammonia_lb, validated, validation_note, est_peak_kw, buffer_class FROM sites""")
def water_site_measures(spark, folder):
    run = water_run(spark, folder)
    return W.with_site_measures(run.sites, run.profile).select(
        "facility_id", "chlorine_lb", "ammonia_lb", "validated", "validation_note", "est_peak_kw",
        "buffer_class")


@query("process_exclusions", _BASE + """
SELECT facility_id, facility_name, excluded AS reason FROM rows0 WHERE excluded IS NOT NULL""")
def process_exclusions(spark, folder):
    rows = W.with_exclusion(filings(spark, folder).filter(~F.col("is_deregistered")), WATER_DEMO)
    return rows.filter("excluded is not null").select(
        "facility_id", "facility_name", F.col("excluded").alias("reason"))


@query("water_review_queue", _ROLLED + """
SELECT 'numeric_outlier' AS kind, facility_id, facility_name AS name, city, state, naics,
  k.chlorine_lb::BIGINT AS chlorine_lb, k.ammonia_lb, NULL::VARCHAR AS reported_name, account,
  validation_note AS reason, validation_note, 'verify the filing, correct the value, or confirm exclusion' AS action
FROM keyed k JOIN own USING (key) WHERE NOT validated
UNION ALL SELECT 'unresolved_name', facility_id, facility_name, city, state, naics, chlorine_lb, ammonia_lb, reported, NULL,
  'no usable parent/operator/facility name after normalisation', '', 'assign to a utility account or create one'
FROM sites LEFT JOIN spellings USING (reported) WHERE key IS NULL
UNION ALL SELECT 'process_exclusion', facility_id, facility_name, city, state, naics, chlorine_lb, ammonia_lb, NULL, NULL,
  excluded, '', 'confirm refusal or reclassify (human)' FROM rows0 WHERE excluded IS NOT NULL
UNION ALL SELECT 'below_threshold', NULL, NULL, NULL, primary_state, primary_naics, chlorine_lb, ammonia_lb, account, account,
  'estimated draw ' || est_peak_kw_total || ' kW, below the 1000 kW floor', '', 'confirm whether this is a prospect'
FROM buckets WHERE NOT admitted""")
def water_review_queue(spark, folder):
    return water_run(spark, folder).review_queue
