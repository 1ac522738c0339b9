"""Queries over the registry pipeline: resolution, gate, roll-up, rank and queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.functions import measures as M
from accountloom.functions import names as N
from accountloom.operators import ordering as O
from accountloom.operators import quality as Q
from accountloom.operators import resolve as RS
from accountloom.plans import queue as RQ
from accountloom.plans import registry as P
from accountloom.plans.catalog import query
from accountloom.plans.catalog import registry_sql as S
from accountloom.plans.catalog.demo import COLD_DEMO
from accountloom.sources.driver_tables import all_filings, filings, landed_at, table

_RUNS: dict[tuple, P.RegistryRun] = {}


def fresh_run(spark: SparkSession, folder: str) -> P.RegistryRun:
    return P.run_registry(filings(spark, folder), COLD_DEMO)


def registry_run(spark: SparkSession, folder: str) -> P.RegistryRun:
    """One pipeline run per application and state of the landed tables: its tables are
    pinned in the shared folder, and the report queries below read them."""
    at = (spark.sparkContext.applicationId, folder, landed_at(spark, folder))
    if at not in _RUNS:
        _RUNS[at] = fresh_run(spark, folder)
    return _RUNS[at]


ACCOUNT = ("account_key", "account", "is_customer", "sites", "unvalidated_sites", "charge_lb",
           "max_site_charge_lb", "states", "state_list", "primary_rto", "accidents",
           "sites_with_accidents", "primary_naics", "vertical")
_ACCOUNT = ", ".join(ACCOUNT)


@query("account_icp_rank", S.ROLLED + f"""
SELECT {_ACCOUNT}, icp_score, rank, scale::BIGINT AS scale, refrig_intensity::BIGINT AS refrig_intensity,
  geographic_spread::BIGINT AS geographic_spread, grid_exposure::BIGINT AS grid_exposure,
  replacement_signal::BIGINT AS replacement_signal, vertical_fit::BIGINT AS vertical_fit FROM accounts""")
def account_icp_rank(spark, folder):
    return fresh_run(spark, folder).accounts.select(*ACCOUNT, "icp_score", "rank", "icp.components.*")


@query("account_rollup", S.ROLLED + f"SELECT {_ACCOUNT}, ok_sites, admitted FROM buckets")
def account_rollup(spark, folder):
    run = registry_run(spark, folder)
    return run.buckets.select(*ACCOUNT, "ok_sites", P.admitted(run.profile).alias("admitted"))


@query("account_aliases", S.ROLLED + """
SELECT DISTINCT account_key, account, reported AS alias
FROM keyed JOIN buckets USING (account_key) WHERE admitted""")
def account_aliases(spark, folder):
    return registry_run(spark, folder).account_aliases.select("account_key", "account", "alias")


@query("account_sites", S.ROLLED + """
SELECT k.facility_id, k.account_key, b.account, k.facility_name, k.city, k.state, k.rto, k.naics,
  k.charge_lb, k.accidents, k.validated, k.validation_note, k.merged
FROM keyed k JOIN buckets b USING (account_key) WHERE admitted""")
def account_sites(spark, folder):
    return registry_run(spark, folder).account_sites.select(
        "facility_id", "account_key", "account", "facility_name", "city", "state", "rto", "naics",
        "charge_lb", F.col("accidents").cast("int").alias("accidents"), "validated",
        "validation_note", "merged")


@query("accounts_csv", S.ROLLED + f"""
SELECT rank::VARCHAR AS rank, icp_score::VARCHAR AS icp_score, account, CASE WHEN is_customer THEN 'True' ELSE 'False' END AS is_customer,
  sites::VARCHAR AS sites, charge_lb::VARCHAR AS ammonia_lb, state_list, vertical, aliases
FROM accounts JOIN (SELECT account_key, string_agg(DISTINCT reported, ' | ' ORDER BY reported) AS aliases FROM keyed GROUP BY 1) USING (account_key)""")
def accounts_csv(spark, folder):
    """The account sink, written as CSV and read back as text."""
    from accountloom.sources import sinks
    from accountloom.streaming.events import work_folder

    path = f"{work_folder(spark, 'accounts-csv')}/rows"
    sinks.write_csv(sinks.accounts_table(registry_run(spark, folder)), path)
    return spark.read.csv(path, header=True, quote='"', escape='"').select(
        "rank", "icp_score", "account", "is_customer", "sites", "ammonia_lb", "state_list", "vertical", "aliases")


@query("resolve_names", S.RESOLVED + f"""
SELECT reported, key, shown, resolved_by,
  CASE WHEN loose IS NOT NULL AND loose_key IS DISTINCT FROM key THEN loose END AS rescue,
  nullif(trim(regexp_extract(trim(shown), '^(.+?)\\s+[#\\-]?\\s*(?:[IVX]{{2,4}}|\\d{{1,3}})$', 1)), '') AS stem,
  {S.person_test('reported')} AS person_like, {S.norm_of('reported')} AS norm
FROM spellings""")
def resolve_names(spark, folder):
    run = registry_run(spark, folder)
    raw = F.col("reported")
    return run.spellings.select(
        "reported", "key", "shown", "resolved_by",
        N.merge_rescue(raw, F.col("key"), run.profile.rules).alias("rescue"),
        N.site_number_stem(F.col("shown")).alias("stem"),
        N.looks_like_person(raw).alias("person_like"), N.norm_name(raw).alias("norm"))


@query("resolve_by_rule_table", S.BASE + """,
rules AS (SELECT DISTINCT replace(p_name, ' ', '[- ]?') || '|^the ' || p_name AS pattern, p_name || ' Group' AS canonical, 'b' || p_name AS rule_ord FROM part
  UNION ALL SELECT 'works \\((the )?' || lower(n_name), n_name || ' Works', 'a' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'),
names AS (SELECT DISTINCT facility_name AS name FROM filings)
SELECT name, arg_min(canonical, rule_ord) AS canonical
FROM names JOIN rules ON regexp_matches(lower(name), '(^|[^a-z0-9])(' || pattern || ')')
GROUP BY name""")
def resolve_by_rule_table(spark, folder):
    """Rules as a table, without anchors: one per part name, and some on the word that all names share."""
    named = F.col("p_name")
    part = table(spark, folder, "part").select(
        F.concat(F.replace(named, F.lit(" "), F.lit("[- ]?")), F.lit("|^the "), named).alias("pattern"),
        F.concat(named, F.lit(" Group")).alias("canonical"), F.concat(F.lit("b"), named).alias("rule_ord")).distinct()
    asia = table(spark, folder, "nation").join(table(spark, folder, "region").filter("r_name = 'ASIA'"),
                                               F.col("n_regionkey") == F.col("r_regionkey"))
    nation = asia.select(F.concat(F.lit(r"works \((the )?"), F.lower("n_name")).alias("pattern"),
                         F.concat("n_name", F.lit(" Works")).alias("canonical"), F.concat(F.lit("a"), "n_name").alias("rule_ord"))
    names = all_filings(spark, folder).select(F.col("facility_name").alias("name")).distinct()
    return RS.resolve_by_rule_table(names, "name", part.unionByName(nation))


@query("site_flags", S.FLAGGED + """
SELECT facility_id, reported, charge_lb, validated, validation_note FROM sites""")
def site_flags(spark, folder):
    return registry_run(spark, folder).sites.select(
        "facility_id", "reported", "charge_lb", "validated", "validation_note")


@query("charge_statistics", S.FLAGGED + """
SELECT n, p99, median, (p99 * 10)::BIGINT AS ceiling FROM stats""")
def charge_statistics(spark, folder):
    return registry_run(spark, folder).stats.select(
        F.col("charge_lb_n").alias("n"), F.col("charge_lb_p99").alias("p99"),
        F.col("charge_lb_median").alias("median"), (F.col("charge_lb_p99") * 10).alias("ceiling"))


@query("max_charge_by_chemical", S.BASE + """
SELECT facility_id, greatest(charge_lb, 0) AS ammonia_lb, chlorine_lb::BIGINT AS chlorine_lb FROM filings""")
def max_charge_by_chemical(spark, folder):
    f = filings(spark, folder)
    return f.select("facility_id",
                    M.max_charge(F.col("chemicals"), (56,), "mmonia").alias("ammonia_lb"),
                    M.max_charge(F.col("chemicals"), (17,), "Chlorine").alias("chlorine_lb"))


@query("filings_dedup", S.BASE + """
SELECT facility_id, facility_name, city, state, naics, charge_lb, is_deregistered FROM filings""")
def filings_dedup(spark, folder):
    return filings(spark, folder).select("facility_id", "facility_name", "city", "state", "naics", "charge_lb",
                                         "is_deregistered")


@query("filings_in_scope", S.BASE + """
SELECT facility_id, facility_name, city, state, naics, charge_lb, is_deregistered
FROM filings WHERE naics IN ('Brand#1', 'Brand#12', 'Brand#7')""")
def filings_in_scope(spark, folder):
    f = P.in_scope(filings(spark, folder), naics=["Brand#1", "Brand#12", "Brand#7"])
    return f.select("facility_id", "facility_name", "city", "state", "naics", "charge_lb",
                    "is_deregistered")


_QUEUE = S.ROLLED + """,
largest AS (
  SELECT account_key, facility_id, facility_name, city, state, naics, charge_lb,
    row_number() OVER (PARTITION BY account_key ORDER BY charge_lb DESC, merged, ord) AS r_all FROM keyed),
largest_ok AS (
  SELECT account_key, facility_id, facility_name, city, state, naics, charge_lb,
    row_number() OVER (PARTITION BY account_key ORDER BY charge_lb DESC, merged, ord) AS r_ok
  FROM keyed WHERE validated),
rescued AS (
  SELECT account_key, loose, reported,
    row_number() OVER (PARTITION BY account_key ORDER BY merged, ord) AS rn
  FROM keyed WHERE loose IS NOT NULL AND loose_key IS DISTINCT FROM key),
queue AS (
  SELECT 'numeric_outlier' AS kind, facility_id, facility_name AS name, city, state, naics, charge_lb,
    NULL::VARCHAR AS reported_name, account, validation_note AS reason, validation_note,
    'verify the filing, correct the value, or confirm exclusion' AS action, 1::BIGINT AS kind_ord
  FROM (SELECT keyed.*, account FROM keyed JOIN (SELECT account_key, account FROM buckets) USING (account_key))
  WHERE NOT validated
  UNION ALL
  SELECT 'unresolved_name', facility_id, facility_name, city, state, naics, charge_lb, reported, NULL,
    'no usable parent/operator/facility name after normalisation', '',
    'assign to an account or create one', 2
  FROM sites LEFT JOIN spellings USING (reported) WHERE key IS NULL
  UNION ALL
  SELECT 'below_threshold', facility_id, facility_name, city, state, naics, l.charge_lb, account, account,
    'single site at ' || l.charge_lb || ' lb, below the 40000 lb pilot floor', '',
    'confirm whether this is a prospect; approving admits it as a sub-threshold account', 3
  FROM buckets b JOIN largest_ok l USING (account_key)
  WHERE NOT admitted AND b.max_site_charge_lb >= 20000 AND r_ok = 1
  UNION ALL
  SELECT 'merge_rescue', facility_id, facility_name, city, state, naics, l.charge_lb, r.reported, account,
    'would have merged into ' || loose || CASE WHEN loose IN ('Old Widget Holdings', 'hot rod')
      THEN ', an existing CUSTOMER, and been suppressed from outbound' ELSE '' END, '',
    'confirm ' || account || ' is a separate company from ' || loose, 4
  FROM rescued r JOIN buckets b USING (account_key) JOIN largest l USING (account_key)
  WHERE r.rn = 1 AND r_all = 1
  UNION ALL
  SELECT 'operator_is_person', facility_id, facility_name, city, state, naics, charge_lb, operator_name, shown,
    'operator field "' || operator_name || '" looks like an individual, not a company', '',
    'confirm ' || shown || ' is the operating company, or supply the correct one', 5
  FROM keyed0 WHERE operator_is_person)"""


@query("review_queue", _QUEUE + "SELECT * FROM queue")
def review_queue(spark, folder):
    return registry_run(spark, folder).review_queue


@query("queue_ranked_counts", _QUEUE + """
SELECT kind, CASE WHEN kind IN ('merge_rescue', 'unresolved_name') THEN 'blocking'
  WHEN kind = 'operator_is_person' THEN 'info' ELSE 'waiting' END AS severity, count(*) AS n
FROM queue GROUP BY ALL""")
def queue_ranked_counts(spark, folder):
    queue = RQ.with_severity(registry_run(spark, folder).review_queue)
    return queue.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


_KINDS = "', '".join(RQ.KIND_ORDER)


@query("queue_ranked", _QUEUE + f""",
severe AS (SELECT *, CASE WHEN kind IN ('merge_rescue', 'unresolved_name') THEN 1 WHEN kind = 'operator_is_person' THEN 3 ELSE 2 END AS level FROM queue)
SELECT kind, facility_id, account, reported_name, action, CASE level WHEN 1 THEN 'blocking' WHEN 2 THEN 'waiting' ELSE 'info' END AS severity,
  row_number() OVER (ORDER BY level, list_position(['{_KINDS}'], kind), coalesce(facility_id, ''), coalesce(account, ''), coalesce(reported_name, '')) AS rank
FROM severe""")
def queue_ranked(spark, folder):
    """The review queue as the one list that is worked off: by severity, kind and name."""
    queue = RQ.with_severity(registry_run(spark, folder).review_queue)
    rows = queue.select("kind", "kind_ord", "severity", "facility_id", "account", "reported_name", "action").withColumns({
        f"_{c}": F.coalesce(c, F.lit("")) for c in ("facility_id", "account", "reported_name")})
    order = [RQ.by_severity(), F.asc("kind_ord"), F.asc("_facility_id"), F.asc("_account"), F.asc("_reported_name")]
    return O.global_rank(rows, order).select("kind", "facility_id", "account", "reported_name", "action", "severity", "rank")


@query("unresolved_names", S.FLAGGED + """
SELECT facility_id, reported, city, state FROM sites LEFT JOIN spellings USING (reported) WHERE key IS NULL""")
def unresolved_names(spark, folder):
    return registry_run(spark, folder).unresolved_sites.select("facility_id", "reported", "city", "state")


@query("merge_rescues", _QUEUE + """
SELECT account_key, loose AS would_be, reported AS reported_name FROM rescued WHERE rn = 1""")
def merge_rescues(spark, folder):
    return RQ.rescues_by_bucket(registry_run(spark, folder))


@query("site_number_merges", S.ROLLED + "SELECT key, final_key FROM merges")
def site_number_merges(spark, folder):
    return registry_run(spark, folder).merges.select("key", "final_key")


@query("below_queue_floor", S.ROLLED + """
SELECT account_key, account, sites, max_site_charge_lb FROM buckets
WHERE NOT admitted AND max_site_charge_lb < 20000""")
def below_queue_floor(spark, folder):
    return registry_run(spark, folder).below_queue_floor.select(
        "account_key", "account", "sites", "max_site_charge_lb")


@query("prospects", S.ROLLED + """
SELECT account_key, account, sites FROM buckets WHERE admitted AND NOT is_customer""")
def prospects(spark, folder):
    """Customer suppression after resolution: known customers by anti-join."""
    run = registry_run(spark, folder)
    customers = spark.createDataFrame([(c,) for c in run.profile.customers], "account string")
    return run.admitted_buckets.join(customers, "account", "left_anti").select(
        "account_key", "account", "sites")


@query("run_statistics", S.ROLLED + """,
q AS (SELECT (SELECT count(*) FROM filings) AS facilities, (SELECT count(*) FROM named) AS active,
  (SELECT p99 FROM stats) AS p99, (SELECT median FROM stats) AS median,
  (SELECT count(*) FROM keyed WHERE NOT validated) AS flagged,
  (SELECT count(*) FROM buckets WHERE admitted) AS accounts,
  (SELECT count(*) FROM buckets WHERE admitted AND is_customer) AS customers,
  (SELECT sum(sites)::BIGINT FROM buckets WHERE admitted) AS sites,
  (SELECT sum(charge_lb)::BIGINT FROM buckets WHERE admitted) AS charge_lb,
  (SELECT count(*) FROM (SELECT account_key FROM keyed JOIN buckets USING (account_key)
     WHERE admitted GROUP BY account_key HAVING count(DISTINCT reported) > 1)) AS multi_alias)
SELECT * FROM q""")
def run_statistics(spark, folder):
    return P.run_statistics(filings(spark, folder), registry_run(spark, folder))


@query("conservation", S.ROLLED + """
SELECT (SELECT count(*) FROM named) AS active,
  (SELECT count(*) FROM keyed JOIN buckets USING (account_key) WHERE admitted) AS in_accounts,
  (SELECT count(*) FROM keyed JOIN buckets USING (account_key)
     WHERE NOT admitted AND max_site_charge_lb >= 20000) AS below_threshold,
  (SELECT count(*) FROM keyed JOIN buckets USING (account_key)
     WHERE NOT admitted AND max_site_charge_lb < 20000) AS below_queue_floor,
  (SELECT count(*) FROM sites LEFT JOIN spellings USING (reported) WHERE key IS NULL) AS unresolved""")
def conservation(spark, folder):
    """Every active filing is in exactly one place."""
    return P.conservation(registry_run(spark, folder))


@query("name_disjointness", S.ROLLED + """
SELECT count(*) AS shared_names FROM (
  SELECT account FROM buckets WHERE admitted INTERSECT
  SELECT account FROM buckets WHERE NOT admitted AND max_site_charge_lb >= 20000)""")
def name_disjointness(spark, folder):
    run = registry_run(spark, folder)
    queued = run.buckets.filter(~P.admitted(run.profile)
                                & (F.col("max_site_charge_lb") >= run.profile.queue_floor))
    return run.admitted_buckets.select("account").intersect(queued.select("account")).agg(
        F.count(F.lit(1)).alias("shared_names"))


@query("order_mode", """
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, n FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS rn FROM c) WHERE rn = 1""")
def order_mode(spark, folder):
    return O.first_seen_mode(table(spark, folder, "orders"), ["o_custkey"], "o_orderpriority",
                             "o_orderkey")


def _quantile_sql(source: str, value: str) -> str:
    return f"""
WITH pop AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS rn, count(*) OVER () AS n
             FROM {source} WHERE {value} > 0)
SELECT max(n) AS n, """ + ", ".join(
        f"max(v) FILTER (rn = least(n - 1, floor(n * {p}::DOUBLE)::BIGINT)) AS {label}"
        for label, p in (("p01", 0.01), ("median", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM pop"


@query("order_quantile", _quantile_sql("orders", "o_totalprice"))
def order_quantile(spark, folder):
    stats = O.order_statistics(table(spark, folder, "orders"), {"v": F.col("o_totalprice")},
                               {"p01": 0.01, "median": 0.5, "p90": 0.9, "p99": 0.99})
    return stats.select(F.col("v_n").alias("n"), F.col("v_p01").alias("p01"),
                        F.col("v_median").alias("median"), F.col("v_p90").alias("p90"),
                        F.col("v_p99").alias("p99"))


@query("golden_diff", """
WITH a AS (SELECT o_custkey, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY 1),
e AS (SELECT o_custkey, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM orders
      WHERE o_orderstatus <> 'P' GROUP BY 1),
j AS (SELECT coalesce(a.o_custkey, e.o_custkey) AS o_custkey, a.orders AS go, e.orders AS wo,
        a.largest AS gl, e.largest AS wl, a.o_custkey IS NOT NULL AS got_row, e.o_custkey IS NOT NULL AS want_row
      FROM a FULL JOIN e USING (o_custkey))
SELECT o_custkey, 'orders' AS field, go::VARCHAR AS got, wo::VARCHAR AS want FROM j
WHERE got_row AND want_row AND go IS DISTINCT FROM wo
UNION ALL SELECT o_custkey, 'largest', format('{:.2f}', gl), format('{:.2f}', wl) FROM j
WHERE got_row AND want_row AND gl IS DISTINCT FROM wl
UNION ALL SELECT o_custkey, '<row>', CASE WHEN got_row THEN 'present' ELSE 'missing' END,
  CASE WHEN want_row THEN 'present' ELSE 'missing' END FROM j WHERE NOT (got_row AND want_row)""")
def golden_diff(spark, folder):
    """Full-order roll-up against the roll-up without pending orders, cell by cell."""
    def rolled(df: DataFrame) -> DataFrame:
        return df.groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("orders"),
            F.max("o_totalprice").cast("decimal(14,2)").alias("largest"))

    orders = table(spark, folder, "orders")
    return Q.golden_diff(rolled(orders), rolled(orders.filter("o_orderstatus <> 'P'")), ["o_custkey"])


@query("uniqueness_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def uniqueness_violations(spark, folder):
    return Q.uniqueness_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


_STATES = [*M.R.RTO_OF_STATE, "AK", "HI", ""]


@query("grid_of_state", f"""
WITH c AS (SELECT c_custkey, [{", ".join(f"'{s}'" for s in _STATES)}][(c_custkey % {len(_STATES)} + 1)::INTEGER] AS state FROM customer),
g(state, rto) AS (VALUES {", ".join(f"('{s}', '{r}')" for s, r in M.R.RTO_OF_STATE.items())})
SELECT c_custkey, state, coalesce(rto, 'Other') AS rto FROM c LEFT JOIN g USING (state)""")
def grid_of_state(spark, folder):
    """Every customer, given a state in turn, with the grid operator of that state."""
    states = F.array(*map(F.lit, _STATES))
    state = F.get(states, (F.col("c_custkey") % len(_STATES)).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", state.alias("state"), M.rto_of_state(state).alias("rto"))


def _raw_filings(spark, folder):
    """The view's filings in the shape the registry serves them."""
    return filings(spark, folder).select(
        F.lit("7").alias("dataset_version"), F.lit("CC BY-SA 4.0").alias("licence"), F.lit("the registry").alias("attribution"),
        F.col("facility_id").alias("facilityId"), F.col("facility_name").alias("facilityName"), "city", "state",
        F.col("parent_name").alias("parentCompanyName"), F.col("operator_name").alias("operatorName"),
        F.col("is_deregistered").alias("isDeregistered"), F.col("naics").alias("naicsCode"),
        F.col("accidents").alias("allAccidentsCount"),
        F.transform("chemicals", lambda c: F.struct(
            c["id"].alias("chemicalId"), c["name"].alias("chemicalName"), c["quantity"].alias("quantity"))).alias("chemicals"))


@query("landed_filings", S.BASE + """
SELECT facility_id, coalesce(parent_name, '') AS parent_name, facility_name, city, state, naics, greatest(charge_lb, 0) AS charge_lb,
  accidents::INTEGER AS accidents, is_deregistered FROM filings""")
def landed_filings(spark, folder):
    """Filings written one per line, each facility twice, read back and merged to the last filing."""
    from accountloom.sources import snapshots
    from accountloom.streaming.events import work_folder

    raw = _raw_filings(spark, folder)
    path = work_folder(spark, "landed")
    # the view is read once; both filings of a facility stand in one file, whose task merges them
    versions = F.array(*[F.struct(F.lit(n).cast("long").alias("ord"), city.alias("city"))
                         for n, city in enumerate((F.lit("elsewhere"), F.col("city")))])
    raw.select(*[c for c in raw.columns if c != "city"], F.inline(versions)).write.option("compression", "gzip").json(path)
    # only what is returned moves
    read = snapshots.normalise(snapshots.read_landed(spark, path)).select(
        "facility_id", "ord", F.coalesce("parent_name", F.lit("")).alias("parent_name"), "facility_name", "city",
        "state", "naics", "charge_lb", "accidents", "is_deregistered")
    return snapshots.keep_last_filing(read, "facility_id").drop("ord")


@query("snapshot_envelopes", S.BASE + """
SELECT facility_id, '7' AS dataset_version, 'CC BY-SA 4.0' AS licence, 'the registry' AS attribution, facility_name, city, state,
  greatest(charge_lb, 0) AS charge_lb, accidents::INTEGER AS accidents FROM filings""")
def snapshot_envelopes(spark, folder):
    """Filings as snapshot envelopes, one JSON object per file of the export, read back with their provenance."""
    from accountloom.sources import snapshots
    from accountloom.streaming.events import work_folder

    raw = _raw_filings(spark, folder)
    items = raw.select(F.to_json(F.struct(*[c for c in raw.columns if c not in ("dataset_version", "licence", "attribution")])).alias("value"))

    def enveloped(frames):
        yield pd.DataFrame({"value": ['{"meta": {"dataset_version": "7", "licence": "CC BY-SA 4.0", "attribution": "the registry"},'
                                      ' "facilities": [']})
        first = True
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"value": ["" if first and i == 0 else ", " for i in range(len(frame))]}) + frame
                first = False
        yield pd.DataFrame({"value": ["]}"]})

    path = work_folder(spark, "envelopes")
    # a file for each task that has the filings already, so their texts do not move
    items.mapInPandas(enveloped, "value string").write.option("compression", "gzip").text(path)
    provenance = ("dataset_version", "licence", "attribution")
    # only what is returned moves
    read = snapshots.normalise(snapshots.read_snapshot(spark, path), *provenance).select(
        "facility_id", "ord", "facility_name", "city", "state", "charge_lb", "accidents", *provenance)
    return snapshots.keep_last_filing(read, "facility_id").drop("ord")
