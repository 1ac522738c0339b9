"""Queries over research tables, as views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom.operators import identity as I
from accountloom.operators import research as X
from accountloom.operators.ordering import global_rank
from accountloom.operators.search import build_index, search, searchable
from accountloom.plans import queue as RQ
from accountloom.plans.catalog import query
from accountloom.plans.catalog import registry_sql as S
from accountloom.plans.catalog.gates import FACTS_SQL, facts
from accountloom.plans.catalog.governance import ACCOUNTS, USERS, accounts, users
from accountloom.plans.catalog.registry import registry_run
from accountloom.sources.driver_tables import table
from accountloom.streaming.events import work_folder

AS_OF = "2024-01-31"


def signals(spark, folder):
    """One signal per event; only larger values say why they matter."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("account_id"), F.col("event_type").alias("type"),
        F.col("ts").cast("date").alias("occurred_on"), F.concat("event_type", F.lit(" near "), F.get_json_object("props", "$.k")).alias("title"),
        "value", "ts", F.when(F.col("value") >= 20, F.concat(F.lit("moves "), F.col("event_type"))).alias("why_it_matters"))


SIGNALS = """signals AS (SELECT event_id AS signal_id, user_id AS account_id, event_type AS type, ts::DATE AS occurred_on,
  event_type || ' near ' || regexp_extract(props, '"k": (\\d+)', 1) AS title, value, ts,
  CASE WHEN value >= 20 THEN 'moves ' || event_type END AS why_it_matters FROM events)"""
_IMPACT = f"""{SIGNALS},
i0 AS (SELECT *, round(0.5::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - date_diff('day', occurred_on, DATE '{AS_OF}')::DOUBLE / 30))
  + 0.3::DOUBLE * least(1.0::DOUBLE, value / 100::DOUBLE) + 0.2::DOUBLE * CASE WHEN type IN ('purchase', 'signup') THEN 1.0 ELSE 0.25 END::DOUBLE, 6) AS impact_score FROM signals),
impacts AS (SELECT *, CASE WHEN impact_score >= 0.8 THEN 'critical' WHEN impact_score >= 0.6 THEN 'high' WHEN impact_score >= 0.4 THEN 'medium'
  WHEN impact_score >= 0.2 THEN 'low' ELSE 'context' END AS impact FROM i0)"""


def _impacts(spark, folder):
    near = F.when(F.col("type").isin("purchase", "signup"), 1.0).otherwise(0.25)
    return X.impact(signals(spark, folder), "occurred_on", F.least(F.lit(1.0), F.col("value") / 100.0), near,
                    AS_OF, weights=(0.5, 0.3, 0.2), window_days=30)


TITLE_CUT = 0.5


@query("signal_dedup", f"""WITH RECURSIVE {SIGNALS},
worded AS (SELECT account_id, occurred_on::VARCHAR AS occurred_on, type, signal_id,
    list_sort(list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 1))) AS words FROM signals),
same AS (SELECT account_id, occurred_on, type, words, min(signal_id) AS signal_id, count(*) AS reports FROM worded GROUP BY ALL),
links AS (SELECT a.signal_id AS u, b.signal_id AS v FROM same a JOIN same b USING (account_id, occurred_on, type)
    WHERE a.signal_id <> b.signal_id
      AND length(list_intersect(a.words, b.words))::DOUBLE / length(list_distinct(list_concat(a.words, b.words))) >= {TITLE_CUT}::DOUBLE),
reach AS (SELECT signal_id AS node, signal_id AS root FROM same
    UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node WHERE r.root < l.v),
grouped AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
total AS (SELECT root, sum(reports)::BIGINT AS reports, count(*) AS titles FROM grouped JOIN same ON signal_id = node GROUP BY root)
SELECT account_id, occurred_on, type, array_to_string(words, ' ') AS title_words, signal_id, total.reports, titles
FROM total JOIN same ON signal_id = root""")
def signal_dedup(spark, folder):
    rows = signals(spark, folder).withColumn("occurred_on", F.col("occurred_on").cast("string"))
    return X.dedup_signals(rows, ["account_id", "occurred_on", "type"], "title", ["signal_id"], TITLE_CUT)


@query("signal_impact", f"WITH {_IMPACT} SELECT signal_id, impact_score, impact, why_it_matters FROM impacts WHERE why_it_matters IS NOT NULL")
def signal_impact(spark, folder):
    return X.surfaced(_impacts(spark, folder)).select("signal_id", "impact_score", "impact", "why_it_matters")


@query("pain_severity", """
WITH f AS (SELECT l_orderkey - l_orderkey % 4 + l_linenumber % 3 AS l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS pain_id, coalesce(n, 0) AS n_facts,
  least(o_orderkey % 5 + 1, CASE WHEN n IS NULL THEN 2 WHEN n < 2 THEN 4 ELSE 5 END)::INTEGER AS final_severity,
  o_orderstatus = 'P' AS rejected FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def pain_severity(spark, folder):
    o = table(spark, folder, "orders")
    evidence = F.when(F.col("o_orderstatus") == "P", "a general need").otherwise(
        F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    pains = o.select(F.col("o_orderkey").alias("pain_id"), (F.col("o_orderkey") % 5 + 1).alias("severity"), evidence.alias("evidence"))
    links = table(spark, folder, "lineitem").select(
        F.expr("l_orderkey - l_orderkey % 4 + l_linenumber % 3").alias("pain_id"))  # every line cites one pain of its four orders
    return X.pain_severity(pains, links, "pain_id", r"[0-9]{4}-[0-9]{2}-[0-9]{2}").select(
        "pain_id", "n_facts", "final_severity", "rejected")


@query("cross_account_patterns", """
SELECT r_name AS rto, event_type, date_trunc('quarter', ts)::DATE::VARCHAR AS quarter, count(DISTINCT user_id) AS accounts, count(*) AS signals
FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ALL HAVING count(DISTINCT user_id) >= 4""")
def cross_account_patterns(spark, folder):
    place = (table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("rto")))
    events = table(spark, folder, "events").join(place, "user_id")
    return X.shared_patterns(events, ["rto", "event_type"], "ts", "user_id", 4).withColumn("quarter", F.col("quarter").cast("string"))


def people(spark, folder):
    """One decision-maker per customer; the newest order dates the title."""
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("as_of"))
    c = table(spark, folder, "customer").join(last, "c_custkey", "left")
    return c.select(
        F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") >= 300, F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("role_in_deal"), (F.col("c_acctbal") < 500).alias("is_gap"),
        F.when(F.col("c_acctbal") < 200, "not in any public filing").alias("gap_reason"), "as_of",
        (F.col("c_nationkey") % 3 + 1).alias("confidence"))


PEOPLE = """people AS (SELECT c_custkey AS person_id, CASE WHEN c_acctbal >= 300 THEN c_name END AS name, c_mktsegment AS role_in_deal,
  c_acctbal < 500 AS is_gap, CASE WHEN c_acctbal < 200 THEN 'not in any public filing' END AS gap_reason, as_of, c_nationkey % 3 + 1 AS confidence
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS as_of FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("title_decay", f"""WITH {PEOPLE},
p AS (SELECT *, coalesce(date_diff('day', as_of::DATE, DATE '2001-10-01') > 180, true) AS title_stale FROM people)
SELECT person_id, title_stale, CASE WHEN title_stale THEN greatest(confidence - 1, 1) ELSE confidence END::INTEGER AS confidence FROM p""")
def title_decay(spark, folder):
    return X.title_decay(people(spark, folder), "as_of", "2001-10-01").select("person_id", "title_stale", "confidence")


@query("people_in_a_third_state", f"""WITH {PEOPLE}
SELECT person_id FROM people WHERE NOT ((name IS NOT NULL AND NOT is_gap) OR (is_gap AND gap_reason IS NOT NULL))""")
def people_in_a_third_state(spark, folder):
    return X.third_states(people(spark, folder)).select("person_id")


@query("gap_rate", f"WITH {PEOPLE} SELECT role_in_deal, count(*) AS people, round(avg(is_gap::INT), 6) AS gap_rate FROM people GROUP BY 1")
def gap_rate(spark, folder):
    return X.gap_rate(people(spark, folder), "role_in_deal")


@query("person_evidence", """
WITH p AS (SELECT page_id AS person_id, regexp_extract(url, '//(?:m[.]|blog[.])?([a-z]+)[.]', 1) AS name, html, page_id % 3 + 1 AS confidence FROM pages)
SELECT person_id, name, contains(lower(html), lower(name)) AS evidenced,
  CASE WHEN confidence >= 2 AND NOT contains(lower(html), lower(name)) THEN 1 ELSE confidence END AS confidence FROM p""")
def person_evidence(spark, folder):
    pages = table(spark, folder, "pages")
    persons = pages.select(F.col("page_id").alias("person_id"), F.col("page_id").alias("source_id"),
                           F.regexp_extract("url", r"//(?:m[.]|blog[.])?([a-z]+)[.]", 1).alias("name"),
                           (F.col("page_id") % 3 + 1).alias("confidence"))
    return X.person_evidence(persons, pages.select(F.col("page_id").alias("source_id"), F.col("html").alias("raw"))).select(
        "person_id", "name", "evidenced", "confidence")


@query("confidence_profile", f"""WITH {FACTS_SQL}
SELECT account_id, count(*) FILTER (confidence = 3) AS high, count(*) FILTER (confidence = 2) AS medium, count(*) FILTER (confidence = 1) AS gap,
  count(*) FILTER (date_diff('day', as_of::DATE, DATE '{AS_OF}') > 20) AS stale FROM facts GROUP BY 1""")
def confidence_profile(spark, folder):
    return X.confidence_profile(facts(spark, folder), "account_id", "as_of", AS_OF, 20)


@query("correction_effect", f"""WITH {FACTS_SQL},
w AS (SELECT DISTINCT doc_id AS fact_id FROM labels WHERE quality = 0)
SELECT fact_id, CASE WHEN fact_id IN (SELECT fact_id FROM w) THEN 1 ELSE confidence END::INTEGER AS confidence,
  CASE WHEN fact_id IN (SELECT fact_id FROM w) THEN 'marked wrong: re-verify' END AS queued FROM facts""")
def correction_effect(spark, folder):
    marks = table(spark, folder, "labels").select(
        F.col("doc_id").alias("fact_id"), F.when(F.col("quality") == 0, "wrong").otherwise("tone").alias("kind"))
    fixed, queue = X.apply_corrections(facts(spark, folder).select("fact_id", "confidence"), marks, "fact_id")
    return fixed.join(queue.select("fact_id", F.col("reason").alias("queued")), "fact_id", "left")


@query("blocked_deliverables", f"""WITH {FACTS_SQL},
w AS (SELECT account_id, predicate, min(confidence) AS weakest, CASE predicate WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 2 END AS floor
  FROM facts GROUP BY 1, 2)
SELECT account_id, string_agg(predicate || ' at ' || weakest || ', needs ' || floor, '; ' ORDER BY predicate || ' at ' || weakest || ', needs ' || floor) AS blocked_reason
FROM w WHERE weakest < floor GROUP BY 1""")
def blocked_deliverables(spark, folder):
    return X.blocked_deliverables(facts(spark, folder), "account_id", "predicate",
                                  {"purchase": 3, "signup": 2, "view": 2})


@query("publishable_accounts", f"""WITH {ACCOUNTS}, {PEOPLE}
SELECT account_id, account_id NOT IN (SELECT person_id FROM people WHERE is_gap AND role_in_deal = 'BUILDING') AS can_publish FROM accounts""")
def publishable_accounts(spark, folder):
    gaps = people(spark, folder).select(F.col("person_id").alias("account_id"),
                                        (F.col("is_gap") & (F.col("role_in_deal") == "BUILDING")).alias("is_blocking"))
    return X.publishable(accounts(spark, folder), gaps, "account_id").select("account_id", "can_publish")


@query("stale_artefacts", """
SELECT l_orderkey AS deliverable_id, count(*) AS changed_facts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY 1""")
def stale_artefacts(spark, folder):
    """Orders as deliverables, parts as facts; large parts changed."""
    links = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("fact_id"), F.col("l_orderkey").alias("deliverable_id"))
    changed = table(spark, folder, "part").filter("p_size > 40").select(F.col("p_partkey").alias("fact_id"))
    return X.stale_artefacts(changed, links, "fact_id", "deliverable_id")


@query("claim_grounding", """
SELECT event_id AS claim_id, CASE WHEN d.doc_id IS NULL THEN 'missing_source' WHEN d.lang <> CASE WHEN event_type = 'click' THEN 'fr' ELSE 'en' END THEN 'foreign_source'
  ELSE 'kept' END AS outcome FROM events LEFT JOIN documents d ON d.doc_id = user_id * 9""")
def claim_grounding(spark, folder):
    claims = table(spark, folder, "events").select(
        F.col("event_id").alias("claim_id"), (F.col("user_id") * 9).alias("source_id"),
        F.when(F.col("event_type") == "click", "fr").otherwise("en").alias("tenant_id"))
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("tenant_id"))
    return X.ground_claims(claims, sources).select("claim_id", "outcome")


_BARE = "regexp_replace({x}, '^\\+|,', '', 'g')"
_PLAIN = (f"coalesce(regexp_replace(TRY_CAST({_BARE} AS DECIMAL(38, 8))::VARCHAR, '\\.?0+$', ''), {_BARE})")


@query("unverified_numbers", f"""WITH {FACTS_SQL}
SELECT DISTINCT page_id, number FROM (SELECT page_id, {_PLAIN.format(x="stated")} AS number FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?:^|[^0-9A-Za-z_.+-])([+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?)', 1)) AS stated
  FROM pages))
WHERE number NOT IN (SELECT {_PLAIN.format(x="value")} FROM facts WHERE value IS NOT NULL)""")
def unverified_numbers(spark, folder):
    return X.unverified_numbers(table(spark, folder, "pages"), "page_id", "html", facts(spark, folder), "value")


@query("version_current", """
WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w AS version,
  lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, version, concat_ws(',', CASE WHEN version > 1 AND ps <> o_orderstatus THEN 'o_orderstatus' END,
  CASE WHEN version > 1 AND pp <> o_orderpriority THEN 'o_orderpriority' END) AS changed FROM v""")
def version_current(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return X.version_chain(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select(
        "o_custkey", "o_orderkey", "version", "changed")


@query("account_staleness", """
SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-15')::INTEGER AS age_days,
  greatest(0, 90 - date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-15'))::INTEGER AS refresh_in,
  date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-15') > 90 AS is_stale FROM orders GROUP BY 1""")
def account_staleness(spark, folder):
    last = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return X.staleness(last, "at", "2001-08-15").select("o_custkey", "age_days", "refresh_in", "is_stale")


@query("orphan_alerts", f"""WITH {USERS}, {ACCOUNTS}, {_IMPACT},
o AS (SELECT account_id FROM accounts a LEFT JOIN users u ON u.user_id = a.owner_id AND u.tenant_id = a.tenant_id WHERE status <> 'excluded' AND (owner_id IS NULL OR NOT is_active))
SELECT account_id FROM o WHERE account_id IN (SELECT account_id FROM impacts WHERE impact = 'critical')""")
def orphan_alerts(spark, folder):
    orphans = I.orphaned_accounts(accounts(spark, folder), users(spark, folder))
    return X.orphan_alerts(orphans, _impacts(spark, folder), "account_id").select("account_id")


@query("faceted_accounts", S.ROLLED + """
SELECT primary_rto, vertical, (floor(icp_score / 20) + 1)::INTEGER AS band, count(*) AS accounts
FROM accounts WHERE sites >= 10 AND accidents > 0 GROUP BY ALL""")
def faceted_accounts(spark, folder):
    rows = registry_run(spark, folder).accounts
    return X.facets(rows, (F.col("sites") >= 10) & (F.col("accidents") > 0), "icp_score")


def _indexed(spark, folder):
    """Accounts, people, signals and deliverables in one index."""
    path = f"{work_folder(spark, 'search')}/index"
    build_index([
        searchable(table(spark, folder, "part").select("p_name").distinct(), "account", "p_name", F.col("p_name")),
        searchable(table(spark, folder, "customer"), "person", "c_custkey", F.col("c_name")),
        searchable(signals(spark, folder), "signal", "signal_id", F.col("title")),
        searchable(table(spark, folder, "documents"), "deliverable", "doc_id", F.col("text"))], path)
    return path


_EVERYTHING = """WITH everything AS (SELECT DISTINCT 'account' AS kind, p_name AS key, p_name AS text FROM part
  UNION ALL SELECT 'person', c_custkey::VARCHAR, c_name FROM customer
  UNION ALL SELECT 'signal', event_id::VARCHAR, event_type || ' near ' || regexp_extract(props, '"k": (\\d+)', 1) FROM events
  UNION ALL SELECT 'deliverable', doc_id::VARCHAR, text FROM documents)
"""


@query("text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with')")
def text_search(spark, folder):
    """Deliverables that mention both words, through the index."""
    found = search(spark, _indexed(spark, folder), ["the", "With"], ["deliverable"])
    return found.select(F.col("key").cast("long").alias("doc_id"))


@query("search_everything", _EVERYTHING + "SELECT kind, key FROM everything WHERE contains(lower(text), 'er')")
def search_everything(spark, folder):
    """One word in all accounts, people, signals and deliverables."""
    return search(spark, _indexed(spark, folder), ["eR"])


_WHITE = S.ROLLED + f""",
crm AS (SELECT {S.key_of('p_name')} AS account_key FROM part GROUP BY 1 HAVING bool_or(p_size > 49)),
white AS (SELECT account_key, account, round((icp_score / 100::DOUBLE) * CASE WHEN states > 5 THEN 0.9 ELSE 0.6 END::DOUBLE
  * CASE WHEN primary_rto IN ('ASIA', 'EUROPE') THEN 1.0 ELSE 0.7 END::DOUBLE * (1 + sites_with_accidents::DOUBLE / sites), 6) AS whitespace_score, rank
  FROM accounts WHERE account_key NOT IN (SELECT account_key FROM crm))"""


@query("whitespace_ranking", _WHITE + """
SELECT account_key, account, whitespace_score, row_number() OVER (ORDER BY whitespace_score DESC, rank) AS place FROM white""")
def whitespace_ranking(spark, folder):
    """Every account that the sales list does not hold, the most valuable first."""
    from accountloom.functions.names import match_key

    crm = table(spark, folder, "part").groupBy(match_key(F.col("p_name")).alias("account_key")).agg(
        F.bool_or(F.col("p_size") > 49).alias("held")).filter("held")
    rows = X.whitespace(registry_run(spark, folder).accounts, crm, "account_key",
                        F.when(F.col("states") > 5, 0.9).otherwise(0.6),
                        F.when(F.col("primary_rto").isin("ASIA", "EUROPE"), 1.0).otherwise(0.7))
    return global_rank(rows, [F.desc("whitespace_score"), F.asc("rank")], "place").select(
        "account_key", "account", "whitespace_score", "place")


@query("queue_by_severity", """
SELECT event_id, severity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,
  row_number() OVER (ORDER BY CASE severity WHEN 'blocking' THEN 1 WHEN 'waiting' THEN 2 ELSE 3 END, ts, event_id) AS rank
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'blocking' WHEN 'signup' THEN 'waiting' ELSE 'info' END AS severity FROM events)""")
def queue_by_severity(spark, folder):
    """The one ranked list, whole: severity, then age."""
    severity = F.when(F.col("event_type") == "error", "blocking").when(F.col("event_type") == "signup", "waiting").otherwise("info")
    rows = table(spark, folder, "events").select("event_id", severity.alias("severity"), F.col("ts").alias("created_at"))
    return global_rank(rows, [*RQ.ranked(rows), F.asc("event_id")]).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("portfolio_rollup", S.ROLLED + """,
t AS (SELECT account, rto, grouping(account, rto)::INTEGER AS level, count(*) AS sites, coalesce(sum(charge_lb) FILTER (validated), 0)::BIGINT AS charge_lb,
  sum(accidents)::BIGINT AS accidents, count(*) FILTER (NOT validated) AS held_sites, sum(submissions)::BIGINT AS submissions,
  count(*) FILTER (submissions > 0) AS filed, count(*) FILTER (submissions = 0) AS silent,
  count(*) FILTER (accidents > 0 AND submissions >= 2) AS replacement_sites
FROM (SELECT b.account, k.rto, k.charge_lb, k.accidents, k.validated, f.submissions
  FROM keyed k JOIN buckets b USING (account_key) JOIN filings f USING (facility_id) WHERE admitted) GROUP BY ROLLUP (account, rto))
SELECT account, rto, level, sites, charge_lb, accidents, held_sites, submissions, replacement_sites,
  CASE WHEN filed > 0 THEN round(submissions::DOUBLE / filed, 6) END AS cadence,
  nullif(concat_ws('; ', CASE WHEN held_sites > 0 THEN held_sites || ' sites held below validation' END,
    CASE WHEN silent > 0 THEN silent || ' sites without a submission' END), '') AS notes FROM t""")
def portfolio_rollup(spark, folder):
    """Totals, replacement signal and data-quality notes of every account, by grid region."""
    return X.portfolio(registry_run(spark, folder).account_sites)


@query("cost_rollup", """
SELECT l_returnflag AS operation, l_linestatus AS model, round(sum(l_quantity * l_tax::DECIMAL(12, 6))::DOUBLE, 4) AS cost,
  sum(l_quantity)::BIGINT AS units, sum(l_linenumber)::BIGINT AS tokens, count(*) AS calls
FROM (SELECT l_returnflag, l_linestatus, l_quantity::DECIMAL(12, 0) AS l_quantity, l_tax, l_linenumber FROM lineitem) GROUP BY ALL""")
def cost_rollup(spark, folder):
    line = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("operation"), F.col("l_linestatus").alias("model"),
        F.col("l_quantity").cast("decimal(12,0)").alias("units"), F.col("l_tax").cast("decimal(12,6)").alias("unit_cost"),
        F.col("l_linenumber").alias("tokens"))
    return X.cost_rollup(line, ["operation", "model"]).withColumns({
        "cost": F.round(F.col("cost").cast("double"), 4), "units": F.col("units").cast("long")})


@query("connector_health", """
SELECT source, strftime(max(ts) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS last_success,
  count(*) FILTER (event_type <> 'error') AS rows, count(*) FILTER (event_type = 'error') AS failures
FROM (SELECT 'src' || event_id % 20 AS source, ts, event_type FROM events) GROUP BY 1""")
def connector_health(spark, folder):
    """Every event is a pull of one of twenty connectors."""
    pulls = table(spark, folder, "events").select(
        F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("source"), "ts",
        (F.col("event_type") == "error").alias("failed"))
    return X.connector_health(pulls, "source", "ts").withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss"))
