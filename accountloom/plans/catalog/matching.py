"""Queries over name matching and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions import names as N
from accountloom.functions import similarity as SM
from accountloom.operators import matching as M
from accountloom.operators.ordering import latest_per_key
from accountloom.plans.catalog import query
from accountloom.plans.catalog import registry_sql as S
from accountloom.plans.catalog.registry import registry_run
from accountloom.sources.driver_tables import filings, table

def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def toks(x):
    return f"list_distinct(list_filter(string_split({S.norm_of(x)}, ' '), lambda t: length(t) > 1))"


def sets(name: str, source: str) -> str:
    return f"""(SELECT {name} AS nm, t, d, list_filter(d, lambda t: length(t) >= 5 AND NOT list_contains({_list(R.WEAK_TOKENS)}, t)) AS s
      FROM (SELECT *, list_filter(t, lambda t: length(t) > 2 AND NOT list_contains({_list(R.GENERIC_TOKENS)}, t)) AS d
            FROM (SELECT {name}, {toks(name)} AS t FROM (SELECT DISTINCT {name} FROM {source}))))"""


_SIM = ("(CASE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END >= 0.84::DOUBLE)")
_NEAR = _SIM.format(x="x", y="y")

_PAIR = f"""
m0 AS (SELECT *, length(list_intersect(ad, bd)) AS exact,
    length(list_filter(ad, lambda x: NOT list_contains(bd, x) AND length(x) >= 5
      AND length(list_filter(bd, lambda y: length(y) >= 5 AND {_NEAR})) > 0)) AS typo,
    length(list_filter(a_s, lambda x: length(list_filter(b_s, lambda y: {_NEAR})) > 0)) AS strong0,
    least(length(ad), length(bd)) AS shorter FROM pairs),
m1 AS (SELECT *, CASE WHEN shorter = 0 THEN 0.0::DOUBLE ELSE (exact + typo * 0.85::DOUBLE) / shorter END AS ratio,
    CASE WHEN shorter = 0 THEN 0 ELSE strong0 END AS strong_shared,
    CASE WHEN shorter = 0 THEN 0 ELSE exact + typo END AS shared FROM m0)"""

_CAND = S.ROLLED + f""",
inputs AS {sets('reported', 'spellings')},
cands AS {sets('account', 'buckets')}"""

_BEST = """,
pairs AS (SELECT a.nm AS a, b.nm AS b, a.d AS ad, b.d AS bd, a.s AS a_s, b.s AS b_s FROM inputs a, cands b
          WHERE length(a.d) > 0 AND length(b.d) > 0),""" + _PAIR + """,
good AS (SELECT a, b, least(0.99::DOUBLE, 0.62::DOUBLE + ratio * 0.37::DOUBLE) AS score, ratio, strong_shared
  FROM m1 WHERE strong_shared > 0 AND ratio >= 0.5),
placed AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM good)"""


@query("fuzzy_match", _CAND + _BEST + """
SELECT i.nm AS reported, f.b AS best, round(f.score, 6) AS best_score, s.b AS runner_up, round(s.score, 6) AS runner_up_score,
  CASE WHEN f.b IS NULL THEN 'none' WHEN f.score - s.score <= 0.12::DOUBLE + 1e-9 THEN 'ambiguous' ELSE 'accepted' END AS status
FROM (SELECT DISTINCT nm FROM inputs) i LEFT JOIN (SELECT * FROM placed WHERE place = 1) f ON f.a = i.nm
  LEFT JOIN (SELECT * FROM placed WHERE place = 2) s ON s.a = i.nm""")
def fuzzy_match(spark, folder):
    """Every reported spelling against every account name."""
    run = registry_run(spark, folder)
    out = M.resolve_fuzzy(run.spellings.select("reported"), "reported",
                          run.buckets.select("account"), "account")
    return out.withColumns({"best_score": F.round("best_score", 6),
                            "runner_up_score": F.round("runner_up_score", 6)})


@query("entity_resolution", S.ROLLED + f""",
crm AS (SELECT DISTINCT p_name || ' ' || p_type AS nm0 FROM part UNION SELECT DISTINCT p_name || ' Co.' FROM part),
known AS (SELECT {S.key_of('account')} AS k, min(account) AS exact FROM buckets GROUP BY 1),
keyed_crm AS (SELECT nm0, exact FROM crm LEFT JOIN known ON k = {S.key_of('nm0')}),
open_names AS (SELECT nm0 FROM keyed_crm WHERE exact IS NULL),
inputs AS {sets('nm0', 'open_names')}, cands AS {sets('account', 'buckets')}""" + _BEST + """,
f AS (SELECT i.nm0, f.b AS best, s.b AS runner_up, f.score - s.score <= 0.12::DOUBLE + 1e-9 AS close
  FROM open_names i LEFT JOIN (SELECT * FROM placed WHERE place = 1) f ON f.a = i.nm0 LEFT JOIN (SELECT * FROM placed WHERE place = 2) s ON s.a = i.nm0)
SELECT nm0 AS name, 'exact' AS pass, exact AS account, NULL::VARCHAR AS candidates FROM keyed_crm WHERE exact IS NOT NULL
UNION ALL SELECT nm0, CASE WHEN best IS NOT NULL AND NOT coalesce(close, false) THEN 'fuzzy' ELSE 'queue' END,
  CASE WHEN best IS NOT NULL AND NOT coalesce(close, false) THEN best END,
  CASE WHEN best IS NOT NULL AND coalesce(close, false) THEN concat_ws(' | ', best, runner_up) END FROM f""")
def entity_resolution(spark, folder):
    """A sales list of part names and types against the account names, in three passes."""
    part = table(spark, folder, "part")
    crm = part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).unionByName(
        part.select(F.concat("p_name", F.lit(" Co.")).alias("name")))
    return M.resolve_three_pass(crm, "name", registry_run(spark, folder).buckets, "account")


@query("alias_closest", S.ROLLED + f""",
inputs AS {sets('account', 'buckets')}, cands AS (SELECT * FROM inputs)""" + _BEST.replace(
    "AND length(b.d) > 0", "AND length(b.d) > 0 AND a.nm <> b.nm") + """
SELECT a AS account, b AS closest, round(score, 6) AS score FROM placed WHERE place = 1""")
def alias_closest(spark, folder):
    """The closest other account that would pass for a merge, of every account that has one."""
    names = registry_run(spark, folder).buckets.select("account")
    top = M.best_matches(names, "account", names, "account", keep=1, skip_same=True)
    return top.select(F.col("input").alias("account"), F.col("candidate").alias("closest"),
                      F.round("score", 6).alias("score"))


ALIAS_CUT = 0.4


@query("alias_similarity", S.ROLLED + f""",
worded AS (SELECT nm, d, s FROM {sets('account', 'buckets')} WHERE length(d) > 0),
linked AS (SELECT a.nm AS a, b.nm AS b FROM worded a JOIN worded b ON a.nm < b.nm
  WHERE length(list_intersect(a.d, b.d))::DOUBLE / length(list_distinct(list_concat(a.d, b.d))) >= {ALIAS_CUT}::DOUBLE),
pairs AS (SELECT l.a, l.b, x.d AS ad, y.d AS bd, x.s AS a_s, y.s AS b_s FROM linked l JOIN worded x ON x.nm = l.a JOIN worded y ON y.nm = l.b),"""
+ _PAIR + """
SELECT a AS account, b AS other, round(length(list_intersect(ad, bd))::DOUBLE / length(list_distinct(list_concat(ad, bd))), 6) AS similarity,
  round(CASE WHEN strong_shared > 0 THEN least(0.99::DOUBLE, 0.62::DOUBLE + ratio * 0.37::DOUBLE) ELSE ratio * 0.5::DOUBLE END, 6) AS score,
  strong_shared > 0 AND ratio >= 0.5 AS acceptable FROM m1""")
def alias_similarity(spark, folder):
    """Likely false splits: every pair of accounts above a cut below that of a merge."""
    out = M.similar_names(registry_run(spark, folder).buckets.select("account"), "account", ALIAS_CUT, every_pair=True)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "score")})


@query("name_tokens", S.RESOLVED + f"""
SELECT nm AS reported, {S.norm_of('nm')} AS norm, array_to_string(list_sort(t), ' ') AS tokens,
  array_to_string(list_sort(d), ' ') AS distinctive, array_to_string(list_sort(s), ' ') AS strong,
  {S.norm_of('nm')} <> '' AND {S.norm_of('nm')} NOT IN {S.JUNK} AS usable
FROM {sets('reported', 'spellings')}""")
def name_tokens(spark, folder):
    run = registry_run(spark, folder)
    t = N.tokens(F.col("reported"))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    return run.spellings.select(
        "reported", N.norm_name(F.col("reported")).alias("norm"), text(t).alias("tokens"),
        text(SM.distinctive(t)).alias("distinctive"), text(SM.strong(t)).alias("strong"),
        N.is_usable(F.col("reported")).alias("usable"))


@query("pair_scores", S.BASE + f""",
p AS (SELECT DISTINCT facility_name, reported FROM named),
fs AS {sets('facility_name', 'p')}, rs AS {sets('reported', 'p')},
pairs AS (SELECT facility_name, reported, f.d AS ad, r.d AS bd, f.s AS a_s, r.s AS b_s, f.t AS ta, r.t AS tb,
   {S.norm_of('facility_name')} AS na, {S.norm_of('reported')} AS nb
  FROM p JOIN fs f ON f.nm = facility_name JOIN rs r ON r.nm = reported),""" + _PAIR + """,
l AS (SELECT *, CASE WHEN length(ta) = 0 OR length(tb) = 0 THEN 0.0::DOUBLE ELSE length(list_intersect(ta, tb))::DOUBLE
    / length(list_distinct(list_concat(ta, tb))) END AS jaccard,
  CASE WHEN na = '' OR nb = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(na, nb)::DOUBLE / greatest(length(na), length(nb)) END AS whole_name
  FROM m1),
s AS (SELECT *, greatest(jaccard, whole_name) AS loose FROM l),
t AS (SELECT *, CASE WHEN strong_shared > 0 THEN least(0.99::DOUBLE, 0.62::DOUBLE + ratio * 0.37::DOUBLE)
  WHEN shared > 0 THEN ratio * 0.5::DOUBLE ELSE loose * 0.4::DOUBLE END AS score FROM s)
SELECT facility_name, reported, round(ratio, 6) AS ratio, strong_shared::INTEGER AS strong_shared, shared::INTEGER AS shared,
  round(jaccard, 6) AS jaccard, round(whole_name, 6) AS whole_name, round(loose, 6) AS loose, round(score, 6) AS score,
  strong_shared > 0 AND ratio >= 0.5 AND score >= 0.62::DOUBLE AS acceptable FROM t""")
def pair_scores(spark, folder):
    pairs = registry_run(spark, folder).sites.select("facility_name", "reported").distinct()
    out = M.score_pairs(pairs, "facility_name", "reported")
    return out.select("facility_name", "reported", "strong_shared", "shared", "acceptable", *[
        F.round(c, 6).alias(c) for c in ("ratio", "jaccard", "whole_name", "loose", "score")])


@query("customer_suppression", S.ROLLED + f""",
c AS (SELECT DISTINCT p_name || ' Holdings' AS cust FROM part WHERE p_size = 1),
cs AS {sets('cust', 'c')}, sp AS {sets('reported', 'spellings')},
pairs AS (SELECT sp.nm AS a, cs.nm AS b, sp.d AS ad, cs.d AS bd, sp.s AS a_s, cs.s AS b_s, sp.t AS ta, cs.t AS tb,
  {S.key_of('sp.nm')} = {S.key_of('cs.nm')} AS same, {S.norm_of('sp.nm')} AS na, {S.norm_of('cs.nm')} AS nb FROM sp, cs),""" + _PAIR + """,
g AS (SELECT a, bool_or(same) AS exact, bool_or(strong_shared > 0 AND ratio >= 0.5) AS dist,
  max(greatest(CASE WHEN length(ta) = 0 OR length(tb) = 0 THEN 0.0::DOUBLE ELSE length(list_intersect(ta, tb))::DOUBLE
    / length(list_distinct(list_concat(ta, tb))) END,
  CASE WHEN na = '' OR nb = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(na, nb)::DOUBLE / greatest(length(na), length(nb)) END)) AS loose
  FROM m1 GROUP BY a)
SELECT a AS reported, CASE WHEN exact THEN 'suppressed_exact' WHEN dist THEN 'suppressed_distinctive'
  WHEN loose >= 0.6::DOUBLE THEN 'queued_fuzzy' ELSE 'kept' END AS decision FROM g""")
def customer_suppression(spark, folder):
    names = registry_run(spark, folder).spellings.select("reported")
    customers = table(spark, folder, "part").filter("p_size = 1").select(F.concat("p_name", F.lit(" Holdings")).alias("customer"))
    return M.suppress_customers(names, "reported", customers, "customer", fuzzy_cut=0.6)


@query("reconcile", S.BASE + f""",
crm AS (SELECT p_name || CASE WHEN p_brand = 'Brand#3' OR p_size <= 2 THEN ' Trading' ELSE ' Company' END AS nm FROM part),
a AS (SELECT {S.key_of('nm')} AS key, min(nm) AS crm_name, count(*) AS crm_rows FROM crm GROUP BY 1),
b AS (SELECT {S.key_of('reported')} AS key, min(reported) AS registry_name, count(*) AS registry_rows
      FROM named WHERE reported IS NOT NULL GROUP BY 1)
SELECT key, crm_name, crm_rows, registry_name, registry_rows,
  CASE WHEN registry_name IS NULL THEN 'crm_only' WHEN crm_name IS NULL THEN 'registry_only' ELSE 'matched' END AS status
FROM a FULL JOIN b USING (key)""")
def reconcile(spark, folder):
    """Part names as the sales list, some under a name the registry lacks; reported names as the registry."""
    ending = F.when((F.col("p_brand") == "Brand#3") | (F.col("p_size") <= 2), " Trading").otherwise(" Company")
    crm = table(spark, folder, "part").select(F.concat("p_name", ending).alias("name"))
    sites = registry_run(spark, folder).sites.filter("reported is not null")
    return M.reconcile(crm, "name", sites, "reported")


@query("person_reconcile", """
WITH l AS (SELECT user_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE value >= 10) WHERE rn = 1),
r AS (SELECT user_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE value < 30) WHERE rn = 1)
SELECT user_id, event_type, l.props AS left_value, r.props AS right_value,
  CASE WHEN l.props IS NULL THEN 'right_only' WHEN r.props IS NULL THEN 'left_only'
    WHEN lower(trim(l.props)) = lower(trim(r.props)) THEN 'corroborated' ELSE 'conflict' END AS outcome
FROM l FULL JOIN r USING (user_id, event_type)""")
def person_reconcile(spark, folder):
    """Two overlapping feeds (by event value) of one person field, latest value each."""
    events = table(spark, folder, "events")
    newest = [F.desc("ts"), F.desc("event_id")]
    feeds = [latest_per_key(events.filter(side), ["user_id", "event_type"], newest)
             for side in ("value >= 10", "value < 30")]
    return M.reconcile_people(*feeds, ["user_id", "event_type"], "props")
