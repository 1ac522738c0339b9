"""Queries over the ingestion gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom.operators import gates as G
from accountloom.operators.ordering import latest_per_key
from accountloom.plans.catalog import query
from accountloom.sources.csv_files import read_csv
from accountloom.sources.driver_tables import table
from accountloom.streaming.events import work_folder

AS_OF = "2024-07-10"
PATTERNS = {"email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+",
            "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}",
            "network address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}
RESEARCH, ACTIVITY = ("the", "of the", "and"), ("der", "und", "le", "to")


def dated_documents(spark, folder):
    """Documents with the date of the event of the same number; errors are undated."""
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("dated"))
    return table(spark, folder, "documents").join(events, "doc_id", "left")


def facts(spark, folder):
    """Facts view: one claim per event, its source kind set by the event's value."""
    kind = (F.when(F.col("value") < 5, "regulator").when(F.col("value") < 40, "trade_press")
            .when(F.col("value") < 110, "capture").otherwise("hearsay"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("fact_id"), F.col("user_id").alias("account_id"),
        F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("value"),
        F.col("ts").alias("as_of"), kind.alias("source_kind"), F.col("value").alias("amount")).withColumn(
        "confidence", G.source_confidence(F.col("source_kind")))


FACTS_SQL = """facts AS (
  SELECT event_id AS fact_id, user_id AS account_id, event_type AS predicate, regexp_extract(props, '"k": (\\d+)', 1) AS value,
    ts AS as_of, value AS amount,
    CASE WHEN value < 5 THEN 'regulator' WHEN value < 40 THEN 'trade_press' WHEN value < 110 THEN 'capture' ELSE 'hearsay' END AS source_kind,
    CASE WHEN value < 5 THEN 3 WHEN value < 110 THEN 2 ELSE 1 END::INTEGER AS confidence FROM events)"""


def _count(spaced: str, words) -> str:
    parts = []
    for w in words:
        needle = " " + "  ".join(w.split()) + " "
        parts.append(f"((length({spaced}) - length(replace({spaced}, '{needle}', ''))) // {len(needle)})")
    return " + ".join(parts)


def _classified(source: str, key: str, text: str) -> str:
    return f"""
sp AS (SELECT {key}, ' ' || regexp_replace(lower({text}), '[^a-z0-9]+', '  ', 'g') || ' ' AS sp FROM {source}),
sc AS (SELECT {key}, ({_count('sp', RESEARCH)})::BIGINT AS research_score, ({_count('sp', ACTIVITY)})::BIGINT AS activity_score FROM sp),
classified AS (SELECT *, CASE WHEN research_score + activity_score = 0 THEN 'unclassifiable'
    WHEN abs(research_score - activity_score)::DOUBLE / (research_score + activity_score) <= 0.2::DOUBLE THEN 'mixed'
    WHEN research_score > activity_score THEN 'prior_research' ELSE 'activity_record' END AS document_class,
  CASE WHEN research_score + activity_score = 0 THEN 0.0::DOUBLE
    ELSE round(abs(research_score - activity_score)::DOUBLE / (research_score + activity_score), 6) END AS class_confidence FROM sc)"""


@query("doc_classify", "WITH " + _classified("documents", "doc_id", "text") + "SELECT * FROM classified")
def doc_classify(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return G.classify_documents(docs, "text", RESEARCH, ACTIVITY, 0.2).drop("text")


@query("doc_section_classes", "WITH " + _classified("documents", "doc_id", "text") + """,
parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section
  FROM documents WHERE doc_id IN (SELECT doc_id FROM classified WHERE document_class = 'mixed')),
keyed AS (SELECT doc_id || '/' || section AS k, doc_id, part FROM parts WHERE regexp_matches(part, '\\S'))
SELECT doc_id, c.document_class, count(*) AS sections FROM (WITH """ + _classified("keyed", "k", "part") + """
SELECT k, document_class FROM classified) c JOIN keyed USING (k) GROUP BY ALL""")
def doc_section_classes(spark, folder):
    """Mixed documents again, paragraph by paragraph."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    mixed = G.classify_documents(docs, "text", RESEARCH, ACTIVITY, 0.2).filter("document_class = 'mixed'")
    parts = G.classify_documents(G.sections(mixed, "doc_id", "text"), "text", RESEARCH, ACTIVITY, 0.2)
    return parts.groupBy("doc_id", "document_class").agg(F.count(F.lit(1)).alias("sections"))


@query("doc_currency", """
WITH d AS (SELECT doc_id, CASE WHEN event_type <> 'error' THEN ts END::DATE AS day FROM documents LEFT JOIN events ON event_id = doc_id)
SELECT doc_id, CASE WHEN day IS NULL THEN 'date unknown' WHEN day < DATE '2024-01-15' THEN 'historical' ELSE 'current' END AS currency,
  coalesce(day >= DATE '2024-01-15', false) AS supports_current_claim,
  CASE WHEN day < DATE '2024-01-15' THEN 'as of ' || strftime(day, '%Y-%m-%d') END AS cite FROM d""")
def doc_currency(spark, folder):
    return G.document_currency(dated_documents(spark, folder), "dated", "2025-01-15").select(
        "doc_id", "currency", "supports_current_claim", "cite")


def _held(text: str) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN regexp_matches({text}, '{p}') THEN '{k}' END" for k, p in PATTERNS.items()) + ")"


@query("pii_quarantine", f"""
WITH d AS (SELECT doc_id, text, {_held('text')} AS held FROM documents)
SELECT doc_id, held = '' AS text_kept, CASE WHEN held = '' THEN 0 ELSE 1 END::BIGINT AS entries,
  CASE WHEN held <> '' THEN 'text quarantined: ' || held END AS reason FROM d""")
def pii_quarantine(spark, folder):
    docs = G.quarantine(table(spark, folder, "documents").select("doc_id", "text"), "text", PATTERNS)
    entry = F.element_at("gates", 1)
    return docs.select("doc_id", F.col("text").isNotNull().alias("text_kept"),
                       F.when(entry["status"] == "pass", 0).otherwise(1).cast("long").alias("entries"),
                       entry["reason"].alias("reason"))


@query("document_gates", f"""
WITH d AS (SELECT doc_id, source, text, {_held('text')} AS held FROM documents),
q AS (
  SELECT doc_id, 'G1' AS gate, 'refuse' AS status, 'blocking' AS severity, 'not permitted: ' || source AS reason FROM d
    WHERE regexp_extract(source, '(\\d+)', 1)::INT % 5 = 0
  UNION ALL SELECT doc_id, 'R1', 'refuse', 'blocking', 'no text layer' FROM d WHERE NOT regexp_matches(text, '\\S')
  UNION ALL SELECT doc_id, 'G2', 'warn', 'blocking', 'text quarantined: ' || held FROM d WHERE held <> ''
  UNION ALL SELECT doc_id, 'L1', 'refuse', 'blocking', 'manual capture only: ' || n || ' records pasted'
    FROM (SELECT doc_id, length(list_filter(string_split(text, chr(10)), lambda b: regexp_matches(b, '\\S'))) AS n FROM d) WHERE n > 20)
SELECT * FROM q""")
def document_gates(spark, folder):
    """Licence, text layer, paste size and sensitive fields, as queue rows."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    licences = docs.select("source").distinct().withColumn(
        "permitted", F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5 != 0)
    gated = G.licence(docs, "source", licences)
    gated = G.gate(gated, "R1", refuse=~F.col("text").rlike(r"\S"), severity="blocking", reason="no text layer")
    gated = G.bulk_paste(gated, "text", 20)
    gated = G.quarantine(gated, "text", PATTERNS)
    return G.queue_rows(gated, "doc_id")


@query("generation_pool", f"""
WITH d AS (SELECT doc_id, {_held('text')} AS held, regexp_extract(source, '(\\d+)', 1)::INT % 5 = 0 AS refused FROM documents)
SELECT doc_id, CASE WHEN held <> '' OR refused THEN 'pending_review' ELSE 'accepted' END AS status FROM d""")
def generation_pool(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    gated = G.gate(docs, "G1", refuse=F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5 == 0,
                   reason="not permitted")
    usable, held = G.pending_review(G.quarantine(gated, "text", PATTERNS))
    return usable.unionByName(held).select("doc_id", "status")


@query("provenance_check", """
SELECT page_id, 'G0' AS gate, 'refuse' AS status, 'blocking' AS severity,
  'no provenance: ' || concat_ws(', ', CASE WHEN lang = '' THEN 'lang' END, CASE WHEN author = '' THEN 'author' END) AS reason
FROM (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '(?:m|blog)\\.([a-z]+)', 1) AS author FROM pages)
WHERE lang = '' OR author = ''""")
def provenance_check(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", r"(?:m|blog)\.([a-z]+)", 1).alias("author"))
    return G.queue_rows(G.provenance(pages, ["url", "lang", "author"]), "page_id")


@query("row_rejects", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row_number FROM customer)
SELECT c_custkey, row_number, CASE WHEN c_acctbal < 0 THEN 'balance must not be negative' ELSE 'segment not accepted' END AS reason
FROM n WHERE c_acctbal < 0 OR c_mktsegment = 'FURNITURE'""")
def row_rejects(spark, folder):
    _, rejects = G.reject_rows(
        table(spark, folder, "customer"), [F.col("c_custkey")],
        {"account name missing": F.trim("c_name") != "",
         "balance must not be negative": F.col("c_acctbal") >= 0,
         "segment not accepted": F.col("c_mktsegment") != "FURNITURE"})
    return rejects.select("c_custkey", "row_number", "reason")


@query("record_versions", """
SELECT o_custkey, o_orderkey, version, version = max(version) OVER (PARTITION BY o_custkey) AS is_current
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)""")
def record_versions(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return G.version_records(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "version", "is_current")


@query("conflicts", "WITH " + FACTS_SQL + """,
v AS (SELECT account_id, predicate, value, max(as_of) AS last_at, count(*) AS n FROM facts GROUP BY ALL)
SELECT account_id, predicate, count(*) AS distinct_values, sum(n)::BIGINT AS records,
  arg_min(value, (last_at, value)) AS oldest_value, arg_max(value, (last_at, value)) AS newest_value
FROM v GROUP BY ALL HAVING count(*) > 1""")
def conflicts(spark, folder):
    return G.conflicts(facts(spark, folder), ["account_id", "predicate"], "value", "as_of")


@query("confidence_promotion", "WITH " + FACTS_SQL + """,
facts_by AS (SELECT * REPLACE (account_id % 40 AS account_id, substr(value, 1, 1) AS value),
  'publisher-' || fact_id % 3 AS source_id FROM facts)
SELECT fact_id, source_kind, source_id, CASE WHEN hit THEN 3 ELSE confidence END::INTEGER AS confidence, hit AS corroborated
FROM (SELECT f.*, f.confidence = 2 AND EXISTS (SELECT 1 FROM facts_by s WHERE s.confidence = 3 AND s.account_id = f.account_id
    AND s.predicate = f.predicate AND s.value = f.value AND s.source_id <> f.source_id) AS hit FROM facts_by f)""")
def confidence_promotion(spark, folder):
    """Three publishers, each with strong and weak pages: one of them repeating itself is no second source."""
    rows = facts(spark, folder).withColumns({
        "account_id": F.col("account_id") % 40, "value": F.substr("value", F.lit(1), F.lit(1)),
        "source_id": F.concat(F.lit("publisher-"), (F.col("fact_id") % 3).cast("string"))})
    return G.promote(rows, ["account_id", "predicate", "value"], "source_id").select(
        "fact_id", "source_kind", "source_id", "confidence", "corroborated")


@query("capture_decay", "WITH " + FACTS_SQL + """
SELECT fact_id, date_diff('day', as_of::DATE, DATE '2024-07-10')::INTEGER AS age_days, date_diff('day', as_of::DATE, DATE '2024-07-10') > 180 AS expired,
  CASE WHEN date_diff('day', as_of::DATE, DATE '2024-07-10') > 180 THEN 1 ELSE confidence END::INTEGER AS confidence FROM facts""")
def capture_decay(spark, folder):
    return G.expire(facts(spark, folder), "as_of", 180, AS_OF).select(
        "fact_id", "age_days", "expired", "confidence")


@query("confidence_cap", "WITH " + FACTS_SQL + """
SELECT fact_id, CASE WHEN regexp_matches(value, '^[1-4]') THEN least(confidence, 1) ELSE least(confidence, 2) END::INTEGER AS capped,
  CASE WHEN confidence = 2 THEN CASE WHEN source_kind = 'capture' THEN 'match against a verified feed record'
    ELSE 'confirm against the company leadership page' END END AS next_step FROM facts""")
def confidence_cap(spark, folder):
    url = F.when(~F.col("value").rlike("^[1-4]"), F.col("predicate"))
    return facts(spark, folder).select(
        "fact_id", G.cap_without_url(F.col("confidence"), url).alias("capped"),
        G.resolution_path(F.col("confidence"), F.col("source_kind")).alias("next_step"))


@query("stale_crm_accounts", """
SELECT c_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_activity, coalesce(max(o_orderdate)::DATE <= DATE '2000-07-01', true) AS stale
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def stale_crm_accounts(spark, folder):
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("last_activity"))
    accounts = table(spark, folder, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return G.stale_crm(accounts, "last_activity", "2001-07-01").withColumn(
        "last_activity", F.date_format("last_activity", "yyyy-MM-dd"))


@query("activity_attribution", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'unknown author' ELSE role END AS author, role = 'system' AS unattributed FROM conversations""")
def activity_attribution(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).otherwise(" ").alias("author"))
    return G.attribute(turns, "author")


@query("plays_already_tried", """
WITH f AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT DISTINCT o.o_custkey, o.o_orderpriority, coalesce(n, 0) AS failed_attempts, n IS NOT NULL AS suppress
FROM orders o LEFT JOIN f USING (o_custkey, o_orderpriority) WHERE o.o_orderstatus <> 'F'""")
def plays_already_tried(spark, folder):
    orders = table(spark, folder, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return G.already_tried(orders.filter("o_orderstatus <> 'F'").select(*keys).distinct(),
                           orders.filter("o_orderstatus = 'F'"), keys)


@query("outcome_links", """
SELECT o_orderkey, o_custkey, outcome FROM orders LEFT JOIN (
  SELECT l_orderkey AS o_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'lost' ELSE 'won' END AS outcome
  FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def outcome_links(spark, folder):
    outcomes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.bool_or(F.col("l_returnflag") == "R"), "lost").otherwise("won").alias("outcome"))
    activity = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return G.link_outcomes(activity, outcomes, ["o_orderkey"])


@query("capture_stamp", """
SELECT conv_id, turn, 'user-17' AS captured_by, '2024-03-01 09:30:00' AS captured_at, '2024-08-28' AS expires_at FROM conversations""")
def capture_stamp(spark, folder):
    """A ``captured_by`` column in the input has no effect."""
    forged = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("role").alias("captured_by"))
    out = G.stamp_capture(forged, "user-17", "2024-03-01 09:30:00")
    return out.withColumns({"captured_at": F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"),
                            "expires_at": F.date_format("expires_at", "yyyy-MM-dd")})


@query("field_extraction", """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_matches(html, '<title>([^<]*)</title>') AS has_title,
  nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
  CASE WHEN regexp_matches(html, '<html lang="([a-z]+)"') THEN 'inferred/interpreted' END AS lang_mark FROM pages""")
def field_extraction(spark, folder):
    fields = G.extract_fields(F.col("html"), {
        "title": (r"<title>([^<]*)</title>", "clean", "observed"),
        "lang": (r'<html lang="([a-z]+)"', "inferred", "interpreted")})
    pages = table(spark, folder, "pages").select("page_id", fields.alias("f"))
    title, lang = F.try_element_at("f", F.lit("title")), F.try_element_at("f", F.lit("lang"))
    return pages.select(
        "page_id", F.coalesce(title["value"], F.lit("")).alias("title"), title.isNotNull().alias("has_title"),
        lang["value"].alias("lang"), F.concat(lang["quality"], F.lit("/"), lang["origin"]).alias("lang_mark"))


@query("feed_specification", """
WITH c AS (SELECT count(*) AS n, count(c_name) AS nm, count(c_mktsegment) AS seg, count(c_acctbal) AS bal FROM customer)
SELECT 'company' AS field, 'required' AS class, 'c_name' AS "column", nm AS filled, n AS rows, 'ok' AS verdict FROM c
UNION ALL SELECT 'verification_date', 'critical', NULL, 0, n, 'blocked' FROM c
UNION ALL SELECT 'industry', 'request', 'c_mktsegment', seg, n, 'ok' FROM c
UNION ALL SELECT 'intent_topics', 'request', NULL, 0, n, 'prompt' FROM c
UNION ALL SELECT 'personal_balance', 'refused', 'c_acctbal', bal, n, 'refused' FROM c""")
def feed_specification(spark, folder):
    return G.feed_specification(table(spark, folder, "customer"), {
        "company": ("required", ("Company Name", "C Name")),
        "verification_date": ("critical", ("Verified At",)),
        "industry": ("request", ("c_mktsegment",)),
        "intent_topics": ("request", ()),
        "personal_balance": ("refused", ("C_AcctBal",))})


@query("sample_audit", """
WITH n AS (SELECT source, quality::DOUBLE AS quality, count(*) OVER (PARTITION BY source) AS population,
  row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS nth FROM documents JOIN labels USING (doc_id)),
a AS (SELECT source, count(*) AS audited, max(population) AS population, avg(quality) AS acc FROM n
  WHERE nth <= ceil(0.25::DOUBLE * population) GROUP BY source)
SELECT source, audited, population, round(acc, 6) AS accuracy,
  round(1.96::DOUBLE * sqrt(acc * (1 - acc) / audited * ((population - audited)::DOUBLE / greatest(population - 1, 1))), 6) AS margin FROM a""")
def sample_audit(spark, folder):
    """A quarter of every source's labelled documents, exactly."""
    labelled = table(spark, folder, "documents").select("doc_id", "source").join(
        table(spark, folder, "labels"), "doc_id")
    return G.sample_audit(labelled, "doc_id", "source", F.col("quality"), 0.25)


@query("text_delimiters", """
WITH l AS (SELECT doc_id, regexp_extract(text, '(?:^|\\n)([^\\n]*\\S[^\\n]*)', 1) AS line FROM documents),
c AS (SELECT doc_id, length(line) - length(replace(line, ',', '')) AS a, length(line) - length(replace(line, ';', '')) AS b,
  length(line) - length(replace(line, chr(9), '')) AS t, length(line) - length(replace(line, '|', '')) AS p FROM l)
SELECT doc_id, CASE WHEN greatest(a, b, t, p) = 0 OR a = greatest(a, b, t, p) THEN ',' WHEN b = greatest(a, b, t, p) THEN ';'
  WHEN t = greatest(a, b, t, p) THEN chr(9) ELSE '|' END AS delimiter FROM c""")
def text_delimiters(spark, folder):
    return table(spark, folder, "documents").select("doc_id", G.delimiter(F.col("text")).alias("delimiter"))


@query("enum_violations", """
SELECT o_orderkey, 'o_orderpriority' AS field, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def enum_violations(spark, folder):
    from accountloom.operators.quality import disallowed_values

    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return disallowed_values(orders, {"o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM"),
                                      "o_orderstatus": ("O", "F")}).select("o_orderkey", "field", "value")


@query("latest_per_key", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_rows(spark, folder):
    """Last write wins per key."""
    return latest_per_key(table(spark, folder, "events"), ["user_id"],
                          [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("csv_export", "SELECT doc_id::VARCHAR AS doc_id, lang, coalesce(text, '') AS text FROM documents")
def csv_export(spark, folder):
    """Documents as a quoted CSV export, their line breaks and quotes included, read back by as many tasks as it has stretches."""
    path = f"{work_folder(spark, 'csv-export')}/rows"
    (table(spark, folder, "documents").select("doc_id", "lang", "text").write
     .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    return read_csv(spark, path, sep=",")
