"""Queries over users, grants, tenants and the audit trail, on views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom.functions.measures import pseudonym
from accountloom.operators import access as A
from accountloom.operators import identity as I
from accountloom.plans.catalog import query
from accountloom.sources.commit_log import CommitLog
from accountloom.sources.driver_tables import table
from accountloom.streaming.events import work_folder

NOW, EVENTS_NOW = "1999-06-01 00:00:00", "2024-01-20 12:00:00"
OWNERS = 97
GROUP_ROLES = {"sales": ["rep"], "leads": ["rep", "sales_lead"], "mkt": ["marketing"]}


def users(spark, folder):
    """Two tenants with the same user numbers, so that a number alone says nothing."""
    return table(spark, folder, "supplier").select(
        F.floor(F.col("s_suppkey") / 2).alias("user_id"), (F.col("s_suppkey") % 2).alias("tenant_id"),
        (F.col("s_acctbal") > 1000).alias("is_active"))


def accounts(spark, folder):
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("account_id"), (F.col("c_custkey") % 2).alias("tenant_id"),
        F.col("c_name").alias("canonical_name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") % OWNERS).alias("owner_id"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "excluded").otherwise("working").alias("status"))


def role_grants(spark, folder):
    o = table(spark, folder, "orders")
    role = (F.when(F.col("o_orderpriority") == "1-URGENT", "marketing")
            .when(F.col("o_orderpriority") == "2-HIGH", "sales_lead")
            .when(F.col("o_orderpriority") == "5-LOW", "viewer").otherwise("rep"))
    return o.select(
        F.col("o_orderkey").alias("grant_id"), (F.col("o_orderkey") % 2).alias("tenant_id"),
        F.col("o_custkey").alias("user_id"), role.alias("role"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(F.lit(365))).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit("admin-1")).alias("granted_by"))


def sessions(spark, folder):
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("session_id"), (F.col("event_id") % 2).alias("tenant_id"), "user_id",
        F.col("ts").alias("issued_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(8))).alias("expires_at"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"))


def pii_grants(spark, folder):
    """One field of one person to one user, per order line."""
    line = table(spark, folder, "lineitem")
    return line.select(
        (F.col("l_orderkey") % 2).alias("tenant_id"), (F.col("l_suppkey") % 40).alias("user_id"),
        (F.col("l_partkey") % 300).alias("person_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "email").otherwise("phone").alias("field"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.make_dt_interval(F.lit(365))).alias("expires_at"))


PII_GRANTS = """pii AS (SELECT l_orderkey % 2 AS tenant_id, l_suppkey % 40 AS user_id, l_partkey % 300 AS person_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'email' ELSE 'phone' END AS field,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL 365 DAY END AS expires_at FROM lineitem)"""
USERS = "users AS (SELECT s_suppkey // 2 AS user_id, s_suppkey % 2 AS tenant_id, s_acctbal > 1000 AS is_active FROM supplier)"
ACCOUNTS = f"""accounts AS (SELECT c_custkey AS account_id, c_custkey % 2 AS tenant_id, c_name AS canonical_name,
  CASE WHEN c_acctbal >= 0 THEN c_custkey % {OWNERS} END AS owner_id,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'excluded' ELSE 'working' END AS status FROM customer)"""
GRANTS = """grants AS (SELECT o_orderkey AS grant_id, o_orderkey % 2 AS tenant_id, o_custkey AS user_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'marketing' WHEN '2-HIGH' THEN 'sales_lead' WHEN '5-LOW' THEN 'viewer' ELSE 'rep' END AS role,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 365 DAY END AS expires_at,
  CASE WHEN o_orderstatus = 'P' THEN 'admin-1' END AS granted_by FROM orders)"""
SESSIONS = """sessions AS (SELECT event_id AS session_id, event_id % 2 AS tenant_id, user_id, ts AS issued_at, ts + INTERVAL 8 HOUR AS expires_at,
  CASE WHEN event_type = 'error' THEN ts END AS revoked_at FROM events)"""


@query("orphaned_accounts", f"""WITH {USERS}, {ACCOUNTS}
SELECT account_id, canonical_name, CASE WHEN owner_id IS NULL THEN 'unowned' ELSE 'owner_inactive' END AS reason
FROM accounts a LEFT JOIN users u ON u.user_id = a.owner_id AND u.tenant_id = a.tenant_id
WHERE status <> 'excluded' AND (owner_id IS NULL OR NOT is_active)""")
def orphaned_accounts(spark, folder):
    return I.orphaned_accounts(accounts(spark, folder), users(spark, folder)).select(
        "account_id", "canonical_name", "reason")


@query("live_grants", f"""WITH {USERS}, {GRANTS}
SELECT grant_id, tenant_id, user_id FROM grants g WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')
  AND EXISTS (SELECT 1 FROM users u WHERE is_active AND u.user_id = g.user_id AND u.tenant_id = g.tenant_id)""")
def live_grants(spark, folder):
    return I.live_grants(role_grants(spark, folder), users(spark, folder), NOW).select("grant_id", "tenant_id", "user_id")


@query("pii_grant_lookup", f"""WITH {USERS}, {PII_GRANTS},
asked AS (SELECT DISTINCT event_id % 2 AS tenant_id, user_id % 40 AS user_id, event_id % 300 AS person_id,
  CASE WHEN event_type = 'click' THEN 'email' ELSE 'phone' END AS field FROM events)
SELECT tenant_id, user_id, person_id, field, EXISTS (
  SELECT 1 FROM pii g JOIN users u ON u.user_id = g.user_id AND u.tenant_id = g.tenant_id AND u.is_active
  WHERE g.tenant_id = a.tenant_id AND g.user_id = a.user_id AND g.person_id = a.person_id AND g.field = a.field
    AND (g.expires_at IS NULL OR g.expires_at > TIMESTAMP '{NOW}')) AS granted FROM asked a""")
def pii_grant_lookup(spark, folder):
    """A grant covers one tenant, user, person and field."""
    asked = table(spark, folder, "events").select(
        (F.col("event_id") % 2).alias("tenant_id"), (F.col("user_id") % 40).alias("user_id"),
        (F.col("event_id") % 300).alias("person_id"),
        F.when(F.col("event_type") == "click", "email").otherwise("phone").alias("field")).distinct()
    return I.granted_fields(asked, pii_grants(spark, folder), users(spark, folder), NOW)


@query("active_roles", f"""WITH {GRANTS}
SELECT tenant_id, user_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM grants
WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}' GROUP BY tenant_id, user_id""")
def active_roles(spark, folder):
    return I.active_roles(role_grants(spark, folder), NOW).select(
        "tenant_id", "user_id", F.array_join("roles", ",").alias("roles"))


def _memberships(spark, folder):
    c = table(spark, folder, "customer")
    groups = (F.when(F.col("c_mktsegment") == "MACHINERY", "sales, leads").when(F.col("c_mktsegment") == "BUILDING", "mkt,,other")
              .when(F.col("c_mktsegment") == "HOUSEHOLD", " sales "))
    return c.select((F.col("c_custkey") % 2).alias("tenant_id"), F.floor(F.col("c_custkey") / 2).alias("user_id"),
                    groups.alias("groups"))


_DESIRED = """desired AS (SELECT DISTINCT tenant_id, user_id, role FROM (
  SELECT c_custkey % 2 AS tenant_id, c_custkey // 2 AS user_id, unnest(CASE c_mktsegment WHEN 'MACHINERY' THEN ['rep', 'sales_lead'] WHEN 'BUILDING' THEN ['marketing']
    WHEN 'HOUSEHOLD' THEN ['rep'] ELSE []::VARCHAR[] END) AS role FROM customer))"""


@query("group_roles", f"WITH {_DESIRED} SELECT * FROM desired")
def group_roles(spark, folder):
    return I.desired_roles(_memberships(spark, folder), GROUP_ROLES)


@query("role_reconcile", f"""WITH {_DESIRED}, {GRANTS},
synced AS (SELECT DISTINCT tenant_id, user_id, role FROM grants WHERE granted_by IS NULL)
SELECT tenant_id, user_id, role, 'grant' AS action FROM (SELECT * FROM desired EXCEPT SELECT * FROM synced)
UNION ALL SELECT tenant_id, user_id, role, 'revoke' FROM (SELECT * FROM synced EXCEPT SELECT * FROM desired)""")
def role_reconcile(spark, folder):
    return I.reconcile_roles(I.desired_roles(_memberships(spark, folder), GROUP_ROLES), role_grants(spark, folder))


_PERMS = "(VALUES " + ", ".join(
    f"('{p}', '{r}')" for p, rs in A.R.PERMISSIONS.items() for r in rs) + ") m(permission, role)"


@query("effective_permissions", f"WITH {GRANTS} SELECT DISTINCT user_id, permission FROM grants JOIN {_PERMS} USING (role)")
def effective_permissions(spark, folder):
    return A.effective_permissions(role_grants(spark, folder), "user_id", "role")


def _people(spark, folder):
    """Person records: a contact per customer, with owner, consent and confidence."""
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("tenant_id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("555-"), F.col("c_custkey").cast("string"))).alias("phone"),
        F.lit("https://example.com/in").alias("linkedin_url"), F.col("c_acctbal").alias("secret_score"),
        (F.col("c_custkey") % OWNERS).alias("owner_id"), (F.col("c_acctbal") > 0).alias("consent"),
        (F.col("c_nationkey") % 3 + 1).alias("confidence"))


REP = A.Principal(5, ("rep",))


@query("tiered_projection", f"""
SELECT c_custkey AS person_id,
  '{{"person_id":' || c_custkey || ',"name":"' || c_name || '","title":"' || c_mktsegment || '","confidence":' || (c_nationkey % 3 + 1)
  || ',"linkedin_url":"https://example.com/in"' || CASE WHEN c_custkey % {OWNERS} = 5 THEN ',"email":"' || replace(lower(c_name), '#', '.') || '@example.com"'
     || CASE WHEN c_acctbal > 5000 THEN ',"phone":"555-' || c_custkey || '"' ELSE '' END ELSE '' END || '}}' AS payload
FROM customer""")
def tiered_projection(spark, folder):
    """What a rep receives: contact details of owned accounts only, nothing unmapped."""
    owned, others = A.project(_people(spark, folder), "person", REP, ["person_id"], owner=F.col("owner_id") == REP.user_id)
    return A.as_documents(owned, "person_id", owned.columns).unionByName(
        A.as_documents(others, "person_id", others.columns))


@query("pii_read_audit", f"""
WITH p AS (SELECT c_custkey, 'email' AS field FROM customer WHERE c_custkey % {OWNERS} = 5
  UNION ALL SELECT c_custkey, 'phone' FROM customer WHERE c_custkey % {OWNERS} = 5 AND c_acctbal > 5000)
SELECT 5 AS user_id, 'pii.read' AS action, 'person' AS resource_type, c_custkey::VARCHAR AS resource_id, 'allow' AS outcome,
  '2024-01-01T00:00:00Z' AS at, field FROM p""")
def pii_read_audit(spark, folder):
    """Every contact field that a rep was shown, from the trail it was entered in."""
    owned, _ = A.project(_people(spark, folder), "person", REP, ["person_id"], owner=F.col("owner_id") == REP.user_id)
    reads = A.pii_reads(owned, REP, "person", "person_id", "2024-01-01T00:00:00Z")
    path = f"{work_folder(spark, 'audit')}/trail"
    for _ in range(2):  # the second append repeats a batch that is in the trail
        I.append_audit(reads, path, batch="2024-01-01")
    return CommitLog(spark, path, reads.schema).read()


@query("outbound_usable", f"""
WITH r AS (SELECT o_custkey AS person_id, bool_or(o_orderpriority = '1-URGENT') AS mkt,
   bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')) AS reader FROM orders GROUP BY 1)
SELECT c_custkey AS person_id, coalesce(reader AND (mkt OR c_custkey % {OWNERS} < 40), false) AS accessible,
  coalesce(reader AND (mkt OR c_custkey % {OWNERS} < 40), false) AND c_acctbal > 0 AND c_nationkey % 3 = 2 AS outbound
FROM customer LEFT JOIN r ON c_custkey = person_id""")
def outbound_usable(spark, folder):
    roles = role_grants(spark, folder).groupBy(F.col("user_id").alias("person_id")).agg(F.collect_set("role").alias("roles"))
    people = _people(spark, folder).join(roles, "person_id", "left")
    owner = F.col("owner_id") < 40
    return people.select("person_id", A.can_access_pii(F.col("roles"), owner).alias("accessible"),
                         A.usable_for_outbound(F.col("roles"), owner, F.col("consent"), F.col("confidence")).alias("outbound"))


@query("tenant_scope", f"WITH {ACCOUNTS} SELECT account_id, canonical_name, status FROM accounts WHERE tenant_id = 1")
def tenant_scope(spark, folder):
    """One tenant's accounts from a table laid out by tenant; nothing else is read."""
    path = f"{work_folder(spark, 'tenants')}/accounts"
    A.write_by_tenant(accounts(spark, folder), path)
    return A.read_tenant(spark, path, 1).select("account_id", "canonical_name", "status")


@query("draft_visibility", """
SELECT o_orderkey AS deliverable_id, CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'P' THEN 'draft' ELSE 'superseded' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS body FROM orders""")
def draft_visibility(spark, folder):
    status = F.when(F.col("o_orderstatus") == "O", "published").when(F.col("o_orderstatus") == "P", "draft").otherwise("superseded")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("deliverable_id"), status.alias("status"), F.col("o_orderpriority").alias("body"))
    shown, hidden = A.split_drafts(rows, REP)
    return shown.unionByName(hidden, allowMissingColumns=True)


@query("audit_filter", """
SELECT event_id, user_id, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events JOIN customer ON c_custkey = user_id
WHERE c_nationkey = 3 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def audit_filter(spark, folder):
    """The newest entries of one tenant and action; the tenant is the user's nation."""
    tenants = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("tenant_id"))
    log = table(spark, folder, "events").join(tenants, "user_id").withColumn("action", F.col("event_type"))
    return I.audit_trail(log, 3, action="click", at="ts", tie="event_id").select(
        "event_id", "user_id", "action", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("session_pseudonyms", "SELECT event_id, sha256('session-' || event_id) AS token_hash FROM events")
def session_pseudonyms(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", pseudonym(F.concat(F.lit("session-"), F.col("event_id").cast("string"))).alias("token_hash"))


@query("active_counts", f"""WITH {SESSIONS}
SELECT tenant_id, user_id, count(*) FILTER (revoked_at IS NULL AND expires_at > TIMESTAMP '{EVENTS_NOW}') AS active
FROM sessions GROUP BY 1, 2""")
def active_counts(spark, folder):
    return I.active_sessions(sessions(spark, folder), EVENTS_NOW)


@query("retention_sweep", f"""WITH {SESSIONS}
SELECT count(*) FILTER (issued_at < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 DAY) AS removed,
  count(*) FILTER (NOT issued_at < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 DAY) AS kept FROM sessions""")
def retention_sweep(spark, folder):
    kept, removed = I.retention_sweep(sessions(spark, folder), "issued_at", EVENTS_NOW, days=10)
    return removed.select("removed", kept.agg(F.count(F.lit(1)).alias("n")).scalar().alias("kept"))


_LEAVERS = f"""WITH {USERS}, {GRANTS}, {PII_GRANTS}, {SESSIONS},
gone AS (SELECT u.tenant_id, u.user_id,
  (SELECT count(*) FROM grants g WHERE g.user_id = u.user_id AND g.tenant_id = u.tenant_id
     AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')) AS grants_expired,
  (SELECT count(*) FROM pii g WHERE g.user_id = u.user_id AND g.tenant_id = u.tenant_id
     AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')) AS pii_grants_expired,
  (SELECT count(*) FROM sessions s WHERE s.user_id = u.user_id AND s.tenant_id = u.tenant_id AND revoked_at IS NULL) AS sessions_revoked
FROM users u WHERE NOT is_active)"""


def _offboarded(spark, folder):
    everyone = users(spark, folder)
    return I.offboard(everyone.withColumn("is_active", F.lit(True)), role_grants(spark, folder), pii_grants(spark, folder),
                      sessions(spark, folder), everyone.filter("not is_active"), NOW)


@query("offboarding", _LEAVERS + """
SELECT *, 'user.offboard' AS action, '{"grants_expired":' || grants_expired || ',"pii_grants_expired":' || pii_grants_expired
  || ',"sessions_revoked":' || sessions_revoked || '}' AS meta FROM gone""")
def offboarding(spark, folder):
    """Leavers with what was ended for them and the audit row that says so."""
    out = _offboarded(spark, folder)
    return out.counts.join(out.audit.select(*I.USER, "action", "meta"), list(I.USER))


@query("offboarded_users", _LEAVERS + f"""
SELECT tenant_id, user_id, is_active, (SELECT count(*) FROM pii g WHERE g.tenant_id = users.tenant_id AND g.user_id = users.user_id
  AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND users.is_active) AS open_fields FROM users""")
def offboarded_users(spark, folder):
    """Everybody after the leavers left: who is active, and which field grants are still open."""
    out = _offboarded(spark, folder)
    still = out.pii_grants.filter(I.live("expires_at", NOW)).groupBy(*I.USER).agg(F.count(F.lit(1)).alias("open_fields"))
    return out.users.join(still, list(I.USER), "left").fillna(0, ["open_fields"]).select(
        "tenant_id", "user_id", "is_active", "open_fields")


@query("user_upsert", """
WITH e AS (SELECT s_nationkey AS tenant_id, s_suppkey AS subject, s_name AS name0, s_acctbal > 0 AS is_active FROM supplier),
p AS (SELECT c_nationkey AS tenant_id, c_custkey AS subject, c_name, c_acctbal FROM customer)
SELECT tenant_id, subject, CASE WHEN c_name IS NOT NULL THEN lower(c_name) || '@example.com' ELSE lower(name0) || '@example.org' END AS email,
  CASE WHEN c_name IS NULL THEN name0 WHEN c_acctbal > 8000 THEN c_name || ' of Segment' ELSE lower(c_name) END AS display_name,
  CASE WHEN c_name IS NULL THEN 'S' WHEN c_acctbal > 8000 THEN 'CS' END AS initials,
  coalesce(is_active, true) AS is_active, name0 IS NULL AS created,
  CASE WHEN c_name IS NOT NULL THEN '2024-05-01' END AS seen_at
FROM e FULL JOIN p USING (tenant_id, subject)""")
def user_upsert(spark, folder):
    existing = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("tenant_id"), F.col("s_suppkey").alias("subject"),
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"), F.col("s_name").alias("display_name"),
        F.lit("S").alias("initials"), (F.col("s_acctbal") > 0).alias("is_active"))
    profiles = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("subject"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") > 8000, F.concat("c_name", F.lit(" of Segment"))).alias("name"))
    return I.upsert_users(existing, profiles, "2024-05-01")
