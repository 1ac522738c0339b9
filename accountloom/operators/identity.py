"""Users, grants and ownership as table operators.  The clock is always an argument."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.names import initials, read_groups
from accountloom.sources.commit_log import CommitLog


USER = ("tenant_id", "user_id")  # a user number means something within its tenant only


def moment(at: str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def live(expires: str, as_of: str) -> Column:
    return F.col(expires).isNull() | (F.col(expires) > moment(as_of))


def orphaned_accounts(accounts: DataFrame, users: DataFrame) -> DataFrame:
    """Accounts without an owner, or whose owner was deactivated."""
    owners = users.select("tenant_id", F.col("user_id").alias("owner_id"), "is_active")
    joined = accounts.filter("status <> 'excluded'").join(owners, ["tenant_id", "owner_id"], "left")
    reason = F.when(F.col("owner_id").isNull(), "unowned").when(~F.col("is_active"), "owner_inactive")
    return joined.withColumn("reason", reason).filter("reason is not null").drop("is_active")


def live_grants(grants: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Grants in force: not expired, and held by an active user of the grant's tenant."""
    return grants.filter(live("expires_at", as_of)).join(
        users.filter("is_active").select(*USER), list(USER), "left_semi")


def granted_fields(requests: DataFrame, pii_grants: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Requests for a person's field with whether a live grant covers exactly that.

    A grant holds for one tenant, user, person and field.
    """
    keys = [*USER, "person_id", "field"]
    held = live_grants(pii_grants, users, as_of).select(*keys).distinct().withColumn("_held", F.lit(True))
    return requests.join(held, keys, "left").withColumn(
        "granted", F.coalesce("_held", F.lit(False))).drop("_held")


def active_roles(grants: DataFrame, as_of: str, keys: Sequence[str] = USER) -> DataFrame:
    """Sorted distinct roles in force per user of a tenant; there are five roles."""
    return grants.filter(live("expires_at", as_of)).groupBy(*keys).agg(
        F.array_sort(F.collect_set("role")).alias("roles"))


def desired_roles(memberships: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Group claims to roles; an unmapped group implies nothing."""
    pairs = [(g, r) for g, roles in mapping.items() for r in roles]
    table = memberships.sparkSession.createDataFrame(pairs, "grp string, role string")
    spread = memberships.select(*USER, F.explode(read_groups(F.col("groups"))).alias("grp"))
    return spread.distinct().join(table, "grp").select(*USER, "role").distinct()


def reconcile_roles(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Grant and revoke actions.  Grants made by hand (``granted_by`` set) are not touched."""
    keys = [*USER, "role"]
    synced = current.filter("granted_by is null").select(*keys).distinct()
    return (desired.join(synced, keys, "left_anti").withColumn("action", F.lit("grant"))
            .unionByName(synced.join(desired, keys, "left_anti").withColumn("action", F.lit("revoke"))))


@dataclass(frozen=True)
class Offboarded:
    """All tables after users left; rows and history stay."""

    users: DataFrame
    grants: DataFrame
    pii_grants: DataFrame
    sessions: DataFrame
    audit: DataFrame
    counts: DataFrame


def offboard(users: DataFrame, grants: DataFrame, pii_grants: DataFrame, sessions: DataFrame,
             leavers: DataFrame, at: str) -> Offboarded:
    """Deactivate leavers, expire their role and PII grants, revoke open sessions, write audit rows.

    ``leavers`` hold (tenant, user); a user of the same number elsewhere is untouched.
    """
    keys = list(USER)
    who = leavers.select(*keys).distinct().withColumn("_leaves", F.lit(True))
    now = moment(at)
    gone = F.coalesce("_leaves", F.lit(False))

    def end(table: DataFrame, column: str, open_row: Column, count: str) -> tuple[DataFrame, DataFrame]:
        hit = table.join(who, keys, "left").withColumn("_hit", gone & open_row)
        ended = hit.withColumn(column, F.when(F.col("_hit"), now).otherwise(F.col(column))).drop("_hit", "_leaves")
        return ended, hit.filter("_hit").groupBy(*keys).agg(F.count(F.lit(1)).alias(count))

    roles, n_roles = end(grants, "expires_at", live("expires_at", at), "grants_expired")
    fields, n_fields = end(pii_grants, "expires_at", live("expires_at", at), "pii_grants_expired")
    closed, n_sessions = end(sessions, "revoked_at", F.col("revoked_at").isNull(), "sessions_revoked")
    counts = who.drop("_leaves")
    for part in (n_roles, n_fields, n_sessions):
        counts = counts.join(part, keys, "left")
    counts = counts.fillna(0)
    audit = counts.select(
        *keys, F.lit("user.offboard").alias("action"), F.lit("allow").alias("outcome"), F.lit(at).alias("at"),
        F.to_json(F.struct("grants_expired", "pii_grants_expired", "sessions_revoked")).alias("meta"))
    left = users.join(who, keys, "left").withColumn(
        "is_active", F.col("is_active") & ~gone).drop("_leaves")
    return Offboarded(left, roles, fields, closed, audit, counts)


def upsert_users(existing: DataFrame, profiles: DataFrame, at: str) -> DataFrame:
    """Insert or refresh users by (tenant, subject), never by e-mail.

    A deactivated user stays deactivated.
    """
    keys = ["tenant_id", "subject"]
    shown = F.coalesce("name", F.element_at(F.split("email", "@"), 1))
    fresh = profiles.select(*keys, F.col("email").alias("_email"), shown.alias("_shown"),
                            initials(F.col("name")).alias("_initials"), F.lit(True).alias("_seen"))
    both = existing.withColumn("_had", F.lit(True)).join(fresh, keys, "full_outer")
    seen = F.coalesce("_seen", F.lit(False))
    return both.select(
        *keys, F.when(seen, F.col("_email")).otherwise(F.col("email")).alias("email"),
        F.when(seen, F.col("_shown")).otherwise(F.col("display_name")).alias("display_name"),
        F.when(seen, F.col("_initials")).otherwise(F.col("initials")).alias("initials"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.col("_had").isNull().alias("created"),
        F.when(seen, F.lit(at)).alias("seen_at"))


def active_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Open sessions per user; a user without one counts zero."""
    return sessions.groupBy(*USER).agg(
        F.count_if(F.col("revoked_at").isNull() & (F.col("expires_at") > moment(as_of))).alias("active"))


def retention_sweep(rows: DataFrame, issued: str, as_of: str, days: int = R.SESSION_TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, one-row count of removed rows)``; age counts from first issue."""
    cutoff = moment(as_of) - F.make_dt_interval(F.lit(days))
    old = F.col(issued) < cutoff
    return rows.filter(~old), rows.agg(F.count_if(old).alias("removed"))


def audit_trail(log: DataFrame, tenant, *, user=None, action: str | None = None, limit: int = 100,
                at: str = "at", tie: str | None = None) -> DataFrame:
    """Newest entries of one tenant, narrowed to a user or an action when given."""
    rows = log.filter(F.col("tenant_id") == F.lit(tenant))
    if user is not None:
        rows = rows.filter(F.col("user_id") == F.lit(user))
    if action is not None:
        rows = rows.filter(F.col("action") == F.lit(action))
    return rows.orderBy(F.desc(at), *([F.desc(tie)] if tie else [])).limit(limit)


def append_audit(entries: DataFrame, path: str, batch: str | None = None) -> bool:
    """The trail only grows: this sink appends and knows no other mode.

    Entries appear all at once or not at all, and a ``batch`` that is appended again after
    a failure is not entered twice.
    """
    return CommitLog(entries.sparkSession, path, entries.schema).append(entries, batch=batch)
