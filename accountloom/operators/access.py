"""Who may see which rows and columns: permissions, field tiers, tenants.

Everything fails closed: a missing role, tenant or field mapping yields nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom import refdata as R

_RANK = {"T0": 0, "T1": 1, "T2": 2, "T3": 3, "T4": 4}


@dataclass(frozen=True)
class Principal:
    user_id: object
    roles: tuple[str, ...] = ()
    is_active: bool = True


def can(roles: Sequence[str], permission: str) -> bool:
    """One granted role is enough; an unknown permission is never granted."""
    return bool(set(roles) & set(R.PERMISSIONS.get(permission, ())))


def permissions_for(roles: Sequence[str]) -> list[str]:
    return [p for p in R.PERMISSIONS if can(roles, p)]


def matrix(spark) -> DataFrame:
    """The permission matrix as a table ``(permission, role)``."""
    rows = [(p, r) for p, allowed in R.PERMISSIONS.items() for r in allowed]
    return spark.createDataFrame(rows, "permission string, role string")


def effective_permissions(grants: DataFrame, user: str, role: str) -> DataFrame:
    """Distinct ``(user, permission)`` of a role-grant table.

    Grants shrink to distinct (user, role) first; the matrix is a constant of
    fewer than a hundred rows.
    """
    held = grants.select(user, F.col(role).alias("role")).distinct()
    return held.join(F.broadcast(matrix(grants.sparkSession)), "role").select(user, "permission").distinct()


def has_role(roles: Column, *wanted: str) -> Column:
    return F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, wanted))), F.lit(False))


def can_access_pii(roles: Column, is_owner: Column) -> Column:
    """Everywhere for admin and marketing, own accounts for sales_lead and rep."""
    reader = has_role(roles, *R.PERMISSIONS["pii.read"])
    everywhere = has_role(roles, "admin", "marketing")
    return reader & (everywhere | F.coalesce(is_owner, F.lit(False)))


def usable_for_outbound(roles: Column, is_owner: Column, consent: Column, confidence: Column) -> Column:
    """Readable, lawful and confirmed at the highest confidence."""
    return (can_access_pii(roles, is_owner) & F.coalesce(consent, F.lit(False))
            & (F.coalesce(confidence, F.lit(1)) >= 3))


def ceiling(principal: Principal | None) -> int:
    """Highest tier a caller may reach: -1 nothing, 0 public, 2 analysis, 3 contact, 4 everything."""
    if principal is None or not principal.is_active:
        return -1
    ladder = (("customer_list.manage", 4), ("research.read", 3), ("pii.read", 3),
              ("library.read_analysis", 2), ("library.read", 0))
    return next((tier for permission, tier in ladder if can(principal.roles, permission)), -1)


def visible_fields(entity: str, principal: Principal | None, *, owner: bool = False,
                   for_export: bool = False) -> list[str]:
    """Fields of an entity a caller receives; an unmapped field is never among them."""
    top = ceiling(principal)
    fields = []
    for field, tier in R.FIELD_TIERS[entity].items():
        if _RANK[tier] > top or (tier == "T4" and for_export):
            continue
        if tier == "T3" and not (set(principal.roles) & {"admin", "marketing"} or owner):
            continue
        fields.append(field)
    return fields


def project(df: DataFrame, entity: str, principal: Principal | None, keep: Sequence[str], *,
            owner: Column | None = None, for_export: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(owned rows, other rows)`` with only the columns the caller may see.

    Withheld columns are absent, not null.  A table has one set of columns, so
    rows the caller owns and rows it does not own come back separately.
    """
    if principal is None or ceiling(principal) < 0:
        nothing = df.select(*keep).limit(0)
        return nothing, nothing
    owns = F.coalesce(owner, F.lit(False)) if owner is not None else F.lit(False)

    def part(rows: DataFrame, is_owner: bool) -> DataFrame:
        allowed = visible_fields(entity, principal, owner=is_owner, for_export=for_export)
        return rows.select(*keep, *[f for f in allowed if f in rows.columns and f not in keep])

    return part(df.filter(owns), True), part(df.filter(~owns), False)


def split_drafts(df: DataFrame, principal: Principal, body: Sequence[str] = ("body", "rendered"),
                 status: str = "status") -> tuple[DataFrame, DataFrame]:
    """``(rows with body, rows without)``: drafts show their body to reviewers only."""
    draft = F.coalesce(F.col(status).isin(*R.DRAFT_STATUSES), F.lit(False))
    if can(principal.roles, "review.approve"):
        draft = F.lit(False)
    return df.filter(~draft), df.filter(draft).drop(*body)


def as_documents(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One JSON object per row; null contact details are left out."""
    return df.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("payload"))


def pii_reads(df: DataFrame, principal: Principal, entity: str, key: str, at: str) -> DataFrame:
    """Audit rows: one per contact field that was actually emitted."""
    watched = [f for f, t in R.FIELD_TIERS[entity].items() if t == "T3" and f in df.columns]
    read = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in watched]),
                    lambda f: f.isNotNull()) if watched else F.array().cast("array<string>")
    return df.select(
        F.lit(principal.user_id).alias("user_id"), F.lit("pii.read").alias("action"),
        F.lit(entity).alias("resource_type"), F.col(key).cast("string").alias("resource_id"),
        F.lit("allow").alias("outcome"), F.lit(at).alias("at"), F.explode(read).alias("field"))


def tenant_scope(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; no tenant, no rows.  Prunes partitions on the tenant column."""
    return df.filter(F.lit(False)) if tenant is None else df.filter(F.col(column) == F.lit(tenant))


def foreign_rows(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    """Rows a tenant may not write."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(tenant)))


def write_by_tenant(df: DataFrame, path: str, column: str = "tenant_id") -> None:
    """Lay a table out by tenant, so that a tenant's reads list and open its own files only.

    Rows are dealt by ranges of tenant and number, so a tenant with most rows is written by
    many tasks and small tenants share one.
    """
    (df.withColumn("_number", F.monotonically_increasing_id()).repartitionByRange(column, "_number").drop("_number")
     .write.partitionBy(column).parquet(path))


def read_tenant(spark: SparkSession, path: str, tenant, column: str = "tenant_id") -> DataFrame:
    """A tenant's rows of a table laid out by tenant; without a tenant no file is read."""
    return tenant_scope(spark.read.parquet(path), tenant, column)


def checked_write(df: DataFrame, path: str, tenant, column: str = "tenant_id", mode: str = "append") -> None:
    """Write one tenant's rows; a single foreign row refuses the whole write."""
    if tenant is None or not foreign_rows(df, tenant, column).isEmpty():
        raise PermissionError("write refused: rows of another tenant")
    df.write.mode(mode).partitionBy(column).parquet(path)
