"""Registry pipeline: filings -> sites -> accounts, with one review queue for refusals.

Stages hand over DataFrames.  ``resolve_sites`` works row by row; everything
that needs a company works on *cells*, the counts and sums per
(spelling, state, grid) that Spark builds with partial aggregation, so a
company that files a third of all rows is a handful of cells after the first
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.functions import measures as M
from accountloom.functions import names as N
from accountloom.operators.ordering import global_rank
from accountloom.operators.outliers import cold_note, flag_outliers, gate_statistics
from accountloom.plans.profiles import Profile
from accountloom.session import compute_once, pin

NO_NAME = "no usable parent/operator/facility name after normalisation"
QUEUE_COLUMNS = ("kind", "facility_id", "name", "city", "state", "naics", "charge_lb",
                 "reported_name", "account", "reason", "validation_note", "action")


# --- row stage ---------------------------------------------------------------

SITE_COLUMNS = ("facility_id", "ord", "facility_name", "city", "state", "rto", "naics", "charge_lb",
                "program_level", "accidents", "operator_name", "operator_is_person", "reported")


SITE_DETAILS = {"recent_accidents": "int", "submissions": "int", "url": "string", "lat": "string", "lon": "string"}


def with_details(filings: DataFrame) -> DataFrame:
    """Columns that a site sheet shows; a source without them leaves them null."""
    missing = {c: F.lit(None).cast(kind) for c, kind in SITE_DETAILS.items() if c not in filings.columns}
    return filings.withColumns(missing) if missing else filings


def active(filings: DataFrame) -> DataFrame:
    return filings.filter(~F.coalesce("is_deregistered", F.lit(False)))


def in_scope(filings: DataFrame, naics: list[str] | None = None, state: str | None = None,
             code: str = "naics") -> DataFrame:
    """Optional scope; both filters reach the file scan."""
    if naics:
        filings = filings.filter(F.col(code).isin(*naics))
    if state:
        filings = filings.filter(F.col("state") == state)
    return filings


def with_reported(filings: DataFrame, p: Profile) -> DataFrame:
    """Add ``reported`` (the chosen name) and whether the operator is a person.

    The person patterns only run for rows that report no parent.  The steps are kept apart:
    generated as one piece with the filings view they pass the 8,000 bytes of bytecode up to
    which the JVM compiles a method, and run interpreted from there on.
    """
    sources = ("parent_name", "operator_name", "facility_name")
    named = compute_once(filings, **{c: F.col(c) for c in sources})
    parent = F.col("parent_name")
    facility = F.col("facility_name")
    if p.resolve_site_names:
        facility = N.strip_site_qualifier(facility)
    person = F.lit(False)
    if p.resolve_people:
        person = F.when(N.non_blank(parent).isNull(),
                        N.looks_like_person(F.col("operator_name"))).otherwise(False)
    return compute_once(compute_once(named, operator_is_person=person), reported=N.pick_reported(
        parent, F.col("operator_name"), facility, F.col("operator_is_person")))


def resolve_spellings(sites: DataFrame, p: Profile) -> DataFrame:
    """Each distinct reported name with its key, display name and rule/fallback tag."""
    return N.with_resolution(sites.select("reported").filter("reported is not null").distinct(),
                             "reported", p.rules, p.word_final)


def refused_spellings(spellings: DataFrame) -> DataFrame:
    """The few spellings that are no names.  Pinned on their own, so that Spark sees
    how small they are and joins the sites to them without moving the sites."""
    return pin(spellings.filter("key is null").select("reported"), "refused")


def usable_sites(sites: DataFrame, refused: DataFrame) -> DataFrame:
    """Sites whose name resolved."""
    return sites.filter("reported is not null").join(refused, "reported", "left_anti")


def flag_sites(sites: DataFrame, p: Profile, stats: DataFrame) -> DataFrame:
    """Numeric gate; ``stats`` describe the resolved sites only."""
    return flag_outliers(sites, {p.charge_field: F.col("charge_lb")}, p.outlier_factor, cold_note,
                         stats)


# --- company stage -----------------------------------------------------------

def to_cells(sites: DataFrame, spellings: DataFrame) -> DataFrame:
    """Counts and sums per (spelling, state, grid), then the spelling's key.

    Only numbers are aggregated, so this first and largest aggregation is a
    hash aggregation with map-side combine, and only its result meets the
    spelling table.
    """
    ok = F.col("validated")
    counted = sites.groupBy("reported", "state", "rto").agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if(ok).alias("ok_sites"),
        F.sum(F.when(ok, F.col("charge_lb")).otherwise(0)).alias("charge_lb"),
        F.coalesce(F.max(F.when(ok, F.col("charge_lb"))), F.lit(0)).alias("max_charge_lb"),
        F.sum("accidents").alias("accidents"),
        F.count_if(ok & (F.col("accidents") > 0)).alias("sites_with_accidents"),
        F.min("ord").alias("first_ord"))
    return counted.join(spellings.filter("key is not null"), "reported")


def to_code_cells(sites: DataFrame, spellings: DataFrame) -> DataFrame:
    """Site counts per (spelling, industry code).  Kept apart from the place cells:
    crossing states with codes would leave little for the map side to combine."""
    counted = sites.groupBy("reported", "naics").agg(
        F.count(F.lit(1)).alias("sites"), F.min("ord").alias("first_ord"))
    return counted.join(spellings.filter("key is not null").select("reported", "key"), "reported")


def bucket_names(cells: DataFrame) -> DataFrame:
    """One display name per key: a rule name beats a fallback, then first seen."""
    shown = cells.groupBy("key", "shown", "resolved_by").agg(F.min("first_ord").alias("first_ord"))
    return shown.groupBy("key").agg(
        F.min_by("shown", F.struct(F.col("resolved_by") != "rule", F.col("first_ord"))).alias("name"),
        F.min("first_ord").alias("first_ord"))


def site_number_merges(names: DataFrame) -> DataFrame:
    """``(key, final_key)`` for buckets whose numbered name has a sibling without the number.

    A stem always has a shorter key, so chains end.  Each round doubles the
    distance every pointer has travelled; a table without chains needs one count.
    """
    stem_key = N.match_key(N.site_number_stem(F.col("name")))
    stems = (names.select("key", stem_key.alias("final_key"))
             .filter("final_key is not null and final_key <> '' and final_key <> key"))
    keys = names.select(F.col("key").alias("final_key"))
    hops = pin(stems.join(keys, "final_key", "left_semi").select("key", "final_key"), "hops")
    while True:
        step = hops.select(F.col("key").alias("final_key"), F.col("final_key").alias("further"))
        chained = hops.join(step, "final_key", "left_semi")
        if chained.isEmpty():
            return hops
        hops = pin(hops.join(step, "final_key", "left").select(
            "key", F.coalesce("further", "final_key").alias("final_key")), "hops")


def merge_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Point cells at their final key; merged-in cells rank after the bucket's own."""
    moved = cells.join(merges, "key", "left")
    return moved.select(
        F.coalesce("final_key", "key").alias("account_key"),
        F.col("final_key").isNotNull().alias("merged"), *cells.columns)


def account_mode(cells: DataFrame, dim: str) -> DataFrame:
    """First-seen mode of one column per account; own cells come before merged-in ones."""
    value = F.coalesce(F.col(dim), F.lit("")).alias("value")
    at = F.col("first_ord")
    per_value = cells.select("account_key", "sites", "merged", "first_ord", value).groupBy(
        "account_key", "value").agg(
        F.sum("sites").alias("n"), F.min(F.when(~F.col("merged"), at)).alias("own_at"),
        F.min(at).alias("any_at"))
    first = F.struct(-F.col("n"), F.col("own_at").isNull(), F.coalesce("own_at", "any_at"))
    return per_value.groupBy("account_key").agg(F.min_by("value", first).alias(f"primary_{dim}"))


def roll_up(cells: DataFrame, code_cells: DataFrame, names: DataFrame, p: Profile) -> DataFrame:
    """Every bucket as one row, before any admission filter."""
    totals = cells.groupBy("account_key").agg(
        F.sum("sites").alias("sites"),
        F.sum("ok_sites").alias("ok_sites"),
        F.sum("charge_lb").alias("charge_lb"),
        F.max("max_charge_lb").alias("max_site_charge_lb"),
        F.sum("accidents").alias("accidents"),
        F.sum("sites_with_accidents").alias("sites_with_accidents"),
        F.array_sort(F.collect_set(F.coalesce("state", F.lit("")))).alias("state_set"))
    own = names.withColumnRenamed("key", "account_key")
    labels = F.col("primary_naics") if p.naics_prefix is None else F.substring(
        "primary_naics", 1, p.naics_prefix)
    return (totals.join(account_mode(cells, "rto"), "account_key")
            .join(account_mode(code_cells, "naics"), "account_key").join(own, "account_key")
            .select("account_key", F.col("name").alias("account"),
                    F.col("name").isin(*p.customers).alias("is_customer") if p.customers
                    else F.lit(False).alias("is_customer"),
                    "sites", (F.col("sites") - F.col("ok_sites")).alias("unvalidated_sites"),
                    "ok_sites", "charge_lb", "max_site_charge_lb",
                    F.size("state_set").cast("long").alias("states"),
                    F.array_join("state_set", ",").alias("state_list"),
                    "primary_rto", "accidents", "sites_with_accidents", "primary_naics",
                    M.lookup(labels, p.naics_labels, "Other").alias("vertical"), "first_ord"))


def admitted(p: Profile) -> Column:
    return (F.col("ok_sites") >= 2) | (F.col("max_site_charge_lb") >= p.single_site_floor)


def score_accounts(buckets: DataFrame, p: Profile) -> DataFrame:
    icp = M.cold_icp(F.col("sites"), F.col("charge_lb"), F.col("states"), F.col("primary_rto"),
                     F.col("sites_with_accidents"), F.col("primary_naics"),
                     strong_grid=p.strong_grid, medium_grid=p.medium_grid, best_naics=p.best_naics)
    return buckets.withColumn("icp", icp).withColumn("icp_score", F.col("icp.score"))


def aliases(cells: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every reported spelling of every account, one row each."""
    return (cells.select("account_key", F.col("reported").alias("alias")).distinct()
            .join(buckets.select("account_key", "account"), "account_key"))


# --- the whole run -----------------------------------------------------------

@dataclass(frozen=True)
class RegistryRun:
    """The tables of one run.  ``sites``, ``spellings``, ``cells`` and ``buckets`` rest
    on pinned tables; the rest is lazy."""

    profile: Profile
    sites: DataFrame
    spellings: DataFrame
    refused: DataFrame
    stats: DataFrame
    cells: DataFrame
    merges: DataFrame
    buckets: DataFrame

    @property
    def admitted_buckets(self) -> DataFrame:
        return self.buckets.filter(admitted(self.profile))

    @cached_property
    def accounts(self) -> DataFrame:
        """Admitted accounts, scored and ranked once."""
        return global_rank(score_accounts(self.admitted_buckets, self.profile),
                           [F.desc("sites"), F.desc("charge_lb"), F.asc("first_ord")])

    @cached_property
    def keyed_spellings(self) -> DataFrame:
        """Usable spellings with the key of the bucket they ended up in, pinned for the queue's branches."""
        return pin(self.spellings.filter("key is not null").join(self.merges, "key", "left").select(
            "reported", "key", "shown", "resolved_by",
            F.coalesce("final_key", "key").alias("account_key"),
            F.col("final_key").isNotNull().alias("merged")), "keyed-spellings")

    @property
    def keyed_sites(self) -> DataFrame:
        return self.sites.join(self.keyed_spellings, "reported")

    @property
    def account_sites(self) -> DataFrame:
        """Every site of an admitted account, with the account's name."""
        return self.keyed_sites.join(
            self.admitted_buckets.select("account_key", "account"), "account_key")

    @property
    def unresolved_sites(self) -> DataFrame:
        """Active sites without a usable name."""
        return self.sites.filter("reported is null").unionByName(
            self.sites.join(self.refused, "reported", "left_semi"))

    @property
    def account_aliases(self) -> DataFrame:
        return aliases(self.cells, self.admitted_buckets)

    @property
    def below_queue_floor(self) -> DataFrame:
        """Buckets that are neither admitted nor large enough to queue."""
        return self.buckets.filter(
            ~admitted(self.profile)
            & (F.col("max_site_charge_lb") < self.profile.queue_floor))

    @property
    def review_queue(self) -> DataFrame:
        from accountloom.plans.queue import cold_queue

        return cold_queue(self)


def run_registry(filings: DataFrame, p: Profile) -> RegistryRun:
    """Resolve, gate and roll up.  Filings are read once; the slim site table is pinned."""
    rows = pin(with_details(with_reported(active(filings), p)).select(*SITE_COLUMNS, *SITE_DETAILS), "sites")
    spellings = pin(resolve_spellings(rows, p), "spellings")
    refused = refused_spellings(spellings)
    stats = pin(gate_statistics(usable_sites(rows, refused), {p.charge_field: F.col("charge_lb")}), "statistics")
    sites = flag_sites(rows, p, stats)
    cells = pin(to_cells(sites, spellings), "cells")
    names = bucket_names(cells)
    if p.resolve_site_numbers:
        merges = site_number_merges(names)
    else:
        merges = names.select("key", F.col("key").alias("final_key")).limit(0)
    merged = merge_cells(cells, merges)
    codes = merge_cells(to_code_cells(rows, spellings), merges)
    buckets = pin(roll_up(merged, codes, names, p), "buckets")
    return RegistryRun(p, sites, spellings, refused, stats, merged, merges, buckets)


def run_statistics(filings: DataFrame, run: RegistryRun) -> DataFrame:
    """One row of run metrics: one scalar subquery per table, whatever it is counted for.

    ``observe`` on the writes would save their jobs, but its counters count a task again
    that runs again after an executor is lost, and these figures are compared with others.
    """
    count = F.count(F.lit(1))

    def once(table: DataFrame, **metrics: Column) -> Column:
        return table.agg(F.struct(*[m.alias(n) for n, m in metrics.items()]).alias("m")).scalar()

    names = run.account_aliases.groupBy("account_key").agg(count.alias("n"))
    totals = once(run.admitted_buckets, n=count, customers=F.count_if("is_customer"), sites=F.sum("sites"),
                  charge_lb=F.sum("charge_lb"))
    sites = once(run.sites, active=count)
    return run.stats.select(
        once(filings, n=count)["n"].alias("facilities"), sites["active"].alias("active"),
        F.col(f"{run.profile.charge_field}_p99").alias("p99"),
        F.col(f"{run.profile.charge_field}_median").alias("median"),
        once(run.keyed_sites, n=F.count_if(~F.col("validated")))["n"].alias("flagged"),
        totals["n"].alias("accounts"), totals["customers"].alias("customers"), totals["sites"].alias("sites"),
        totals["charge_lb"].alias("charge_lb"), once(names, n=F.count_if(F.col("n") > 1))["n"].alias("multi_alias"))


def conservation(run: RegistryRun) -> DataFrame:
    """Where every active filing ended up; the parts add up to ``active``."""
    p = run.profile
    place = (F.when(admitted(p), "in_accounts")
             .when(F.col("max_site_charge_lb") >= p.queue_floor, "below_threshold")
             .otherwise("below_queue_floor"))

    def sites_in(name):
        return F.coalesce(F.sum(F.when(F.col("place") == name, F.col("sites"))), F.lit(0)).alias(name)

    count = F.count(F.lit(1)).alias("n")
    return run.buckets.withColumn("place", place).agg(
        sites_in("in_accounts"), sites_in("below_threshold"), sites_in("below_queue_floor")
    ).select(run.sites.agg(count).scalar().alias("active"), "*",
             run.unresolved_sites.agg(count).scalar().alias("unresolved"))
