"""Water vertical: the same resolver and gate with refusals, a power estimate and its own score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions import measures as M
from accountloom.operators.ordering import global_rank
from accountloom.operators.outliers import flag_outliers, gate_statistics, water_note
from accountloom.plans.profiles import Profile
from accountloom.plans.registry import (NO_NAME, account_mode, active, bucket_names,
                                        SITE_DETAILS, refused_spellings, resolve_spellings,
                                        to_code_cells, usable_sites, with_details, with_reported)
from accountloom.session import pin

SITE_COLUMNS = ("facility_id", "ord", "facility_name", "city", "state", "rto", "naics",
                "chlorine_lb", "ammonia_lb", "program_level", "accidents", "recent_accidents",
                "reported", "excluded")
FIELDS = ("chlorine_lb", "ammonia_lb")


def with_exclusion(filings: DataFrame, p: Profile) -> DataFrame:
    """Refuse processes that cannot stop, before any name is resolved."""
    return filings.withColumn("excluded", M.excluded_reason(
        F.col("facility_name"), F.col("parent_name"), F.col("operator_name"), p.exclusions))


def with_site_measures(sites: DataFrame, p: Profile) -> DataFrame:
    return sites.withColumns({
        "est_peak_kw": M.est_peak_kw(F.col("chlorine_lb"), F.col("program_level")),
        "buffer_class": M.buffer_class(
            F.col("facility_name"), F.col("naics"), sewer=p.sewer_name, water=p.water_name,
            elevated_naics=p.elevated_naics, wet_well_naics=p.wet_well_naics)})


def to_cells(sites: DataFrame, spellings: DataFrame, p: Profile) -> DataFrame:
    """Counts and sums per (spelling, state, grid, buffer class), with the key."""
    ok = F.col("validated")

    def total(c: str) -> Column:
        return F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c)

    counted = with_site_measures(sites, p).groupBy(
        "reported", "state", "rto", "buffer_class").agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(ok).alias("ok_sites"),
        total("chlorine_lb"), total("ammonia_lb"), total("est_peak_kw"),
        F.coalesce(F.max(F.when(ok, F.col("chlorine_lb"))), F.lit(0)).alias("max_chlorine_lb"),
        F.sum("accidents").alias("accidents"),
        F.count_if(ok & (F.col("accidents") > 0)).alias("sites_with_accidents"),
        F.count_if(ok & (F.col("recent_accidents") > 0)).alias("recent_accident_sites"),
        F.min("ord").alias("first_ord"))
    return counted.join(spellings.filter("key is not null"), "reported").withColumns(
        {"account_key": F.col("key"), "merged": F.lit(False)})


def majority_class(cells: DataFrame) -> DataFrame:
    """Class of most validated sites; a tie is called mixed rather than decided."""
    per_class = cells.groupBy("account_key", "buffer_class").agg(F.sum("ok_sites").alias("n")).filter("n > 0")
    best = per_class.groupBy("account_key").agg(
        F.max(F.struct("n", "buffer_class")).alias("top"),
        F.collect_list("n").alias("counts"))  # one number per class, five classes at most
    ties = F.size(F.filter("counts", lambda n: n == F.col("top.n")))
    return best.select("account_key", F.when(ties > 1, R.BUFFER_MIXED).otherwise(
        F.col("top.buffer_class")).alias("buffer_class"))


def roll_up(cells: DataFrame, code_cells: DataFrame, names: DataFrame, p: Profile) -> DataFrame:
    totals = cells.groupBy("account_key").agg(
        *[F.sum(c).alias(c) for c in ("sites", "ok_sites", "chlorine_lb", "ammonia_lb", "accidents",
                                      "sites_with_accidents", "recent_accident_sites")],
        F.sum("est_peak_kw").alias("est_peak_kw_total"),
        F.max("max_chlorine_lb").alias("max_site_chlorine_lb"),
        F.array_sort(F.collect_set(F.coalesce("state", F.lit("")))).alias("state_set"))
    code = F.col("primary_naics") if p.naics_prefix is None else F.substring(
        "primary_naics", 1, p.naics_prefix)
    name = F.col("name")
    return (totals.join(account_mode(cells, "state"), "account_key")
            .join(account_mode(cells, "rto"), "account_key")
            .join(account_mode(code_cells, "naics"), "account_key")
            .join(majority_class(cells), "account_key", "left")
            .join(names.withColumnRenamed("key", "account_key"), "account_key")
            .select("account_key", name.alias("account"),
                    (name.isin(*p.customers) if p.customers else F.lit(False)).alias("is_customer"),
                    "sites", "ok_sites", (F.col("sites") - F.col("ok_sites")).alias("unvalidated_sites"),
                    "chlorine_lb", "ammonia_lb", "max_site_chlorine_lb", "est_peak_kw_total",
                    "buffer_class", F.lit(False).alias("buffer_confirmed"),
                    F.size("state_set").cast("long").alias("states"),
                    F.array_join("state_set", ",").alias("state_list"), "primary_state",
                    "primary_rto", F.col("primary_state").isin(*p.dereg_states).alias("dereg_state"),
                    (F.col("ok_sites") > 1).alias("multi_site"),
                    name.rlike(p.authority_name).alias("is_authority"),
                    "accidents", "sites_with_accidents", "recent_accident_sites", "primary_naics",
                    M.lookup(code, p.naics_labels, "Other").alias("vertical"), "first_ord"))


def admitted(p: Profile) -> Column:
    return (F.col("ok_sites") > 0) & ((F.col("est_peak_kw_total") >= p.kw_floor)
                                      | (F.col("ok_sites") >= 2))


def score(buckets: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    icp = M.water_icp(
        c("est_peak_kw_total"), c("primary_rto"), c("dereg_state"), c("buffer_class"),
        c("buffer_confirmed"), c("sites_with_accidents"), c("recent_accident_sites"),
        c("multi_site"), c("states"), c("is_authority"),
        strong_grid=p.strong_grid, medium_grid=p.medium_grid)
    return buckets.withColumn("icp", icp).withColumn("icp_score", F.col("icp.score"))


@dataclass(frozen=True)
class WaterRun:
    profile: Profile
    rows: DataFrame
    sites: DataFrame
    spellings: DataFrame
    refused: DataFrame
    stats: DataFrame
    buckets: DataFrame

    @cached_property
    def accounts(self) -> DataFrame:
        scored = score(self.buckets.filter(admitted(self.profile)), self.profile)
        return global_rank(scored, [F.desc("est_peak_kw_total"), F.desc("chlorine_lb"),
                                    F.asc("first_ord")])

    @property
    def keyed_sites(self) -> DataFrame:
        return self.sites.join(self.spellings.filter("key is not null"), "reported")

    @property
    def account_sites(self) -> DataFrame:
        """Every site of an admitted account with its power estimate and buffer class."""
        names = self.buckets.filter(admitted(self.profile)).select(F.col("account_key").alias("key"), "account")
        return with_site_measures(self.keyed_sites, self.profile).join(names, "key")

    @property
    def account_aliases(self) -> DataFrame:
        names = self.buckets.filter(admitted(self.profile)).select(F.col("account_key").alias("key"), "account_key", "account")
        return (self.spellings.filter("key is not null").join(names, "key")
                .select("account_key", F.col("reported").alias("alias"), "account"))

    @property
    def review_queue(self) -> DataFrame:
        return water_queue(self)


def water_queue(run: WaterRun) -> DataFrame:
    """Outliers, unresolved names, refused processes, and accounts under the power floor.

    A flagged site is queued whether or not its account survived, and an account
    that is too small leaves a row instead of vanishing.
    """
    text = lambda v: F.lit(v).cast("string")

    def site_rows(df, kind, reason, action, account=None, note=None, reported=None):
        return df.select(
            F.lit(kind).alias("kind"), "facility_id", F.col("facility_name").alias("name"), "city",
            "state", "naics", "chlorine_lb", "ammonia_lb",
            (reported if reported is not None else text(None)).alias("reported_name"),
            (account if account is not None else text(None)).alias("account"),
            reason.alias("reason"), (note if note is not None else F.lit("")).alias("validation_note"),
            F.lit(action).alias("action"))

    names = run.buckets.select(F.col("account_key").alias("key"), "account")
    flagged = run.keyed_sites.filter(~F.col("validated")).join(names, "key")
    nameless = run.sites.filter("reported is null").unionByName(
        run.sites.join(run.refused, "reported", "left_semi"))
    refused = run.rows.filter("excluded is not null")
    small = run.buckets.filter(~admitted(run.profile))
    return (
        site_rows(flagged, "numeric_outlier", F.col("validation_note"),
                  "verify the filing, correct the value, or confirm exclusion",
                  account=F.col("account"), note=F.col("validation_note"))
        .unionByName(site_rows(nameless, "unresolved_name", F.lit(NO_NAME),
                               "assign to a utility account or create one",
                               reported=F.col("reported")))
        .unionByName(site_rows(refused, "process_exclusion", F.col("excluded"),
                               "confirm refusal or reclassify (human)"))
        .unionByName(small.select(
            F.lit("below_threshold").alias("kind"), text(None).alias("facility_id"),
            text(None).alias("name"), text(None).alias("city"), F.col("primary_state").alias("state"),
            F.col("primary_naics").alias("naics"), "chlorine_lb", "ammonia_lb",
            F.col("account").alias("reported_name"), "account",
            F.concat(F.lit("estimated draw "), F.col("est_peak_kw_total").cast("string"),
                     F.lit(f" kW, below the {run.profile.kw_floor} kW floor")).alias("reason"),
            F.lit("").alias("validation_note"),
            F.lit("confirm whether this is a prospect").alias("action"))))


def run_water(filings: DataFrame, p: Profile) -> WaterRun:
    """``filings`` carries ``chlorine_lb`` and ``ammonia_lb`` per site."""
    details = [c for c in SITE_DETAILS if c not in SITE_COLUMNS]
    rows = pin(with_details(with_exclusion(with_reported(active(filings), p), p)).select(*SITE_COLUMNS, *details),
               "water-sites")
    kept = rows.filter("excluded is null")
    spellings = pin(resolve_spellings(kept, p), "water-spellings")
    fields = {f: F.col(f) for f in FIELDS}
    refused = refused_spellings(spellings)
    stats = pin(gate_statistics(usable_sites(kept, refused), fields), "water-statistics")
    sites = flag_outliers(kept, fields, p.outlier_factor, water_note, stats)
    cells = pin(to_cells(sites, spellings, p), "water-cells")
    codes = to_code_cells(kept, spellings).withColumns(
        {"account_key": F.col("key"), "merged": F.lit(False)})
    buckets = pin(roll_up(cells, codes, bucket_names(cells), p), "water-buckets")
    return WaterRun(p, rows, sites, spellings, refused, stats, buckets)
