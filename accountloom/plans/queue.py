"""The review queue: every refusal, near miss and substitution as one row with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.functions import names as N
from accountloom.plans.registry import NO_NAME, QUEUE_COLUMNS, RegistryRun, admitted

KIND_ORDER = ("numeric_outlier", "unresolved_name", "below_threshold", "merge_rescue",
              "operator_is_person")


def _shape(df: DataFrame) -> DataFrame:
    """Queue columns in order; a column a kind does not fill is null or empty."""
    have = set(df.columns)
    return df.select(*[
        F.col(c) if c in have else F.lit("" if c == "validation_note" else None).cast("string").alias(c)
        for c in QUEUE_COLUMNS])


def _site(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("facility_name", "name")


def outliers(run: RegistryRun) -> DataFrame:
    names = run.buckets.select("account_key", "account")
    flagged = run.keyed_sites.filter(~F.col("validated")).join(names, "account_key")
    return _shape(_site(flagged).select(
        "*", F.lit("numeric_outlier").alias("kind"), F.col("validation_note").alias("reason"),
        F.lit("verify the filing, correct the value, or confirm exclusion").alias("action")))


def unresolved(run: RegistryRun) -> DataFrame:
    rows = run.unresolved_sites.drop("validation_note")
    return _shape(_site(rows).select(
        "*", F.lit("unresolved_name").alias("kind"), F.col("reported").alias("reported_name"),
        F.lit(NO_NAME).alias("reason"),
        F.lit("assign to an account or create one").alias("action")))


def operator_people(run: RegistryRun) -> DataFrame:
    rows = run.sites.filter("operator_is_person").drop("validation_note").join(
        run.keyed_spellings, "reported")
    return _shape(_site(rows).select(
        "*", F.lit("operator_is_person").alias("kind"),
        F.col("operator_name").alias("reported_name"), F.col("shown").alias("account"),
        F.concat(F.lit('operator field "'), "operator_name",
                 F.lit('" looks like an individual, not a company')).alias("reason"),
        F.concat(F.lit("confirm "), "shown",
                 F.lit(" is the operating company, or supply the correct one")).alias("action")))


def rescues_by_bucket(run: RegistryRun) -> DataFrame:
    """First rescue per account, judged once per spelling; own names beat merged-in ones."""
    would_be = N.merge_rescue(F.col("reported"), F.col("key"), run.profile.rules)
    hits = run.cells.withColumn("would_be", would_be).filter(F.col("would_be").isNotNull())
    first = hits.groupBy("account_key").agg(
        F.min_by(F.struct("would_be", F.col("reported").alias("reported_name")),
                 F.struct("merged", "first_ord")).alias("r"))
    return first.select("account_key", "r.*")


def largest_sites(run: RegistryRun, keys: DataFrame, *, validated_only: bool) -> DataFrame:
    """The biggest site of each wanted bucket; first seen on a tie.

    Sites meet the wanted spellings first, so the maximum per bucket is combined
    on the map side even where one bucket holds most of the sites.
    """
    wanted = run.keyed_spellings.join(keys.select("account_key"), "account_key", "left_semi")
    rows = run.sites.join(wanted.select("reported", "account_key", "merged"), "reported")
    if validated_only:
        rows = rows.filter("validated")
    site = F.struct("facility_id", F.col("facility_name").alias("name"), "city", "state", "naics",
                    "charge_lb")
    return rows.groupBy("account_key").agg(
        F.min_by(site, F.struct(-F.col("charge_lb"), F.col("merged"), F.col("ord"))).alias("s")
    ).select("account_key", "s.*")


def below_threshold(run: RegistryRun) -> DataFrame:
    p = run.profile
    small = run.buckets.filter(
        ~admitted(p) & (F.col("max_site_charge_lb") >= p.queue_floor)).select("account_key", "account")
    rows = small.join(largest_sites(run, small, validated_only=True), "account_key")
    return _shape(rows.select(
        "*", F.lit("below_threshold").alias("kind"), F.col("account").alias("reported_name"),
        F.concat(F.lit("single site at "), F.col("charge_lb").cast("string"),
                 F.lit(f" lb, below the {p.single_site_floor} lb pilot floor")).alias("reason"),
        F.lit("confirm whether this is a prospect; approving admits it as a sub-threshold "
              "account").alias("action")))


def merge_rescues(run: RegistryRun) -> DataFrame:
    p = run.profile
    hits = rescues_by_bucket(run).join(run.buckets.select("account_key", "account"), "account_key")
    rows = hits.join(largest_sites(run, hits, validated_only=False), "account_key")
    customer = F.col("would_be").isin(*p.customers) if p.customers else F.lit(False)
    return _shape(rows.select(
        "*", F.lit("merge_rescue").alias("kind"),
        F.concat(F.lit("would have merged into "), "would_be", F.when(
            customer, F.lit(", an existing CUSTOMER, and been suppressed from outbound")
        ).otherwise("")).alias("reason"),
        F.concat(F.lit("confirm "), "account", F.lit(" is a separate company from "),
                 "would_be").alias("action")))


def cold_queue(run: RegistryRun) -> DataFrame:
    parts = [outliers(run), unresolved(run), below_threshold(run), merge_rescues(run),
             operator_people(run)]
    queue = parts[0]
    for part in parts[1:]:
        queue = queue.unionByName(part)
    kinds = F.array(*map(F.lit, KIND_ORDER))
    return queue.withColumn("kind_ord", F.array_position(kinds, F.col("kind")).cast("long"))


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


def with_severity(queue: DataFrame) -> DataFrame:
    """Severity of each kind: a wrong merge or an unplaced filing blocks, a substitution informs."""
    return queue.withColumn("severity", F.when(
        F.col("kind").isin("merge_rescue", "unresolved_name"), "blocking")
        .when(F.col("kind") == "operator_is_person", "info").otherwise("waiting"))


def by_severity(severities: tuple[str, ...] = ("blocking", "waiting", "info")) -> Column:
    """Sort column of the one ranked list: what blocks comes first."""
    return F.array_position(F.array(*map(F.lit, severities)), F.col("severity")).asc()


def ranked(queue: DataFrame) -> list[Column]:
    """Sort columns of a list whose rows have an age: severity first, then age."""
    return [by_severity(), F.col("created_at").asc()]
