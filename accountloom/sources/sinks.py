"""Sinks of the registry and triage runs.  Each writes a folder of part files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.operators.quality import golden_diff
from accountloom.plans.queue import cold_queue
from accountloom.plans.registry import RegistryRun
from accountloom.plans.water import WaterRun
from accountloom.session import pin

ACCOUNT_COLUMNS = (
    "rank", "icp_score", "account", "is_customer", "sites", "unvalidated_sites", "ammonia_lb",
    "max_site_ammonia_lb", "states", "state_list", "primary_rto", "accidents",
    "sites_with_accidents", "primary_naics", "vertical", "aliases")
WATER_COLUMNS = (
    "rank", "icp_score", "account", "is_customer", "sites", "unvalidated_sites", "chlorine_lb",
    "max_site_chlorine_lb", "est_peak_kw_total", "buffer_class", "buffer_confirmed", "states",
    "state_list", "primary_state", "primary_rto", "dereg_state", "multi_site", "is_authority",
    "accidents", "sites_with_accidents", "recent_accident_sites", "primary_naics", "vertical", "aliases")
QUEUE_COLUMNS = ("kind", "rmp_id", "name", "city", "state", "naics", "ammonia_lb", "reported_name",
                 "account", "reason", "validation_note", "action")
WATER_QUEUE_COLUMNS = ("kind", "rmp_id", "name", "city", "state", "naics", "chlorine_lb", "ammonia_lb",
                       "reported_name", "account", "reason", "validation_note", "action")
WATER_KINDS = ("numeric_outlier", "unresolved_name", "process_exclusion", "below_threshold")
TRIAGE_COLUMNS = (
    "account", "baseline_score", "final_score", "delta", "baseline_shed", "shed", "lifted",
    "disposition", "agreement", "rule_buffer", "judge_buffer_top", "judge_p_top",
    "continuous_p_yes", "regulated_p_yes", "confirm_candidate", "review_flag", "source", "note",
    "rules_version", "model_version", "prompt_version", "request_hash", "response_hash",
    "qualification_basis")


def _flags(df: DataFrame) -> DataFrame:
    """Booleans as True/False."""
    return df.select(*[F.initcap(F.col(f.name).cast("string")).alias(f.name)
                       if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; nested values become JSON."""
    nested = ("array", "struct", "map")
    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(nested)
                       else F.col(f.name) for f in df.schema])
    _flags(flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def accounts_table(run: RegistryRun) -> DataFrame:
    """Account rows with their spellings joined by " | ".

    The spellings are distinct per account before they are joined; the flat
    alias table is the one to use where a company may have very many.
    """
    return run.accounts.join(_joined_aliases(run), "account_key").withColumnsRenamed({
        "charge_lb": "ammonia_lb", "max_site_charge_lb": "max_site_ammonia_lb"}).select(*ACCOUNT_COLUMNS)


def _joined_aliases(run: RegistryRun | WaterRun) -> DataFrame:
    return run.account_aliases.groupBy("account_key").agg(
        F.array_join(F.array_sort(F.collect_set("alias")), " | ").alias("aliases"))


def water_accounts_table(run: WaterRun) -> DataFrame:
    return run.accounts.join(_joined_aliases(run), "account_key").select(*WATER_COLUMNS)


Provenance = Mapping[str, str] | Sequence[Mapping[str, str]]


def _write_all(accounts: DataFrame, sites: DataFrame, queue: DataFrame, folder: str, provenance: Provenance) -> None:
    """Accounts, sites and queue as CSV, and the seed tables as JSON with provenance.

    Output without attribution is refused: the licence requires it.  Tables that are
    written twice are pinned first.
    """
    origins = [provenance] if isinstance(provenance, Mapping) else list(provenance)
    if not origins or not all(p.get("attribution") and p.get("licence") for p in origins):
        raise ValueError("attribution and licence are required in every output")
    tables = {"accounts": (pin(accounts, "accounts-out"), ["rank"]), "sites": (pin(sites, "sites-out"), []),
              "review_queue": (pin(queue, "queue-out"), ["kind_ord", "rmp_id", "reported_name"])}
    meta = accounts.sparkSession.createDataFrame([dict(p) for p in origins])
    meta.write.mode("overwrite").json(f"{folder}/seed/meta")
    for name, (table, order) in tables.items():
        shown = (table.orderBy(*order) if order else table).drop("kind_ord")
        write_csv(shown, f"{folder}/{name}_csv")
        shown.write.mode("overwrite").json(f"{folder}/seed/{name}")


def write_registry(run: RegistryRun, folder: str, provenance: Provenance) -> None:
    sites = run.account_sites.drop("account_key", "key", "shown", "resolved_by", "merged", "ord")
    queue = cold_queue(run).withColumnsRenamed({"facility_id": "rmp_id", "charge_lb": "ammonia_lb"})
    _write_all(accounts_table(run), sites, queue.select("kind_ord", *QUEUE_COLUMNS), folder, provenance)


def write_water(run: WaterRun, folder: str, provenance: Provenance) -> None:
    sites = run.account_sites.drop("account_key", "key", "shown", "resolved_by", "ord", "excluded")
    queue = run.review_queue.withColumnRenamed("facility_id", "rmp_id").withColumn(
        "kind_ord", F.array_position(F.array(*map(F.lit, WATER_KINDS)), F.col("kind")).cast("long"))
    _write_all(water_accounts_table(run), sites, queue.select("kind_ord", *WATER_QUEUE_COLUMNS), folder, provenance)


def write_triage(results: DataFrame, path: str) -> None:
    write_csv(results.select(*TRIAGE_COLUMNS), path)


SNAPSHOT_SCHEMA = ("account string, score bigint, model_version string, run string, taken_at string, "
                   "rules_version string, prompt_version string")


def write_snapshot(snapshot: DataFrame, path: str, run: str, taken_at: str) -> None:
    """Pin a snapshot under its run; earlier runs stay as they are and a run is written once.

    ``taken_at`` is an ISO time and decides which snapshot is the newest; names do not.
    """
    try:
        used = not read_all_snapshots(snapshot.sparkSession, path).filter(F.col("run") == run).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        used = False
    if used:
        raise ValueError(f"run {run} already has a snapshot")
    snapshot.withColumns({"run": F.lit(run), "taken_at": F.lit(taken_at)}).write.mode("append").partitionBy(
        "rules_version", "prompt_version").parquet(path)


def read_all_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that was taken last; of two taken at once, the later run name."""
    rows = read_all_snapshots(spark, path)
    newest = rows.agg(F.max(F.struct("taken_at", "run")).alias("n")).select("n.run").scalar()
    return rows.filter(F.col("run") == newest).drop("run", "taken_at")


def check_golden(actual: DataFrame, expected: DataFrame, keys: list[str]) -> None:
    """Refuse output that differs from a committed table; the message shows a few cells."""
    shown = golden_diff(actual, expected, keys).limit(5).collect()
    if shown:
        raise AssertionError(f"output differs from the golden table, for example {shown}")
