"""Command line: ``python -m accountloom registry|water|triage ...`` on landed files.

    registry --from-json SNAPSHOT --outdir OUT [--naics CODE ...] [--state ST] [--dry-run]
    water    --from-json SNAPSHOT --outdir OUT [--state ST] [--dry-run]
    triage   --from-json SNAPSHOT --sidecar PATH --snapshots PATH --outdir OUT --run NAME
             --judged-at TIME [--limit N] [--mock]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.plans import registry, triage, water
from accountloom.plans.profiles import COLD, WATER
from accountloom.plans.queue import queue_counts
from accountloom.sources import sidecar, sinks, snapshots


def _provenance(spark: SparkSession, path: str) -> list[dict[str, str]]:
    return snapshots.provenance_of(snapshots.read_snapshot(spark, path))


def _filings(spark: SparkSession, args: argparse.Namespace, naics: list[str] | None = None) -> DataFrame:
    """Filings in scope; the scope applies before repeats of a facility are merged."""
    landed = registry.in_scope(snapshots.read_snapshot(spark, args.from_json), naics, args.state, "naicsCode")
    return snapshots.normalise(snapshots.keep_last_filing(landed))


def run_cold(spark: SparkSession, args: argparse.Namespace) -> None:
    filings = _filings(spark, args, args.naics)
    run = registry.run_registry(filings, COLD)
    registry.run_statistics(filings, run).show(truncate=False, vertical=True)
    queue_counts(run.review_queue).show(truncate=False)
    if not args.dry_run:
        sinks.write_registry(run, args.outdir, _provenance(spark, args.from_json))


def run_water(spark: SparkSession, args: argparse.Namespace) -> None:
    run = water.run_water(_filings(spark, args, list(R.WATER_NAICS)), WATER)
    queue_counts(run.review_queue).show(truncate=False)
    if not args.dry_run:
        sinks.write_water(run, args.outdir, _provenance(spark, args.from_json))


def run_triage(spark: SparkSession, args: argparse.Namespace) -> None:
    run = water.run_water(_filings(spark, args, list(R.WATER_NAICS)), WATER)
    accounts = run.accounts.withColumn("sheddability", F.col("icp.components.sheddability"))
    if args.mock:
        sites = run.keyed_sites.withColumn("account_key", F.col("key"))
        triage.judge_missing(accounts, sites, args.sidecar, limit=args.limit, judged_at=args.judged_at)
    versions = {"rules_version": R.RULES_VERSION, "prompt_version": R.PROMPT_VERSION,
                "model_version": args.model_version}
    out = triage.run_triage(accounts, sidecar.read_sidecar(spark, args.sidecar),
                            triage.previous_snapshot(spark, args.snapshots), limit=args.limit, versions=versions)
    out.verdict.show()
    sinks.write_triage(out.results, f"{args.outdir}/triage_csv")
    sinks.write_snapshot(out.snapshot, args.snapshots, args.run, args.judged_at)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="accountloom")
    commands = p.add_subparsers(dest="command", required=True)
    for name, fn in (("registry", run_cold), ("water", run_water), ("triage", run_triage)):
        c = commands.add_parser(name)
        c.set_defaults(fn=fn)
        c.add_argument("--from-json", required=True)
        c.add_argument("--outdir", required=True)
        c.add_argument("--state")
        if name == "registry":
            c.add_argument("--naics", nargs="*")
        if name == "triage":
            c.add_argument("--sidecar", required=True)
            c.add_argument("--snapshots", required=True)
            c.add_argument("--run", required=True)
            c.add_argument("--judged-at", required=True)
            c.add_argument("--model-version", default="rule-judge")
            c.add_argument("--limit", type=int, help="judge only so many of the best-ranked accounts")
            c.add_argument("--mock", action="store_true")
        else:
            c.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.fn(SparkSession.builder.appName("accountloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
