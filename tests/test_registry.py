"""The registry pipeline on small landed snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from accountloom.functions import measures as M
from accountloom.plans import registry as P
from accountloom.plans.profiles import COLD, WATER
from accountloom.plans.queue import queue_counts
from accountloom.plans.water import run_water
from accountloom.sources import sinks, snapshots
from accountloom.sources.snapshots import normalise, read_pages, read_snapshot, registry_filings

META = {"dataset_version": "7", "pulled": "2026-09-13", "source": "registry", "licence": "CC BY-SA 4.0",
        "attribution": "the registry", "disclaimer": "self-reported"}


def filing(i, parent=None, operator=None, name="Plant", state="PA", naics="49312", lb=20_000, compact=False, **kw):
    chem = ({"_chem": [{"id": 56, "name": None, "qty": lb}]} if compact else
            {"chemicals": [{"chemicalId": 9, "chemicalName": "Anhydrous ammonia", "quantity": lb}]})
    return {"facilityId": str(i), "facilityName": name, "parentCompanyName": parent, "operatorName": operator,
            "city": "X", "state": state, "naicsCode": naics, "programLevel": 3, **chem, **kw}


def land(tmp_path, filings, name="snap.json"):
    path = tmp_path / name
    path.write_text(json.dumps({"meta": META, "facilities": filings}))
    return str(path)


NAMED = [
    filing(1, "Americold Logistics, LLC", lb=50_000), filing(2, "Americold", state="NJ", lb=60_000),
    filing(3, "AmeriCold Realty", state="TX", compact=True, allAccidentsCount=2),
    filing(4, "Sodus Cold Storage Co., Inc.", state="NY", lb=60_000),
    filing(5, "Perdue Farms, Inc."), filing(6, "Perdue Farms Incorporated"),
    filing(7, "Suzanna's Kitchen, Inc.", state="GA"), filing(8, "Suzanna's Kitchen II", state="FL"),
    filing(9, "Suzanna's Kitchen III", state="GA"),
    filing(10, None, "Christopher Hawk", "Penske Logistics, LLC", lb=120_000),
    filing(11, None, "George Calhoon", "Magic Valley Fresh Frozen, Inc. (Military)"),
    filing(12, None, "Ann Smith", "Magic Valley Fresh Frozen, Inc. (Trophy)"),
    filing(13, "NA"), filing(14, "Not applicable"), filing(15, None, None, None),
    filing(16, "Tiny Storage", lb=10_000), filing(17, "Closed Foods", isDeregistered=True),
    filing(18, "Joseph Cold Storage #1", lb=55_000), filing(19, "Nowhere Foods", state=None),
    filing(20, "Nowhere Foods", state=None),
]


def cold(spark, path):
    return P.run_registry(registry_filings(spark, path), COLD)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    return cold(spark, land(tmp_path_factory.mktemp("snap"), NAMED))


def test_accounts(run):
    got = {r["account"]: r for r in run.accounts.collect()}
    assert set(got) == {"Americold Realty Trust", "Perdue Farms", "Suzannas Kitchen", "Penske Logistics",
                        "Magic Valley Fresh Frozen", "Nowhere Foods"}
    a = got["Americold Realty Trust"]
    assert (a["sites"], a["charge_lb"], a["states"], a["state_list"], a["primary_rto"]) == (3, 130_000, 3, "NJ,PA,TX", "PJM")
    assert a["is_customer"] and a["accidents"] == 2 and a["sites_with_accidents"] == 1
    assert (got["Suzannas Kitchen"]["sites"], got["Suzannas Kitchen"]["primary_rto"]) == (3, "SERC")
    assert got["Nowhere Foods"]["state_list"] == "" and got["Nowhere Foods"]["primary_rto"] == "Other"
    assert got["Magic Valley Fresh Frozen"]["sites"] == 2
    assert [r["rank"] for r in sorted(got.values(), key=lambda r: r["rank"])] == list(range(1, 7))


def test_ranks_break_ties_by_first_filing(run):
    order = [r["account"] for r in run.accounts.orderBy("rank").collect()]
    assert order == ["Americold Realty Trust", "Suzannas Kitchen", "Perdue Farms", "Magic Valley Fresh Frozen",
                     "Nowhere Foods", "Penske Logistics"]


def test_queue(run):
    q = run.review_queue
    assert dict(rows(queue_counts(q), "kind", "rows")) == {
        "unresolved_name": 3, "below_threshold": 2, "merge_rescue": 1, "operator_is_person": 3}
    rescue = q.filter("kind = 'merge_rescue'").first()
    assert rescue["reason"] == ("would have merged into United States Cold Storage, an existing CUSTOMER, and been "
                                "suppressed from outbound")
    assert rescue["account"] == "Sodus Cold Storage"
    small = {r["account"]: r["reason"] for r in q.filter("kind = 'below_threshold'").collect()}
    assert small["Joseph Cold Storage 1"] == "single site at 55000 lb, below the 100000 lb pilot floor"
    person = q.filter("kind = 'operator_is_person' and facility_id = '10'").first()
    assert person["reason"] == 'operator field "Christopher Hawk" looks like an individual, not a company'
    assert rows(run.below_queue_floor, "account") == [("Tiny Storage",)]


def test_no_person_is_an_account(run):
    names = {r["account"] for r in run.buckets.collect()}
    assert not names & {"George Calhoon", "Christopher Hawk", "Ann Smith"}


def test_nothing_is_lost(run):
    c = P.conservation(run).first()
    assert c["active"] == 19
    assert c["active"] == c["in_accounts"] + c["below_threshold"] + c["below_queue_floor"] + c["unresolved"]


def test_input_order_and_partitions_do_not_matter(spark, run, tmp_path):
    want = rows(run.accounts, "account", "sites", "charge_lb", "primary_rto", "primary_naics", "rank", "icp_score")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    filings = registry_filings(spark, land(tmp_path, NAMED))
    try:
        for parts in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            mixed = filings.repartition(parts, F.xxhash64("facility_id")).sortWithinPartitions(F.desc("ord"))
            again = P.run_registry(mixed, COLD)
            assert rows(again.accounts, "account", "sites", "charge_lb", "primary_rto", "primary_naics", "rank",
                        "icp_score") == want
            assert again.review_queue.count() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_site_number_chains_reach_the_first_name(spark, tmp_path):
    snap = [filing(1, "Stone Dairy 2 III"), filing(2, "Stone Dairy 2"), filing(3, "Stone Dairy"), filing(4, "Stone Dairy 2 III IV")]
    run = cold(spark, land(tmp_path, snap))
    assert rows(run.accounts, "account", "sites") == [("Stone Dairy", 4)]


def test_flagged_site_of_a_living_account(spark, tmp_path):
    snap = [filing(i, "Big Cold Co") for i in range(200)] + [filing(999, "Big Cold Co", lb=500_000_000)]
    run = cold(spark, land(tmp_path, snap))
    a = run.accounts.first()
    assert (a["sites"], a["charge_lb"], a["unvalidated_sites"]) == (201, 4_000_000, 1)
    q = run.review_queue.collect()
    assert [r["kind"] for r in q] == ["numeric_outlier"]
    assert q[0]["reason"] == (
        "ammonia_lb 500,000,000 exceeds p99 (20,000 lb) x 10; median is 20,000 lb. Probable units error or NAICS "
        "misclassification in the self-reported filing. Excluded from scoring pending human review.")


def test_below_threshold_quotes_a_validated_site(spark, tmp_path):
    snap = [filing(i, f"Other {chr(97 + i % 20)}{i // 20} Foods", lb=20_000) for i in range(200)]
    snap += [filing(900, "Pair Foods", lb=60_000), filing(901, "Pair Foods", lb=900_000_000)]
    run = cold(spark, land(tmp_path, snap))
    row = run.review_queue.filter("kind = 'below_threshold'").first()
    assert row["charge_lb"] == 60_000


def test_last_filing_wins_at_the_first_position(spark, tmp_path):
    snap = [filing(1, "Old Name Foods"), filing(2, "Other Foods"), filing(1, "New Name Foods", lb=7)]
    got = registry_filings(spark, land(tmp_path, snap)).orderBy("ord").collect()
    assert [(r["facility_id"], r["parent_name"], r["charge_lb"], r["ord"]) for r in got] == [
        ("1", "New Name Foods", 7, 0), ("2", "Other Foods", 20_000, 1)]


def test_charge_reads_both_shapes(spark, tmp_path):
    snap = [filing(1, lb=5), filing(2, lb=6, compact=True), {"facilityId": "3"},
            {"facilityId": "4", "chemicals": [{"chemicalId": 56, "quantity": None}, {"chemicalName": "AMMONIA", "quantity": 9}]}]
    got = dict(rows(normalise(read_snapshot(spark, land(tmp_path, snap))), "facility_id", "charge_lb"))
    assert got == {"1": 5, "2": 6, "3": 0, "4": 0}


def test_empty_snapshot_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_snapshot(spark, land(tmp_path, []))


def test_pages_report_a_shortfall(spark, tmp_path):
    for n, part in enumerate(([filing(1), filing(2)], [filing(3)], []), 1):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"page": n, "total": 5, "facilities": part}))
    filings, short = read_pages(spark, str(tmp_path))
    assert [r["facilityId"] for r in filings.orderBy("ord").collect()] == ["1", "2", "3"]
    s = short.first()
    assert (s["landed"], s["announced"], s["empty_pages"], s["kind"]) == (3, 5, 1, "degraded")


def test_water_pipeline(spark, tmp_path):
    def site(i, parent, name, cl, **kw):
        return {"facilityId": str(i), "parentCompanyName": parent, "facilityName": name, "state": kw.pop("state", "TX"),
                "naicsCode": "22132", "programLevel": kw.pop("level", 3),
                "chemicals": [{"chemicalId": 17, "chemicalName": "Chlorine", "quantity": cl}], **kw}

    snap = [site(1, "American Water", "Elm Water Plant", 50_000), site(2, "Pennsylvania American Water", "Oak WWTP", 12_000, state="PA"),
            site(3, "Koch Nitrogen Fertilizer", "Enid", 9), site(4, None, "City of Ardmore Water Works", 0, level=1),
            site(5, "Tiny Town", "Tiny Well", 5), site(6, "n/a", "Nameless", 3)]
    run = run_water(registry_filings(spark, land(tmp_path, snap)), WATER)
    got = {r["account"]: r for r in run.accounts.collect()}
    assert set(got) == {"American Water Utilities Holdings", "City of Ardmore Water Works"}
    a = got["American Water Utilities Holdings"]
    assert (a["est_peak_kw_total"], a["buffer_class"], a["states"], a["rank"]) == (4500, "mixed portfolio (per-station audit required)", 2, 1)
    assert a["icp"]["components"].asDict() == {"meter_size": 11, "price_exposure": 18, "sheddability": 8, "operating_signal": 0, "channel_fit": 10}
    kinds = dict(rows(queue_counts(run.review_queue), "kind", "rows"))
    assert kinds == {"process_exclusion": 1, "unresolved_name": 1, "below_threshold": 1}


# published account rows: sites, charge, states, grid, sites with accidents, code -> score
PUBLISHED = [(107, 2_724_270, 30, "PJM", 29, "49312", 100), (93, 2_603_994, 30, "PJM", 24, "49312", 100),
             (60, 973_818, 33, "PJM", 11, "42441", 94), (39, 1_903_105, 28, "PJM", 3, "49312", 97)]


def test_published_scores(spark):
    df = spark.createDataFrame([p[:6] for p in PUBLISHED], "s long, c long, st long, r string, a long, n string")
    got = df.select(M.cold_icp(*map(F.col, ("s", "c", "st", "r", "a", "n")))["score"]).collect()
    assert [r[0] for r in got] == [p[6] for p in PUBLISHED]


def test_sinks(spark, run, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError):
        sinks.write_registry(run, out, {"licence": "x"})
    sinks.write_registry(run, out, META)
    back = spark.read.csv(f"{out}/accounts_csv", header=True, quote='"', escape='"')
    assert tuple(back.columns) == sinks.ACCOUNT_COLUMNS
    first = back.filter("rank = 1").first()
    assert first["is_customer"] == "True"
    assert first["aliases"] == "AmeriCold Realty | Americold | Americold Logistics, LLC"
    queue = spark.read.csv(f"{out}/review_queue_csv", header=True, quote='"', escape='"')
    assert tuple(queue.columns) == sinks.QUEUE_COLUMNS and queue.count() == 9
    assert spark.read.json(f"{out}/seed/sites").count() == 13
    sinks.check_golden(back, back, ["account"])
    with pytest.raises(AssertionError):
        sinks.check_golden(back, back.filter("rank > 1"), ["account"])


def test_command_line(spark, tmp_path):
    from accountloom.__main__ import main

    snap = land(tmp_path, NAMED)
    main(["registry", "--from-json", snap, "--outdir", str(tmp_path / "dry"), "--dry-run"])
    assert not (tmp_path / "dry").exists()
    main(["registry", "--from-json", snap, "--outdir", str(tmp_path / "pa"), "--state", "PA"])
    rows_pa = spark.read.csv(str(tmp_path / "pa" / "accounts_csv"), header=True)
    assert {r["state_list"] for r in rows_pa.collect()} == {"PA"}

    wet = [{"facilityId": str(i), "parentCompanyName": f"Town {chr(97 + i)} Water District", "facilityName": "Elm Pump Station",
            "state": "TX", "naicsCode": "22131", "chemicals": [{"chemicalId": 17, "quantity": 50_000}]} for i in range(8)]
    wet.append({**wet[0], "facilityId": "food", "parentCompanyName": "A Food Plant", "naicsCode": "31161"})  # out of scope
    path = land(tmp_path, wet, "water.json")
    main(["water", "--from-json", path, "--outdir", str(tmp_path / "water")])
    written = spark.read.csv(str(tmp_path / "water" / "accounts_csv"), header=True)
    assert written.count() == 8 and {r["aliases"] for r in written.collect()} == {f"Town {chr(97 + i)} Water District" for i in range(8)}
    assert spark.read.csv(str(tmp_path / "water" / "sites_csv"), header=True).count() == 8
    assert spark.read.json(str(tmp_path / "water" / "seed" / "meta")).first()["licence"] == "CC BY-SA 4.0"
    for run, at in (("r1", "2026-01-01"), ("r2", "2026-02-01")):
        main(["triage", "--from-json", path, "--sidecar", str(tmp_path / "side"), "--snapshots", str(tmp_path / "snaps"),
              "--outdir", str(tmp_path / run), "--run", run, "--judged-at", at, "--mock", "--limit", "5"])
    triage_rows = spark.read.csv(str(tmp_path / "r2" / "triage_csv"), header=True).collect()
    targeted = [r for r in triage_rows if r["disposition"] != "not_targeted"]
    assert len(triage_rows) == 8 and len(targeted) == 5 and {r["note"] for r in targeted} == {"mock_source_no_lift"}


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from accountloom import session

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn", "applicationId": "a"})()

    with pytest.raises(ValueError):
        session.shared_folder(Spark())
    Spark.sparkContext.master = "local[2]"
    assert session.shared_folder(Spark()) == session.shared_folder(Spark())


def test_several_files_keep_one_order(spark, tmp_path):
    """The last file by name holds the last filing, whatever the number of partitions."""
    folder = tmp_path / "landed"
    folder.mkdir()
    land(folder, [filing("same", "First Parent"), filing("a", "A")], "1.json")
    land(folder, [filing("b", "B"), filing("same", "Second Parent")], "2.json")
    landed = read_snapshot(spark, str(folder))
    assert landed.select("ord").distinct().count() == landed.count() == 4
    for n in (1, 7):
        last = snapshots.keep_last_filing(landed.repartition(n)).filter("facilityId = 'same'").collect()
        assert [(r["parentCompanyName"], r["ord"]) for r in last] == [("Second Parent", 0)]


def test_filings_by_line_equal_the_envelope(spark, tmp_path):
    landed = read_snapshot(spark, land(tmp_path, NAMED))
    for form in ("json", "parquet"):
        landed.write.format(form).save(str(tmp_path / form))
        again = snapshots.read_landed(spark, str(tmp_path / form), form)
        assert sorted(map(str, normalise(again).collect())) == sorted(map(str, normalise(landed).collect()))
    assert [p["licence"] for p in snapshots.provenance_of(landed)] == ["CC BY-SA 4.0"]
    with pytest.raises(ValueError):
        snapshots.provenance_of(landed.withColumn("licence", F.lit(None).cast("string")))


def test_a_page_may_land_once(spark, tmp_path):
    for name in ("1.json", "2.json"):
        (tmp_path / name).write_text(json.dumps({"meta": META, "page": 1, "total": 2, "facilities": [filing(1)]}))
    with pytest.raises(ValueError):
        read_pages(spark, str(tmp_path))


def test_landed_filings_are_compressed_and_merge_to_the_last(spark, tmp_path, monkeypatch):
    from accountloom.plans.catalog import registry as C
    from accountloom.sources.driver_tables import filings
    from accountloom.streaming import events

    monkeypatch.setattr(events, "work_folder", lambda spark, label: str(tmp_path / label))
    got = C.landed_filings(spark, "/root/testdata/sf0.001")
    files = [f.name for f in (tmp_path / "landed").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    wanted = filings(spark, "/root/testdata/sf0.001").select("facility_id", "city")
    assert sorted(got.select("facility_id", "city").collect()) == sorted(wanted.collect())


def test_generated_code_of_the_site_step_is_small_enough_to_be_compiled(spark):
    from accountloom.plans.catalog.demo import COLD_DEMO
    from accountloom.sources.driver_tables import filings

    named = P.with_reported(P.active(filings(spark, "/root/testdata/sf0.001")), COLD_DEMO)
    sites = P.with_details(named).select(*P.SITE_COLUMNS, *P.SITE_DETAILS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # stages are planned when asked for
    try:
        stages = sites._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8000
