"""Name rules, table by table."""

import pytest
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions import names as N

RULES = N.rules_of(R.COLD_RULES)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def resolved(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "reported string")
    return {r["reported"]: r for r in N.with_resolution(df, "reported", RULES).collect()}


SAME = [("Nor-Am Cold Storage", "NorAm Cold Storage"), ("Save-A-Lot", "Save A Lot Inc."),
        ("U.S. Foods, Inc.", "U. S. Foods, Inc."), ("Perdue Farms Incorporated", "Perdue Farms, Inc."),
        ("Wayne-Sanderson Farms", "Wayne Sanderson Farms LLC"), ("SCHWANS COMPANY", "Schwan's")]
DISTINCT = [("VersaCold Logistics", "Americold Logistics"), ("Koch Foods", "Dot Foods"),
            ("United Global Foods", "United Natural Foods")]


@pytest.mark.parametrize("a,b", SAME)
def test_one_company_one_key(spark, a, b):
    assert one(spark, a, N.match_key) == one(spark, b, N.match_key)


@pytest.mark.parametrize("a,b", DISTINCT)
def test_distinct_companies_keep_distinct_keys(spark, a, b):
    assert one(spark, a, N.match_key) != one(spark, b, N.match_key)


@pytest.mark.parametrize("raw,shown", [
    ("MDV/SpartanNash, LLC", "MDV SpartanNash"), ("U.S. Foods, Inc.", "US Foods"),
    ("Mar-Jac Poultry", "Mar Jac Poultry"), ("Boar's Head", "Boars Head"), ("Boar’s Head Co.", "Boars Head")])
def test_display_name(spark, raw, shown):
    assert one(spark, raw, N.display_name) == shown


CANONICAL = [
    ("Americold Logistics, LLC", "Americold Realty Trust"), ("Lineage  Jessup", "Lineage, Inc."),
    ("U.S. Foodservice, Inc.", "US Foods Holding Corp."), ("Performance Foodservice", "Performance Food Group"),
    ("The Kroger Company", "The Kroger Co."), ("Wal-Mart Stores, Inc.", "Walmart Inc."),
    ("Nestlé Prepared Foods", "Nestlé USA"), ("Pet Dairy", "Dairy Farmers of America"),
    ("Safeway Inc.", "Albertsons/Safeway"), ("US Cold Storage", "United States Cold Storage")]
NEVER = ["Sodus Cold Storage Co., Inc.", "Aldine Cold Storage", "WJBS Holdings", "Rinaldi Foods",
         "Garibaldi Packing", "Nestlerode Farms", "Tysons Corner Storage", "Baldinger Bakery",
         "Old Kroger Road Storage"]


def test_canonical_rules(spark):
    got = resolved(spark, [a for a, _ in CANONICAL])
    assert {a: got[a]["shown"] for a, _ in CANONICAL} == dict(CANONICAL)
    assert {r["resolved_by"] for r in got.values()} == {"rule"}


def test_rules_never_match_inside_a_word(spark):
    got = resolved(spark, NEVER)
    assert {r["resolved_by"] for r in got.values()} == {"fallback"}


def test_every_guarded_alternative_needs_a_boundary(spark):
    """Whole table: a rule text glued behind a letter matches nothing."""
    for rule in RULES:
        for alt in N.guard(rule.pattern).split("|"):
            assert alt.startswith(("^", "(?<![a-z0-9])")), alt


def test_junk_and_acronyms(spark):
    got = resolved(spark, ["NA", "N/A", "n a", "Not applicable", "  ", "-", "JDB, Inc.", "ACS-LLC", "Inc."])
    assert {k for k, r in got.items() if r["key"] is None} == {"NA", "N/A", "n a", "Not applicable", "  ", "-", "Inc."}
    assert got["JDB, Inc."]["key"] == "jdb" and got["ACS-LLC"]["key"] == "acs"


@pytest.mark.parametrize("name,person", [
    ("Byron C. Russell", True), ("Christopher Hawk", True), ("KOCH MEAT", False), ("SpartanNash Omaha", False),
    ("Penske Logistics", False), ("Gary Crowder", True), ("", False), (None, False)])
def test_person(spark, name, person):
    assert one(spark, name, N.looks_like_person) is person


@pytest.mark.parametrize("name,stem", [
    ("UNFI", None), ("Joseph Cold Storage #1", "Joseph Cold Storage"), ("Suzanna's Kitchen III", "Suzanna's Kitchen"),
    ("ADUSA Distribution LLC DC5", None), ("Cedar Grove Warehousing-Cedar Grove, WI", None), ("Plant 12", "Plant"),
    (None, None)])
def test_site_number_stem(spark, name, stem):
    assert one(spark, name, N.site_number_stem) == stem


@pytest.mark.parametrize("name,bare", [
    ("Magic Valley Fresh Frozen, Inc. (Military)", "Magic Valley Fresh Frozen, Inc."), ("(all)", "(all)"),
    ("A (b) C", "A (b) C"), (None, None)])
def test_site_qualifier(spark, name, bare):
    assert one(spark, name, N.strip_site_qualifier) == bare


def test_merge_rescue_compares_keys(spark):
    df = N.with_resolution(spark.createDataFrame(
        [("Sodus Cold Storage Co., Inc.",), ("SCHWANS COMPANY",), ("Americold",)], "reported string"), "reported", RULES)
    got = {r[0]: r[1] for r in df.select("reported", N.merge_rescue(F.col("reported"), F.col("key"), RULES)).collect()}
    assert got == {"Sodus Cold Storage Co., Inc.": "United States Cold Storage", "SCHWANS COMPANY": None, "Americold": None}


@pytest.mark.parametrize("name,letters", [("Madeline Belvin", "MB"), ("Cher", "C"), (" a  b  c ", "AC"), ("  ", None), (None, None)])
def test_initials(spark, name, letters):
    assert one(spark, name, N.initials) == letters


def test_groups(spark):
    assert one(spark, " sales, ,leads", N.read_groups) == ["sales", "leads"]
    assert one(spark, None, N.read_groups) == []


def test_water_rules_keep_their_grouped_alternatives(spark):
    rules = N.rules_of(R.WATER_RULES)
    df = spark.createDataFrame([("Metropolitan Water District of So. California",), ("PA-American Water Company",),
                                ("St Louis Board of Water",), ("Pan-american watering",)], "reported string")
    got = {r["reported"]: r["shown"] for r in N.with_resolution(df, "reported", rules, ()).collect()}
    assert got["Metropolitan Water District of So. California"] == "Metropolitan Water District of Southern California"
    assert got["PA-American Water Company"] == "American Water Utilities Holdings"
    assert got["St Louis Board of Water"] == "St. Louis Board of Water Supply"
    assert got["Pan-american watering"] == "Pan american watering"
