"""Tiers as whole field sets, tenants, identity rules, gates, CSV and research rules."""

import pytest
from pyspark.sql import functions as F

from accountloom.operators import access as A
from accountloom.operators import gates as G
from accountloom.operators import identity as I
from accountloom.operators import research as X
from accountloom.sources.csv_files import detect_delimiter, read_csv

PERSON_T1 = {"name", "title", "role_in_deal", "confidence", "is_gap", "gap_reason", "resolution_path", "angle",
             "provenance", "as_of", "verified_at"}


@pytest.mark.parametrize("roles,owner,want", [
    (("rep",), False, PERSON_T1 | {"linkedin_url"}), (("rep",), True, PERSON_T1 | {"linkedin_url", "email", "phone"}),
    (("viewer",), True, set()), (("marketing",), False, PERSON_T1 | {"linkedin_url", "email", "phone"}),
    ((), True, set()), (("stranger",), True, set())])
def test_person_fields(roles, owner, want):
    assert set(A.visible_fields("person", A.Principal(1, roles), owner=owner)) == want


def test_account_fields():
    assert set(A.visible_fields("account", A.Principal(1, ("viewer",)))) == {"hq", "website", "ticker"}
    assert "is_customer" in A.visible_fields("account", A.Principal(1, ("admin",)))
    assert "is_customer" not in A.visible_fields("account", A.Principal(1, ("admin",)), for_export=True)
    assert A.visible_fields("account", A.Principal(1, ("admin",), is_active=False)) == []
    assert A.visible_fields("account", None) == []
    assert A.visible_fields("audit_log", A.Principal(1, ("sales_lead",))) == []


def test_permissions():
    assert A.can(("rep",), "capture.create") and not A.can(("rep",), "review.approve")
    assert not A.can(("admin",), "no.such") and len(A.permissions_for(("admin",))) == 18
    assert A.permissions_for(("viewer",)) == ["library.read", "library.search"]


def test_projection_omits_columns(spark):
    df = spark.createDataFrame([(1, "a", "e1", "x"), (2, "b", "e2", "y")], "id int, name string, email string, unmapped string")
    owned, others = A.project(df, "person", A.Principal(1, ("rep",)), ["id"], owner=F.col("id") == 1)
    assert owned.columns == ["id", "name", "email"] and others.columns == ["id", "name"]
    nothing, _ = A.project(df, "person", None, ["id"])
    assert nothing.count() == 0
    reads = A.pii_reads(owned, A.Principal(9, ("rep",)), "person", "id", "now").collect()
    assert [(r["user_id"], r["resource_id"], r["field"]) for r in reads] == [(9, "1", "email")]


def test_tenants(spark, tmp_path):
    df = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3)], "tenant_id string, v int")
    assert [A.tenant_scope(df, t).count() for t in ("t1", "t2", "t3", None)] == [2, 1, 0, 0]
    for tenant in ("t1", None):
        with pytest.raises(PermissionError):
            A.checked_write(df, str(tmp_path / "x"), tenant)
    A.checked_write(A.tenant_scope(df, "t1"), str(tmp_path / "x"), "t1")
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2


def test_drafts(spark):
    df = spark.createDataFrame([("draft", "d"), ("published", "p")], "status string, body string")
    shown, hidden = A.split_drafts(df, A.Principal(1, ("rep",)))
    assert [r["body"] for r in shown.collect()] == ["p"] and hidden.columns == ["status"]
    shown, hidden = A.split_drafts(df, A.Principal(1, ("marketing",)))
    assert shown.count() == 2 and hidden.count() == 0


def test_outbound(spark):
    df = spark.createDataFrame([(["rep"], True, True, 3), (["rep"], False, True, 3), (["marketing"], False, True, 2),
                                (["marketing"], False, False, 3), (["viewer"], True, True, 3), (None, True, True, 3)],
                               "r array<string>, o boolean, c boolean, k int")
    got = [r[0] for r in df.select(A.usable_for_outbound(F.col("r"), F.col("o"), F.col("c"), F.col("k"))).collect()]
    assert got == [True, False, False, False, False, False]


def test_offboarding_ends_everything_in_one_tenant(spark):
    """User 1 exists in both tenants and leaves the first; user 3 has nothing to end."""
    grants = spark.sql("select * from values ('a', 1, timestamp_ntz'2030-01-01'), ('a', 1, cast(null as timestamp_ntz)), "
                       "('a', 1, timestamp_ntz'2000-01-01'), ('b', 1, cast(null as timestamp_ntz)), "
                       "('a', 2, cast(null as timestamp_ntz)) t(tenant_id, user_id, expires_at)")
    pii = grants.withColumns({"person_id": F.lit(7), "field": F.lit("email")})
    sessions = spark.sql("select * from values ('a', 1, cast(null as timestamp_ntz)), ('b', 1, cast(null as timestamp_ntz)) "
                         "t(tenant_id, user_id, revoked_at)")
    users = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("a", 2, True), ("a", 3, True)],
                                  "tenant_id string, user_id int, is_active boolean")
    out = I.offboard(users, grants, pii, sessions, users.filter("tenant_id = 'a' and user_id in (1, 3)"), "2024-01-01 00:00:00")
    assert out.grants.count() == 5 and out.pii_grants.count() == 5
    assert {(r["tenant_id"], r["user_id"]) for r in out.users.filter("is_active").collect()} == {("b", 1), ("a", 2)}
    assert [r["tenant_id"] for r in out.sessions.filter("revoked_at is null").collect()] == ["b"]
    assert sorted(tuple(r) for r in out.counts.collect()) == [("a", 1, 2, 2, 1), ("a", 3, 0, 0, 0)]
    assert {(r["tenant_id"], r["user_id"], r["action"]) for r in out.audit.collect()} == {
        ("a", 1, "user.offboard"), ("a", 3, "user.offboard")}
    asked = users.select("tenant_id", "user_id").crossJoin(spark.sql("select 7 person_id, explode(array('email', 'phone')) field"))
    held = {(r["tenant_id"], r["user_id"]) for r in I.granted_fields(
        asked, out.pii_grants, out.users, "2024-01-02 00:00:00").filter("granted").collect()}
    assert held == {("b", 1), ("a", 2)}


def test_upsert_does_not_reactivate(spark):
    old = spark.createDataFrame([("t", "s1", "a@x", "A", "A", False)],
                                "tenant_id string, subject string, email string, display_name string, initials string, is_active boolean")
    new = spark.createDataFrame([("t", "s1", "b@x", "Bo Li"), ("t", "s2", "c@x", None)], "tenant_id string, subject string, email string, name string")
    got = {r["subject"]: r for r in I.upsert_users(old, new, "now").collect()}
    assert (got["s1"]["email"], got["s1"]["initials"], got["s1"]["is_active"], got["s1"]["created"]) == ("b@x", "BL", False, False)
    assert (got["s2"]["display_name"], got["s2"]["is_active"], got["s2"]["created"]) == ("c", True, True)


def test_roles_granted_by_hand_stay(spark):
    current = spark.createDataFrame([("a", 1, "rep", None), ("a", 1, "admin", "boss"), ("a", 1, "viewer", None), ("b", 1, "sales_lead", None)],
                                    "tenant_id string, user_id int, role string, granted_by string")
    members = spark.createDataFrame([("a", 1, "sales,unknown")], "tenant_id string, user_id int, groups string")
    desired = I.desired_roles(members, {"sales": ["rep", "sales_lead"]})
    assert sorted(tuple(r) for r in I.reconcile_roles(desired, current).select(
        "tenant_id", "user_id", "role", "action").collect()) == [
        ("a", 1, "sales_lead", "grant"), ("a", 1, "viewer", "revoke"), ("b", 1, "sales_lead", "revoke")]


def test_audit_only_appends(spark, tmp_path):
    for i in range(2):
        I.append_audit(spark.createDataFrame([(i,)], "v int"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_every_refusal_reaches_the_queue(spark):
    df = spark.createDataFrame([(1, "x", "a@b.co"), (2, "", "fine"), (3, None, "fine")], "id int, source string, text string")
    gated = G.quarantine(G.provenance(df, ["source"]), "text", {"email": r"\S+@\S+"})
    assert sorted((r["id"], r["gate"], r["status"]) for r in G.queue_rows(gated, "id").collect()) == [
        (1, "G2", "warn"), (2, "G0", "refuse"), (3, "G0", "refuse")]
    assert gated.filter("id = 1").first()["text"] is None
    assert [r["id"] for r in G.passed(gated).collect()] == [1]
    assert "a@b.co" not in str(G.queue_rows(gated, "id").collect())


def test_promotion_needs_independence(spark):
    facts = spark.createDataFrame(
        [(1, "a", "v", "s1", 2), (2, "a", "v", "s2", 3), (3, "a", "w", "s1", 2), (4, "b", "v", "s3", 2), (5, "b", "v", "s3", 3), (6, "a", "v", "s2", 2)],
        "id int, subject string, value string, source string, confidence int")
    got = {r["id"]: r["confidence"] for r in G.promote(facts, ["subject", "value"], "source").collect()}
    assert got == {1: 3, 2: 3, 3: 2, 4: 2, 5: 3, 6: 2}


def test_capture_without_url(spark):
    df = spark.createDataFrame([(3, "http://x"), (3, " "), (3, None), (1, "http://x")], "c int, u string")
    assert [r[0] for r in df.select(G.cap_without_url(F.col("c"), F.col("u"))).collect()] == [2, 1, 1, 1]


def test_only_anchored_tenure_is_clean(spark):
    text = spark.createDataFrame([("18 years across ammonia systems",), ("VP Ops, Jan 2019 - Present",)], "t string")
    fields = {"tenure": (r"([A-Z][a-z]{2} \d{4}) - Present", "clean", "observed"),
              "experience": (r"(\d+ years)", "inferred", "interpreted")}
    got = [r[0] for r in text.select(G.extract_fields(F.col("t"), fields)).collect()]
    assert set(got[0]) == {"experience"} and got[0]["experience"]["quality"] == "inferred"
    assert got[1]["tenure"]["value"] == "Jan 2019"


def test_field_mapping_knows_provider_names():
    synonyms = {"verification_date": ["Verified At"], "current_title": ["Job Title"], "company": ["Company Name"]}
    mapped, offered, missing = G.map_fields(["Verified At", "job_title", "COMPANY NAME", "Shoe Size"], synonyms, list(synonyms))
    assert missing == [] and offered == ["Shoe Size"] and mapped["current_title"] == "job_title"
    assert G.map_fields(["Company Name"], synonyms, ["verification_date"])[2] == ["verification_date"]


def test_classification_margin(spark):
    docs = spark.createDataFrame([(1, "Call notes: met with CFO. Next steps."), (2, "Market analysis, revenue and 10-K."),
                                  (3, "Call notes on revenue"), (4, "hello")], "id int, text string")
    from accountloom import refdata as R

    got = {r["id"]: r["document_class"] for r in G.classify_documents(docs, "text", R.RESEARCH_MARKERS, R.ACTIVITY_MARKERS, 0.3).collect()}
    assert got == {1: "activity_record", 2: "prior_research", 3: "mixed", 4: "unclassifiable"}


def test_csv(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text('Export of accounts;;\n\n Account Name ;Owner;Notes\nAcme;Bo;"two\nlines; and ""quotes"""\n;;\nShort\n')
    assert detect_delimiter(spark, str(path)) == ";"
    rows = read_csv(spark, str(path), header_words=("Account Name", "Owner")).collect()
    assert [r.asDict() for r in rows] == [
        {"Account Name": "Acme", "Owner": "Bo", "Notes": 'two\nlines; and "quotes"'},
        {"Account Name": "Short", "Owner": "", "Notes": ""}]


@pytest.mark.parametrize("line,sep", [("a,b;c,d", ","), ("\n\n a|b|c", "|"), ("a\tb", "\t"), ("plain", ","), ("a;b,c", ",")])
def test_delimiters(spark, line, sep):
    assert spark.createDataFrame([(line,)], "t string").select(G.delimiter(F.col("t"))).first()[0] == sep


def test_rejects_carry_their_row_number(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "c"), (4, None)], "line int, name string")
    valid, bad = G.reject_rows(df.repartition(3), [F.col("line")], {"name missing": F.trim("name") != ""})
    assert sorted(r["line"] for r in valid.collect()) == [1, 3]
    assert sorted((r["row_number"], r["reason"]) for r in bad.collect()) == [(2, "name missing"), (4, "name missing")]


def test_versions_of_one_hot_key(spark):
    df = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    chain = X.version_chain(df.repartition(8), ["k"], ["at"], ["v"]).orderBy("version").collect()
    assert [r["version"] for r in chain] == list(range(1, 501))
    assert chain[0]["changed"] == "" and {r["changed"] for r in chain[1:]} == {"v"}


def test_pain_rules(spark):
    pains = spark.createDataFrame([(1, 5, "Acme 2024"), (2, 5, "x 1"), (3, 5, "generic"), (4, 1, "y 2")], "id int, severity int, evidence string")
    links = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    got = {r["id"]: (r["final_severity"], r["rejected"]) for r in X.pain_severity(pains, links, "id", r"\d").collect()}
    assert got == {1: (5, False), 2: (4, False), 3: (2, True), 4: (1, False)}


def test_title_decay_and_third_states(spark):
    df = spark.sql("select * from values (1, 'A', false, cast(null as string), date'2024-01-01', 2), (2, null, true, 'why', null, 1), "
                   "(3, null, false, null, date'2024-06-01', 3), (4, 'B', true, null, date'2024-06-01', 3) t(id, name, is_gap, gap_reason, as_of, confidence)")
    assert sorted(r["id"] for r in X.third_states(df).collect()) == [3, 4]
    got = {r["id"]: r["confidence"] for r in X.title_decay(df, "as_of", "2024-07-15").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_portfolio_says_what_it_rests_on(spark):
    sites = spark.createDataFrame([("A", "r", 100, 1, True, 3), ("A", "r", 900, 0, False, 0), ("A", "s", 50, 1, True, 1),
                                   ("B", "r", 10, 0, True, None)],
                                  "account string, rto string, charge_lb long, accidents int, validated boolean, submissions int")
    got = {(r["account"], r["rto"]): r for r in X.portfolio(sites).collect()}
    a = got["A", None]
    assert (a["sites"], a["charge_lb"], a["submissions"], a["cadence"], a["replacement_sites"]) == (3, 150, 4, 2.0, 1)
    assert a["notes"] == "1 sites held below validation; 1 sites without a submission"
    assert got["A", "s"]["notes"] is None and got["B", None]["cadence"] is None and got[None, None]["sites"] == 4
