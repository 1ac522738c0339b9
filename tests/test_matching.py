"""Fuzzy matching against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.operators import matching as M


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def similar(a, b):
    return a == b or 1 - levenshtein(a, b) / max(len(a), len(b)) >= R.TYPO_SIMILARITY


def sets(name):
    words = dict.fromkeys(w for w in name.lower().split() if len(w) > 1 and w not in ("inc", "llc"))
    d = [w for w in words if w not in R.GENERIC_TOKENS and len(w) > 2]
    return d, [w for w in d if len(w) >= 5 and w not in R.WEAK_TOKENS]


def score(a, b):
    (da, sa), (db, sb) = sets(a), sets(b)
    if not da or not db:
        return None
    exact = sum(x in db for x in da)
    typo = sum(x not in db and len(x) >= 5 and any(len(y) >= 5 and similar(x, y) for y in db) for x in da)
    strong = sum(any(similar(x, y) for y in sb) for x in sa)
    ratio = (exact + typo * 0.85) / min(len(da), len(db))
    return min(0.99, R.MATCH_SCORE + ratio * 0.37) if strong and ratio >= R.MATCH_RATIO else None


def brute(inputs, candidates, keep):
    out = {}
    for a in set(inputs):
        hits = sorted((-s, b) for b in set(candidates) if (s := score(a, b)) is not None)
        for place, (s, b) in enumerate(hits[:keep], 1):
            out[a, place] = (b, round(-s, 9))
    return out


def ours(spark, inputs, candidates, keep, **sizes):
    a = spark.createDataFrame([(x,) for x in inputs], "n string")
    b = spark.createDataFrame([(x,) for x in candidates], "c string")
    return {(r.input, r.place): (r.candidate, round(r.score, 9))
            for r in M.best_matches(a, "n", b, "c", keep=keep, **sizes).collect()}


def random_names(rng, n):
    stock = ["acme", "harbour", "harbor", "northgate", "northgates", "sysco", "united", "cold", "storage", "depot",
             "refrigeration", "refrigeratoin", "internationalisation", "internationalization", "westfield", "wesfield",
             "kinsbury", "kingsbury", "foods", "zed", "prime", "primes", "counterrevolutionaries", "counterrevolutionarys"]
    return [" ".join(rng.choice(stock) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 6]))) for _ in range(n)]


@pytest.mark.parametrize("page", [1, 4, M.PAGE])
def test_best_matches_equal_brute_force(spark, page):
    rng = random.Random(page)
    inputs, candidates = random_names(rng, 80), random_names(rng, 80)
    assert ours(spark, inputs, candidates, 2, page=page) == brute(inputs, candidates, 2)


@pytest.mark.parametrize("page", [2, M.PAGE])
def test_short_inputs_against_long_candidates(spark, page):
    rng = random.Random(4)
    words = [f"tok{c}word" for c in "abcdefghijklmnopqrstuvwx"]
    long = [" ".join(rng.sample(words, 12)) for _ in range(40)]
    short = words[:8] + ["tokaword tokbwort", "tokcword zonedline", "nothing"]
    assert ours(spark, short, long + words[:3], 2, page=page) == brute(short, long + words[:3], 2)
    assert ours(spark, long[:6], short, 2, page=page) == brute(long[:6], short, 2)


def test_names_with_many_tokens(spark):
    rng = random.Random(9)
    words = [f"tok{c}word" for c in "abcdefghijklmnopqrstuvwx"] + [f"zone{c}line" for c in "abcdefgh"]
    many = [" ".join(rng.sample(words, k)) for k in (9, 10, 13, 14, 15, 9, 12)]
    few = [" ".join(rng.sample(words, k)) for k in (1, 2, 3, 2, 4, 5, 6)]
    names = many + few
    assert ours(spark, names, names, 3) == brute(names, names, 3)


def test_hot_token_does_not_pair_everything(spark):
    """A third of all names share one strong token; every input still gets its two best."""
    names = [f"Depot {i:04d}x" for i in range(300)] + [f"Plain{chr(97 + i % 26)}{chr(97 + i // 26)} Works" for i in range(300)]
    got = ours(spark, names[:20], names, 2)
    assert all(got[n, 1] == (n, 0.99) for n in names[:20])
    assert all(got[n, 2][0] == ("Depot 0000x" if n != "Depot 0000x" else "Depot 0001x") for n in names[:20])


def test_dense_numbers_are_not_all_scored(spark):
    """Names of dense numbers share one misspelt token with very many; only pairs that may pass are scored."""
    rng = random.Random(11)
    names = [f"Depot {1_000_007 + 200 * rng.randrange(300)} {2_000_000 + rng.randrange(300)} {300 + k % 60}" for k in range(400)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    inputs, candidates = M.token_sets(df, "n", "input"), M.token_sets(df, "n", "candidate")
    near = M.similar_tokens(M._vocabulary(inputs, "input_d"), M._vocabulary(candidates, "candidate_d"))
    assert M._through_lists(inputs, candidates, near, 2, M.PAGE).count() <= 15 * len(names) < near.count()
    assert ours(spark, names[:60], names, 2) == brute(names[:60], names, 2)
    assert ours(spark, names[:60], names, 3, page=2) == brute(names[:60], names, 3)


def test_matches_are_searched_once(spark):
    """Best and runner-up come out of one search."""
    df = spark.createDataFrame([("Kingsbury East",), ("Kingsbury West",)], "n string")
    plan = M.resolve_fuzzy(df, "n", df, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_edit_budget():
    assert [M.edits_allowed(n) for n in (6, 7, 12, 13, 18, 19, 24, 25)] == [0, 1, 1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("a,b", [
    ("warehouses", "wearhouses"), ("internationalisation", "internationalization"),
    ("counterrevolutionaries", "counterevolutionarys"), ("aaaaaaaaaaaaaaaaaaa", "baaaaaaaaaaaaaaaaaab")])
def test_similar_tokens_are_found_both_ways(spark, a, b):
    left = spark.createDataFrame([(a,), (b,), ("unrelated",)], "token string")
    got = {tuple(r) for r in M.similar_tokens(left, left).collect()}
    assert ({(a, b), (b, a)} if similar(a, b) else set()) == got


def test_dense_numbers_meet_only_numbers_that_are_one_edit_apart(spark):
    words = [str(1_000_000 + 7 * k) for k in range(300)] + ["10000071", "100007", "aabbccdd", "aabccdd", "abbccdd", "aabbccd"]
    left = spark.createDataFrame([(w,) for w in words], "token string")
    want = {(a, b) for a in words for b in words if a != b and 7 <= max(len(a), len(b)) and levenshtein(a, b) == 1}
    assert {tuple(r) for r in M.similar_tokens(left, left).collect()} == want
    met = M._one_edit_apart(left.toDF("x"), left.toDF("y")).filter("x <> y")
    assert {tuple(r) for r in met.collect()} == want and met.count() <= 2 * len(want)


CASES = [("VersaCold Logistics", "Americold Logistics", False), ("Sysco Charlotte, LLC", "Sysco Corporation", True),
         ("United Global Foods", "United Natural Foods Inc.", False), ("Penske Logistics", "VersaCold Logistics", False),
         ("Vertical Cold Storage", "Sodus Cold Storage", False)]


@pytest.mark.parametrize("a,b,ok", CASES)
def test_named_pairs(spark, a, b, ok):
    row = M.score_pairs(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first()
    assert row["acceptable"] is ok
    if not ok:
        assert row["strong_shared"] == 0 or row["ratio"] < 0.5


def test_ambiguous_names_show_both_candidates(spark):
    a = spark.createDataFrame([("Kingsbury Provisions",), ("Nobody Knows",)], "n string")
    b = spark.createDataFrame([("Kingsbury East",), ("Kingsbury West",)], "c string")
    got = {r["n"]: r for r in M.resolve_fuzzy(a, "n", b, "c").collect()}
    assert got["Kingsbury Provisions"]["status"] == "ambiguous"
    assert got["Kingsbury Provisions"]["runner_up"] == "Kingsbury West"
    assert got["Nobody Knows"]["status"] == "none"


def test_suppression_needs_positive_evidence(spark):
    names = ["Americold Realty Trust", "AMERICOLD REALTY", "VersaCold Logistics", "Americald Realty Trust", "Amaricold Reilty Trest"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    customers = spark.createDataFrame([("Americold Realty Trust",), (None,)], "c string")
    got = {r["n"]: r["decision"] for r in M.suppress_customers(df, "n", customers, "c", 0.6).collect()}
    assert got["Americold Realty Trust"] == "suppressed_exact"
    assert got["AMERICOLD REALTY"] == "suppressed_distinctive"
    assert got["VersaCold Logistics"] == "kept"
    assert got["Amaricold Reilty Trest"] == "queued_fuzzy"


def test_suppression_against_many_customers(spark):
    """More customers than fit one block: the same decisions as the pair by pair rule."""
    rng = random.Random(8)
    customers, names = random_names(rng, 150), random_names(rng, 60) + [None, "", "acme inc", "harbour nrthgate zed"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    table = spark.createDataFrame([(c,) for c in customers], "c string")
    got = sorted((r["n"] or "", r["decision"]) for r in M.suppress_customers(df, "n", table, "c", 0.75, block=16).collect())
    pairs = df.distinct().crossJoin(table.distinct())
    scored = M.score_pairs(pairs, "n", "c").selectExpr("n", "acceptable", "loose", "c").collect()
    keys = {r["n"]: r["k"] for r in df.union(table).distinct().select("n", M.match_key(F.col("n")).alias("k")).collect()}
    want = []
    for n in names:
        mine = [r for r in scored if r["n"] == n and n is not None]
        want.append((n or "", "suppressed_exact" if any(keys[r["c"]] == keys[n] for r in mine)
                     else "suppressed_distinctive" if any(r["acceptable"] for r in mine)
                     else "queued_fuzzy" if any(r["loose"] >= 0.75 for r in mine) else "kept"))
    assert got == sorted(want) and len({d for _, d in got}) == 4


def test_reconcile_people(spark):
    a = spark.createDataFrame([(1, "CFO"), (2, "CEO"), (3, "COO")], "id int, title string")
    b = spark.createDataFrame([(1, " cfo"), (2, "Chair"), (4, "VP")], "id int, title string")
    got = {r["id"]: r["outcome"] for r in M.reconcile_people(a, b, ["id"], "title").collect()}
    assert got == {1: "corroborated", 2: "conflict", 3: "left_only", 4: "right_only"}
