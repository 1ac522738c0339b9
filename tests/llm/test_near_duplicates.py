import itertools
import random

import numpy as np
import xxhash
from accountloom.llm import components, simhash, sketches
from pyspark.sql import functions as F


def brute_print(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= distance:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for i in range(120)}
    base = [rng.choice(words) for _ in range(400)]
    for i in range(120, 200):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(400)] = rng.choice(words)
        rows[i] = " ".join(copy)
    rows |= {200: None, 201: "", 202: " \t\n", 203: "One two", 204: "one TWO", 205: "É é x y z"}
    return rows


def test_groups_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()],
                                 "doc_id long, text string, fingerprint string, component_id int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, words_per_shingle=4, distance=4).collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    want = brute_components(prints, 4)
    assert len(got) == len(rows)
    for i in rows:
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
        assert got[i]["component_id"] == want[i]


def test_links_of_planted_distances(spark):
    rng = random.Random(9)
    prints, base = {}, [rng.getrandbits(64) for _ in range(60)]
    for k, b in enumerate(base):
        prints[10 * k] = b
        for j in range(1, 8):
            other = b
            for bit in rng.sample(range(64), j):
                other ^= 1 << bit
            prints[10 * k + j] = other
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints.values()], "b0 long")
    found = {tuple(sorted((int(r["u"], 16), int(r["v"], 16)))) for r in simhash.links(frame, 4).collect()}
    graph = {}
    for u, v in found:
        assert bin(u ^ v).count("1") <= 4
    want = brute_components(dict(enumerate(prints.values())), 4)
    edges = spark.createDataFrame([(f"{u:016x}", f"{v:016x}") for u, v in found], "u string, v string")
    for r in components.connected_components(edges).collect():
        graph[int(r["node"], 16)] = int(r["component"], 16)
    values = list(prints.values())
    assert len({graph.get(v, v) for v in values}) == len({w for w in want.values()})


def all_components(prints, distance):
    """Components of a search from every fingerprint through all others."""
    label, unseen, number = np.full(len(prints), -1), np.arange(len(prints)), 0
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue:
            at = queue.pop()
            label[at] = number
            near = np.bitwise_count(prints[unseen] ^ prints[at]) <= distance
            queue += unseen[near].tolist()
            unseen = unseen[~near]
        number += 1
    return label


def test_crowded_bucket_gives_the_least_forest_and_near_neighbours():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 62, 30).astype(np.uint64)[:, None]
                       ^ (np.uint64(1) << rng.integers(0, 62, (30, 9)).astype(np.uint64)))
    rng.shuffle(prints)
    gap = {(a, b): bin(a ^ b).count("1") for a, b in itertools.combinations(sorted(prints.tolist()), 2)}
    root = {p: p for p in prints.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    forest = set()
    for (a, b), d in sorted(gap.items(), key=lambda e: (e[1], e[0])):
        if d <= 20 and find(a) != find(b):
            root[find(a)] = find(b)
            forest.add((a, b))
    left, right = simhash._crowded_links(prints[None, :], 20, 0)
    assert {tuple(sorted(e)) for e in zip(left[0].tolist(), right[0].tolist())} == forest
    left, right = simhash._crowded_links(prints[None, :], 20, 3)
    handed = {tuple(sorted(e)) for e in zip(left[0].tolist(), right[0].tolist())}
    assert forest <= handed and all(gap[e] <= 20 for e in handed)
    for p in prints.tolist():
        ranked = sorted(gap[tuple(sorted((p, q)))] for q in prints.tolist() if q != p)
        mine = sorted(gap[e] for e in handed if p in e)
        assert [d for d in ranked[:3] if d <= 20] == mine[:len([d for d in ranked[:3] if d <= 20])]


def test_crowded_buckets_hand_on_few_links_and_lose_no_connection(spark):
    """5,000 near copies: few links per fingerprint, and the same groups as all pairs give."""
    rng = np.random.default_rng(3)
    flips = np.uint64(1) << rng.integers(0, 64, (5000, 3)).astype(np.uint64)
    prints = np.unique(np.uint64(0xFFFF0000AAAA5555) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    prints = np.concatenate([prints, rng.integers(0, 1 << 62, 3000).astype(np.uint64)])
    links = simhash.links(spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "b0 long"), 4)
    found = links.distinct()
    assert found.count() < 8 * len(prints)
    label = all_components(prints, 4)
    got = {int(r["node"], 16): r["component"] for r in components.connected_components(found).collect()}
    groups = {}
    for p, k in zip(prints.tolist(), label.tolist()):
        groups.setdefault(k, set()).add(got.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(300)]
        other = list(base)
        for p in rng.sample(range(300), 4):  # resemblance of five-word shingles of about 0.87
            other[p] = rng.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(
        docs, width=128, distance=simhash.distance_for(0.8, 128), segments=simhash.WIDE_SEGMENTS).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(60)) >= 57
    assert len(set(got.values())) >= 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert sketches.edited_fingerprints(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (None, 1), (7, 6)]
    got = {r["node"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketch_estimates(spark):
    rng = random.Random(2)
    words = [f"u{i}" for i in range(500)]
    pairs = []
    for k in range(12):
        a = [rng.choice(words) for _ in range(800)]
        cut = int(800 * (1 - k / 12))
        pairs.append((k, " ".join(a), " ".join(a[:cut] + [rng.choice(words) for _ in range(800 - cut)])))
    pairs += [(50, "", ""), (51, None, "a b"), (52, "One two", "one TWO"), (53, "a b c d e f", "a b c d e f")]
    df = spark.createDataFrame(pairs, "k long, a string, b string").select(
        "k", sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    got = {r["k"]: r for r in df.select(
        "k", sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c"),
        sketches.distinct_shingles(F.col("a")).alias("n"), (sketches.from_text(sketches.to_text(F.col("a"))) == F.col("a"))
        .alias("same")).collect()}
    for k, a, b in pairs:
        x, y = shingles(a), shingles(b)
        assert abs(got[k]["r"] - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.15
        assert abs(got[k]["n"] - len(x)) <= 0.3 * len(x)
        assert abs(got[k]["c"] - (len(x & y) / len(x) if x else 1.0)) < 0.25
        assert got[k]["same"]


def test_sketches_of_parts_merge(spark):
    df = spark.createDataFrame([(1, [1, 5, 9]), (1, [2, 5]), (2, [])], "g long, s array<long>")
    got = {r["g"]: r["s"] for r in sketches.merge_groups(df, ["g"], "s", k=3).collect()}
    assert got == {1: [1, 2, 5]}
    merged = df.filter("g = 1").limit(1).select(sketches.merge(F.col("s"), F.lit([2, 5]).cast("array<long>"), 3)).collect()
    assert merged[0][0] == [1, 2, 5]


def test_edited_texts(spark):
    import hashlib

    rows = [(5, "abcdefgh 1 2 3"), (2, None), (9, "é" * 9), (30, "one two three four five six seven"), (31, "short"),
            (31, "short")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string")
    got = sketches.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    unique = dict(rows)
    order = sorted(unique)
    for r in got:
        text = unique[r["doc_id"]] or ""
        nxt = unique[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + nxt[:q]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"] == 1.0) >= (edited == text)
    same = [r["fingerprint"] for r in got if r["doc_id"] == 31]
    assert same[0] == same[1]


def test_pipeline_groups_are_verified_by_jaccard(spark):
    """Every pair from 0.8 on falls together, none below, though fingerprints of 0.6 to 0.8 are near as well."""
    rng = random.Random(12)
    words = [f"z{i}" for i in range(5000)]
    rows = []
    for k in range(150):
        base = [rng.choice(words) for _ in range(300)]
        other = list(base)
        for p in range(5, 5 + 20 * (k % 15 + 1), 20):  # each edit breaks five shingles
            other[p] = rng.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    line = " ".join(f"line{i}" for i in range(8))
    tails = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(2)]
    rows += [(1000, " ".join([line] * 400 + tails[:1])), (1001, " ".join([line] * 400 + tails[1:]))]  # unlike but for repeats
    got = {r["doc_id"]: r["component"] for r in
           simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_id = dict(rows)
    for a in range(0, 300, 2):
        x, y = shingles(by_id[a]), shingles(by_id[a + 1])
        assert (got[a] == got[a + 1]) == (len(x & y) >= 0.8 * len(x | y)), a
    assert got[1000] != got[1001]


def test_crowded_candidates_keep_every_similar_text(spark):
    """Hundreds of copies of one text in families: no family is lost to links that are not similar enough."""
    rng = random.Random(13)
    words = [f"y{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for family in range(40):
        head = list(base)
        for p in range(5 + family % 5, 300, 43):  # families resemble each other at 0.6 to 0.74
            head[p] = rng.choice(words)
        for member in range(10):
            copy = list(head)
            copy[rng.randrange(300)] = rng.choice(words)
            rows.append((10 * family + member, " ".join(copy)))
    got = {r["doc_id"]: r["component"] for r in
           simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if r == old else r for k, r in root.items()}
    assert len(set(root.values())) > 30
    assert len({(root[i], got[i]) for i in sets}) == len(set(root.values())) == len(set(got.values()))


def test_partners_in_a_crowded_group_stay_together(spark):
    """600 texts that resemble each other at about 0.63, each with one partner at 0.82."""
    rng = random.Random(21)
    words = [f"z{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for pair in range(300):
        head = list(base)
        for p in rng.sample(range(0, 300, 5), 7):
            head[p] = rng.choice(words)
        copy = list(head)
        for p in rng.sample(range(2, 300, 5), 6):
            copy[p] = rng.choice(words)
        rows += [(2 * pair, " ".join(head)), (2 * pair + 1, " ".join(copy))]
    sets = {i: shingles(t) for i, t in rows}
    partners = [k for k in range(300)
                if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    got = {r["doc_id"]: r["component"] for r in
           simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = sum(got[2 * k] == got[2 * k + 1] for k in partners)
    assert len(partners) > 100 and together >= 0.95 * len(partners)


def test_no_partner_in_a_crowded_group_is_lost(spark):
    """360 texts that are all alike at about 0.7, each with one partner at 0.8 or more: the groups of all pairs."""
    rng = random.Random(31)
    words = [f"q{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for pair in range(180):
        head = list(base)
        for p in rng.sample(range(0, 300, 5), 5):
            head[p] = rng.choice(words)
        copy = list(head)
        for p in rng.sample(range(2, 300, 5), 6):
            copy[p] = rng.choice(words)
        rows += [(2 * pair, " ".join(head)), (2 * pair + 1, " ".join(copy))]
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if r == old else r for k, r in root.items()}
    got = {r["doc_id"]: r["component"] for r in
           simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({(root[i], got[i]) for i in sets}) == len(set(root.values())) == len(set(got.values()))
    assert 1 < len(set(root.values())) < 180


def test_full_comparison_gives_one_link_per_joined_component():
    import pyarrow as pa

    def block(rows):
        return pa.table({"component": [c for c, _ in rows], "x": pa.array([x for _, x in rows], pa.list_(pa.int64()))})

    others = [("a", [1, 2, 3, 4]), ("a", [1, 2, 3, 4, 5]), ("b", [1, 2, 3, 4, 6]), ("c", [7, 8]), ("d", [9])]
    got = simhash._missed(0.8)(block([("b", [1, 2, 3, 4, 6]), ("c", [7, 8]), ("e", [9]), ("f", [99])]), block(others))
    assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist())) == [("b", "a"), ("e", "d")]
    assert simhash._missed(0.8)(block([]), block(others)).num_rows == 0
