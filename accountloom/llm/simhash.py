"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint of one or more 64-bit words is cut into segments with a radius each.
Two fingerprints within the distance agree, up to the radius, in some segment: always
if the radii plus one add up to more than the distance, else with a probability that
``segment_recall`` gives.  Segments beyond the fingerprint's width are cut from the same
bits in another order, which raises that probability.  Every distinct fingerprint is filed under its segment
values (the tables) and looks up the Hamming ball around them.  Table entries and
look-ups of one value stand together after a sort, the complete distance is verified
there, and a crowded bucket hands on only links that connect something new.

``similar_groups`` uses such links as candidates only: the texts behind each are compared
by the Jaccard similarity of their shingle sets before they make a group.  Where links were
left out, in crowded buckets and behind equal fingerprints, the groups found so far are then
compared in full.

Defined results: a null or blank text has fingerprint zero and links like any other;
a text with fewer words than a shingle is one shingle; equal fingerprints are one
node, so copies are never paired; rows that repeat an id get one result each; an
empty table gives an empty result; columns other than the id and the text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.llm.components import connected_components
from accountloom.llm.frames import map_arrow
from accountloom.session import compute_once, pin

SEED = 42
SEGMENTS = ((22, 1), (21, 1), (21, 0))  # (bits, radius): (1+1) + (1+1) + (0+1) = 4 + 1
WIDE_SEGMENTS = ((16, 1),) * 16  # 128 bits twice, the second time in another order
STRIDE = 9  # odd, so that every bit of a fingerprint comes once
BLOCK = 1 << 13
PAIRS = 1 << 19  # compared at once; more would take a large share of a worker's memory
BLOCK_SHINGLES = 1 << 20  # of either side of a block of the full comparison

# FIXED VALUES: multipliers that derive further words of a fingerprint from a shingle's hash
_STEP, _MIX_A, _MIX_B = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _word(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hash itself for word 0, an independent hash of it for the others."""
    if not number:
        return hashes
    z = hashes + _STEP * np.uint64(number)
    z = (z ^ (z >> np.uint64(30))) * _MIX_A
    z = (z ^ (z >> np.uint64(27))) * _MIX_B
    return z ^ (z >> np.uint64(31))


def text_fingerprint(text: str | None, words_per_shingle: int, width: int = 64, once: bool = False) -> list[int]:
    """SimHash of a whole text as 64-bit words; repeated shingles count again, or ``once``."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return [0] * (width // 64)
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends - 1)[min(words_per_shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros((width // 64, 64), np.int64)
    blocks = (np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low:low + BLOCK], stops[low:low + BLOCK])],
                       np.uint64) for low in range(0, n, BLOCK))
    if once:
        different = np.unique(np.concatenate(list(blocks)))
        n = len(different)
        blocks = (different[low:low + BLOCK] for low in range(0, n, BLOCK))
    for hashes in blocks:
        for k in range(width // 64):
            bits = np.unpackbits(_word(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            set_in[k] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(row * 2 > n).tobytes(), "big") for row in set_in]


def _names(width: int) -> list[str]:
    return [f"b{k}" for k in range(width // 64)]


def _fingerprints(words_per_shingle: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([text_fingerprint(t.as_py(), words_per_shingle, width) for t in batch.column("text")],
                              np.uint64).reshape(-1, width // 64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T)],
                names=["doc_id", *_names(width)])

    return run


def fingerprints(docs: DataFrame, words_per_shingle: int = 5, width: int = 64) -> DataFrame:
    """``doc_id, b0, ...``: the fingerprint of every whole text, as signed longs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(texts, _fingerprints(words_per_shingle, width),
                     ", ".join(["doc_id long", *(f"{n} long" for n in _names(width))]))


def segment_recall(differing: float, segments: Sequence[tuple[int, int]]) -> float:
    """Chance that fingerprints whose bits differ with probability ``differing`` share a segment."""
    miss = 1.0
    for width, radius in segments:
        miss *= 1 - sum(comb(width, r) * differing ** r * (1 - differing) ** (width - r) for r in range(radius + 1))
    return 1 - miss


def distance_for(similarity: float, width: int = 64, spread: float = 1.1) -> int:
    """Bits that texts with this Jaccard similarity differ in at most, ``spread`` deviations above the mean."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(width * share + spread * sqrt(width * share * (1 - share)))


def _rearranged(prints: np.ndarray) -> np.ndarray:
    """The same fingerprints with their bits in another order."""
    bits = np.unpackbits(np.ascontiguousarray(prints.T).astype(">u8").view(np.uint8).reshape(prints.shape[1], -1), axis=1)
    order = np.arange(bits.shape[1]) * STRIDE % bits.shape[1]
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").astype(np.uint64).T


def _segment(prints: np.ndarray, segments: Sequence[tuple[int, int]], number: int) -> np.ndarray:
    """Values of a segment; those beyond the fingerprint are of the rearranged bits."""
    word, shift = divmod(sum(w for w, _ in segments[:number]), 64)
    source = prints if word < len(prints) else _rearranged(prints)
    return (source[word % len(prints)] >> np.uint64(shift)) & np.uint64((1 << segments[number][0]) - 1)


def _entries(segments: Sequence[tuple[int, int]], names: Sequence[str]):
    """Table entries (even buckets) and look-ups (odd: the bucket below plus one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.stack([batch.column(n).to_numpy().view(np.uint64) for n in names])
            for low in range(0, prints.shape[1], BLOCK):
                part = prints[:, low:low + BLOCK]
                rows = np.arange(part.shape[1])
                buckets, owners = [], []
                for number, (width, radius) in enumerate(segments):
                    value = _segment(part, segments, number)
                    base = value * np.uint64(len(segments)) + np.uint64(number)
                    buckets.append(base << np.uint64(1))
                    owners.append(rows)
                    for distance in range(1, radius + 1):
                        for flips in combinations(range(width), distance):
                            mask = np.uint64(sum(1 << f for f in flips))
                            # of two values that differ in these bits, one looks the other up
                            asks = value < (value ^ mask)
                            other = (value[asks] ^ mask) * np.uint64(len(segments)) + np.uint64(number)
                            buckets.append((other << np.uint64(1)) | np.uint64(1))
                            owners.append(rows[asks])
                owner = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(buckets).view(np.int64)),
                     *(pa.array(np.ascontiguousarray(part[k][owner]).view(np.int64)) for k in range(len(names)))],
                    names=["bucket", *names])

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int64)


def _crowded_links(prints: np.ndarray, distance: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket in which most rows are near each other: a least spanning forest and near neighbours.

    Links are ordered by distance, then by their fingerprints, so the forest is the only
    one: it joins what is joined at any distance up to ``distance``, holds the nearest
    neighbour of every row, and buckets that share rows tend to share its links.
    ``nearest`` more neighbours of every row are handed on as well.
    """
    prints = prints[:, np.lexsort(prints[::-1])]
    size = prints.shape[1]
    unseen, best, origin = np.arange(1, size), np.full(size - 1, np.iinfo(np.int64).max), np.zeros(size - 1, np.int64)
    left, right, at = [], [], 0
    for left_over in range(size - 1, -1, -1):
        if nearest:
            apart = _distance(prints, prints[:, at][:, None])
            apart[at] = distance + 1
            near = np.argpartition(apart, min(nearest, size - 1))[:nearest] if size > nearest else np.arange(size)
            near = near[apart[near] <= distance]
            left += [at] * len(near)
            right += near.tolist()
        if not left_over:
            break
        gap = _distance(prints[:, unseen], prints[:, at][:, None])
        weight = (gap * size + np.minimum(at, unseen)) * size + np.maximum(at, unseen)
        closer = weight < best
        best[closer], origin[closer] = weight[closer], at
        i = int(best.argmin())
        if best[i] // (size * size) <= distance:
            left.append(int(origin[i]))
            right.append(int(unseen[i]))
        at = int(unseen[i])
        for held in (unseen, best, origin):
            held[i] = held[left_over - 1]
        unseen, best, origin = unseen[:left_over - 1], best[:left_over - 1], origin[:left_over - 1]
    return prints[:, np.array(left, np.int64)], prints[:, np.array(right, np.int64)]


def _bucket_links(bucket: np.ndarray, prints: np.ndarray, distance: int,
                  nearest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within whole buckets, and which are of crowded ones; rows are sorted by bucket, table entries first.

    A crowded bucket, with more links than twice its rows, hands on a spanning forest and no other links.
    """
    key = bucket >> 1
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    tables = np.add.reduceat(((bucket & 1) == 0).astype(np.int64), start)
    group = np.repeat(np.arange(len(start)), size)
    # every row is compared with the table entries before it
    count = np.minimum(np.arange(len(key)) - start[group], tables[group])
    linked = [np.zeros((2, 0), np.int64)]
    links = np.zeros(len(start), np.int64)
    ends = np.cumsum(count)
    low = 0
    while low < len(key):
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        rows = np.arange(low, high)
        left = np.repeat(rows, count[low:high])
        right = np.arange(len(left)) + np.repeat(start[group[rows]] - (ends[low:high] - count[low:high] - done),
                                                 count[low:high])
        near = _distance(prints[:, left], prints[:, right]) <= distance
        left, right = left[near], right[near]
        owner = group[left]
        links += np.bincount(owner, minlength=len(start))
        keep = links[owner] <= 2 * size[owner]
        linked.append(np.stack((left[keep], right[keep])))
        low = high
    full = links > 2 * size
    left, right = np.concatenate(linked, axis=1)
    left, right = left[~full[group[left]]], right[~full[group[left]]]  # found before their bucket was full
    lefts, rights = [prints[:, left]], [prints[:, right]]
    for k in np.flatnonzero(full).tolist():
        a, b = _crowded_links(prints[:, start[k]:start[k] + size[k]], distance, nearest)
        lefts.append(a)
        rights.append(b)
    crowded = np.repeat(np.arange(len(lefts)) > 0, [part.shape[1] for part in lefts])
    return np.concatenate(lefts, axis=1), np.concatenate(rights, axis=1), crowded


def _links(distance: int, names: Sequence[str], nearest: int):
    def emit(bucket: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b, crowded = _bucket_links(bucket, prints, distance, nearest)
        columns = [np.ascontiguousarray(side[k]).view(np.int64) for side in (a, b) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(crowded)],
                                          names=[*(f"{side}_{n}" for side in ("u", "v") for n in names), "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket: list[np.ndarray] = []
        held_prints: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            prints = np.stack([batch.column(n).to_numpy().view(np.uint64) for n in names])
            cut = int(np.searchsorted(bucket >> 1, bucket[-1] >> 1))  # the last bucket may go on
            if cut or (held_bucket and held_bucket[-1][-1] >> 1 != bucket[-1] >> 1):
                yield emit(np.concatenate([*held_bucket, bucket[:cut]]),
                           np.concatenate([*held_prints, prints[:, :cut]], axis=1))
                held_bucket, held_prints = [], []
            held_bucket.append(bucket[cut:])
            held_prints.append(prints[:, cut:])
        if held_bucket:
            yield emit(np.concatenate(held_bucket), np.concatenate(held_prints, axis=1))

    return run


def _as_text(names: Sequence[str], prefix: str = "") -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(prefix + n)), 16, "0") for n in names])


def links(prints: DataFrame, distance: int = 4, segments: Sequence[tuple[int, int]] = SEGMENTS,
          nearest: int = 0) -> DataFrame:
    """``u, v, crowded``: links between distinct fingerprints, as hexadecimal text.

    A link is ``crowded`` if its bucket held more links than it hands on.
    """
    names = [c for c in prints.columns if c != "doc_id"]
    if sum(w for w, _ in segments) not in (64 * len(names), 128 * len(names)):
        raise ValueError("segments must cover the fingerprint")
    columns = ", ".join(f"{n} long" for n in names)
    entries = map_arrow(prints.select(*names).distinct(), _entries(segments, names), f"bucket long, {columns}")
    buckets = entries.repartition(F.shiftright("bucket", 1)).sortWithinPartitions("bucket")
    ends = ", ".join(f"{side}_{n} long" for side in ("u", "v") for n in names)
    return map_arrow(buckets, _links(distance, names, nearest), f"{ends}, crowded boolean").select(
        _as_text(names, "u_").alias("u"), _as_text(names, "v_").alias("v"), "crowded")


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = 5, distance: int = 4, width: int = 64,
                    segments: Sequence[tuple[int, int]] = SEGMENTS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; a component is its smallest id."""
    prints = pin(fingerprints(docs, words_per_shingle, width), "fingerprints")
    names = _names(width)
    groups = connected_components(links(prints, distance, segments))
    named = prints.select("doc_id", _as_text(names).alias("fingerprint"))
    first = named.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    joined = first.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = joined.join(least, "component").select("fingerprint", "component_id")
    return named.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _keyed(words_per_shingle: int, width: int):
    """Per row: a digest of its words, which equal word lists share, and the fingerprint of its distinct shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            prints = np.array([text_fingerprint(t, words_per_shingle, width, once=True) for t in texts],
                              np.uint64).reshape(-1, width // 64)
            nodes = [xxhash.xxh3_128_hexdigest(b" ".join((t or "").encode().lower().split())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.string()),
                 *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T)],
                names=["doc_id", "text_hash", "node", *_names(width)])

    return run


def shingle_set(text: Column, words: int) -> Column:
    """Hashes of the distinct shingles of the words that the fingerprint reads."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashes = F.transform(F.filter(F.split(lowered, r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - words),
                            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        return F.when(F.size(h) >= words, whole).otherwise(F.array(F.xxhash64(h)))

    return F.array_distinct(F.transform(F.array(hashes), shingles)[0])


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Elements and lengths of the sets of a block."""
    sets = table.column("x").combine_chunks()
    return sets.flatten().to_numpy(), sets.value_lengths().to_numpy()


def _missed(similarity: float):
    def run(asking: pa.Table, others: pa.Table) -> pa.Table:
        """Pairs of components of one block that hold similar texts, without those that others imply."""
        ends: list[tuple[int, int]] = []
        names, label = np.unique(np.concatenate([t.column("component").to_numpy() for t in (asking, others)]),
                                 return_inverse=True)
        if asking.num_rows and others.num_rows:
            mine, theirs = label[:asking.num_rows], label[asking.num_rows:]
            elements, size = _flat(others)
            known, place = np.unique(elements, return_inverse=True)
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            asked, asked_size = _flat(asking)
            found = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            held = known[found] == asked
            stop = np.cumsum(asked_size)
            marks, root = np.zeros(len(known), bool), np.arange(len(names))
            for row, (low, high) in enumerate(zip((stop - asked_size).tolist(), stop.tolist())):
                if (root[theirs] == root[mine[row]]).all():
                    continue
                own = found[low:high][held[low:high]]
                marks[own] = True
                shared = np.add.reduceat(marks[place], start, dtype=np.int64)
                marks[own] = False
                alike = shared >= similarity * (asked_size[row] + size - shared)
                for other in np.unique(theirs[alike]).tolist():
                    if root[other] != root[mine[row]]:
                        ends.append((int(mine[row]), other))
                        root[root == root[other]] = root[mine[row]]
        return pa.table({side: pa.array([names[e[k]] for e in ends], pa.string()) for k, side in enumerate("ab")})

    return run


def _missed_links(pairs: DataFrame, texts: DataFrame, groups: DataFrame, similarity: float, words: int) -> DataFrame:
    """``a, b``: further links between the ``groups`` found so far, which handed-on candidates have not shown.

    Of buckets that hand on a forest, and of texts behind one fingerprint, whatever could be
    a pair is connected by ``crowded`` candidates.  So within each of their components every
    text outside the largest group is compared with all texts of other groups, by the exact
    similarity, in blocks of about ``BLOCK_SHINGLES`` a side.
    """
    crowds = connected_components(pairs.filter("crowded"), "a", "b").withColumnRenamed("component", "crowd")
    members = crowds.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_group = members.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("n"))
    open_crowds = by_group.groupBy("crowd").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                                F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    sets = pin(compute_once(members.join(open_crowds, "crowd").join(texts, "node").select(
        "crowd", "node", "component", (F.col("component") != F.col("largest")).alias("asks"), "text"),
        x=shingle_set(F.col("text"), words)).drop("text"), "crowd-sets")
    size = F.size("x").cast("long")
    blocks = sets.groupBy("crowd").agg(
        F.ceil(F.sum(F.when(F.col("asks"), size)) / BLOCK_SHINGLES).alias("asking_blocks"),
        F.ceil(F.sum(size) / BLOCK_SHINGLES).alias("blocks"))
    placed = sets.join(blocks, "crowd")

    def block(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    key = ["crowd", "i", "j"]
    asking = placed.filter("asks").select("crowd", block("asking_blocks").alias("i"), every("blocks").alias("j"), "component", "x")
    others = placed.select("crowd", every("asking_blocks").alias("i"), block("blocks").alias("j"), "component", "x").toDF(
        *asking.columns)  # columns of their own
    return asking.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(_missed(similarity), "a string, b string")


def similar_groups(docs: DataFrame, *, similarity: float = 0.8, words_per_shingle: int = 5, width: int = 128,
                   segments: Sequence[tuple[int, int]] = WIDE_SEGMENTS, spread: float = 3.0,
                   nearest: int = 0) -> DataFrame:
    """``doc_id, text_hash, component`` for every row, ``text_hash`` being ``xxhash64(text)``.

    Texts are joined if the Jaccard similarity of their shingle sets is at least
    ``similarity``, directly or through others.  Fingerprints of distinct shingles only
    choose which texts are compared, one per list of words.  Crowded buckets hand on a
    forest and texts with one fingerprint the least of them; what this leaves out is
    compared by ``_missed_links``, so ``nearest`` changes how soon links are found, not which.
    """
    distance, names = distance_for(similarity, width, spread), _names(width)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = pin(map_arrow(keyed, _keyed(words_per_shingle, width), ", ".join(
        ["doc_id long, text_hash long, node string", *(f"{n} long" for n in names)])), "fingerprints")
    nodes = rows.groupBy("node", *names).agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    printed = nodes.select("node", _as_text(names).alias("fingerprint"))
    first = printed.groupBy("fingerprint").agg(F.min("node").alias("first"), (F.count(F.lit(1)) > 1).alias("many"))
    near = links(rows.select(*names), distance, segments, nearest).groupBy("u", "v").agg(F.max("crowded").alias("crowded"))
    ends = near.join(first.select(F.col("fingerprint").alias("u"), F.col("first").alias("a"), F.col("many").alias("more")), "u").join(
        first.select(F.col("fingerprint").alias("v"), F.col("first").alias("b"), "many"), "v").select(
        "a", "b", F.expr("crowded or more or many").alias("crowded"))
    same = printed.join(first, "fingerprint").filter("node <> first").select(
        F.col("first").alias("a"), F.col("node").alias("b"), F.lit(True).alias("crowded"))
    pairs = pin(ends.unionByName(same).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max("crowded").alias("crowded")), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select(
        "node", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"))
    texts = pin(keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["id"]) & (keyed["text_hash"] == wanted["hash"]))
                .select("node", "text").dropDuplicates(["node"]), "candidate-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    sets = compute_once(both.select("a", "b", "left", "right"), x=shingle_set(F.col("left"), words_per_shingle),
                        y=shingle_set(F.col("right"), words_per_shingle)).select("a", "b", "x", "y")
    shared = compute_once(sets, n=F.size(F.array_intersect("x", "y")), total=F.size("x") + F.size("y"))
    groups = connected_components(shared.filter(F.col("n") >= F.lit(similarity) * (F.col("total") - F.col("n")))
                                  .select("a", "b"), "a", "b")
    more = connected_components(_missed_links(pairs, texts, groups, similarity, words_per_shingle), "a", "b").select(
        F.col("node").alias("group"), F.col("component").alias("whole"))
    grouped = rows.select("doc_id", "text_hash", "node").join(groups, "node", "left").select(
        "doc_id", "text_hash", F.coalesce("component", "node").alias("group"))
    return grouped.join(more, "group", "left").select("doc_id", "text_hash", F.coalesce("whole", "group").alias("component"))
