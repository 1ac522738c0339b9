"""Hard negatives of anchors by slot-decomposed selection.

Each anchor's best rows of its own label, its positives, come first.  A positive with score
p admits negatives whose scores lie between fixed shares of p, so the windows of an anchor's
positives overlap.  Their upper limits, in descending order, cut the scores into disjoint
slots: slot i holds the scores up to limit i and above the next limit.  Every block of rows
keeps the best ``top`` negatives per slot (the combiner), a group-by keeps the best of
those, and the slots from i downwards, one behind the other, are the best negatives up to
limit i.  One list answers all windows; each drops what lies below its own lower limit.

Anchors and rows stand in blocks of bounded size, and a block of anchors meets a block of
rows in one group.  Neither side is whole anywhere, and no score leaves its task unless it
is among the best of its block.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part.  Components become ``floor(scale * x)``, x as a double; a shorter
vector counts as if zeros followed.  Sums are exact, and one outside the range of long
counts as the end of that range (vectors with components beyond about 2 ** 23 take a slower,
equally exact way).  A row with the anchor's own id is never its positive.  Repeated rows
count each time, and an anchor that stands twice answers twice.  Equal scores stand by id.
An anchor without positives, a positive with a negative score (its window is empty) and an
empty table give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm.frames import worker_path
from accountloom.session import pin

ANCHOR_VALUES = 1 << 17  # components in a block of anchors: 1 MB
ROW_VALUES = 1 << 20     # components in a block of rows: 8 MB
SCORE_CELLS = 1 << 22    # scores held at a time: 32 MB
EXACT = 1 << 52          # below it whole sums are exact in doubles
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

POSITIVE = "anchor long, anchor_id long, id long, score long"
NEGATIVE = "anchor long, slot int, id long, score long"

# p percent of a score, rounded down or up, without leaving the range of long
_SHARE_DOWN = "(score - pmod(score, 100)) div 100 * {p} + ({p} * pmod(score, 100)) div 100"
_SHARE_UP = "(score - pmod(score, 100)) div 100 * {p} + ({p} * pmod(score, 100) + 99) div 100"


def _dense(table: pa.Table) -> np.ndarray:
    """The vectors of a group as whole-number doubles, padded with zeros to one width."""
    vectors = table.column("v").combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dense = np.zeros((len(lengths), int(lengths.max(initial=0))))
    dense[np.arange(dense.shape[1]) < lengths[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
    return np.nan_to_num(dense)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows, kept inside the range of long."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    limit = math.isqrt(EXACT // max(width, 1))
    big = [np.abs(m).max(axis=1, initial=0) > limit for m in (a, b)]
    scores = np.zeros((len(a), len(b)), np.int64)
    if not big[0].any() and not big[1].any():
        return (a @ b.T).astype(np.int64)
    scores[np.ix_(~big[0], ~big[1])] = a[~big[0]] @ b[~big[1]].T

    def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = (np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
                       for m in (left, right))
        return np.clip(left @ right.T, LONG_MIN, LONG_MAX).astype(np.int64) if left.size and right.size else 0

    scores[big[0]] = exact(a[big[0]], b)
    scores[np.ix_(~big[0], big[1])] = exact(a[~big[0]], b[big[1]])
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best: higher scores first, then smaller ids."""
    near = np.arange(len(scores))
    if len(scores) > top:  # the top-th score and all that reach it
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    return near[np.lexsort((ids[near], ~scores[near]))][:top]


def _scored(anchors: pa.Table, rows: pa.Table):
    """Scores of each anchor against the rows of a group, a few anchors at a time."""
    a, b = _dense(anchors), _dense(rows)
    step = max(1, SCORE_CELLS // max(len(b), 1))
    for low in range(0, len(a), step):
        yield from zip(range(low, len(a)), inner_products(a[low:low + step], b))


def _positives(top: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "anchor_id": [], "id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
            number, name, label = (anchors.column(c).to_pylist() for c in ("anchor", "id", "label"))
            for i, scores in _scored(anchors, rows):
                own = np.flatnonzero((labels == label[i]) & (ids != name[i]))
                best = own[_best(scores[own], ids[own], top)]
                out["anchor"] += [number[i]] * len(best)
                out["anchor_id"] += [name[i]] * len(best)
                out["id"] += ids[best].tolist()
                out["score"] += scores[best].tolist()
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    return run


def _negatives(top: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "slot": [], "id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
            number, label, limits, lowest = (anchors.column(c).to_pylist()
                                             for c in ("anchor", "label", "limits", "lowest"))
            for i, scores in _scored(anchors, rows):
                other = np.flatnonzero((labels != label[i]) & (scores <= limits[i][0]) & (scores >= lowest[i]))
                # slot 0 has the highest scores; a score on a limit belongs to that limit's slot
                slots = np.searchsorted(np.array(limits[i][::-1]), scores[other], "left")
                for slot in range(len(limits[i])):
                    place = other[slots == len(limits[i]) - 1 - slot]
                    best = place[_best(scores[place], ids[place], top)]
                    out["anchor"] += [number[i]] * len(best)
                    out["slot"] += [slot] * len(best)
                    out["id"] += ids[best].tolist()
                    out["score"] += scores[best].tolist()
        return pa.table(out, pa.schema([(c, pa.int32() if c == "slot" else pa.int64()) for c in out]))

    return run


def _usable(rows: DataFrame, anchor: Column, scale: float) -> DataFrame:
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    vector = F.col("embedding").cast("array<double>")
    return (rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                        vector.alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
            .filter("id is not null and label is not null and v is not null").filter(~F.exists("v", bad))
            .withColumn("v", F.transform("v", lambda x: x * scale)))


def mine_hard_negatives(rows: DataFrame, anchor: Column, *, positives: int = 5, top: int = 10, low: int = 30,
                        high: int = 90, scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, embedding``.  For every row where ``anchor`` holds and each of
    its first ``positives`` rows of the same label, the first ``top`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are percentages, low first")
    worker_path(rows.sparkSession)
    held = pin(_usable(rows, anchor, scale).withColumn("number", F.monotonically_increasing_id()), "vectors")
    size = held.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0)).alias("n"),
                    F.coalesce(F.sum(F.when(F.col("is_anchor"), F.size("v") + 1)), F.lit(0)).alias("a")).collect()[0]
    row_blocks, anchor_blocks = max(1, math.ceil(size["n"] / ROW_VALUES)), max(1, math.ceil(size["a"] / ANCHOR_VALUES))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # neighbours in a file get consecutive numbers, so blocks are even whatever ids and vectors repeat
    block_of = F.xxhash64("number")
    dealt = held.select("id", "label", "v", F.pmod(block_of, F.lit(row_blocks)).cast("int").alias("row_block"),
                        every(anchor_blocks).alias("anchor_block"))
    asked = pin(held.filter("is_anchor").select(
        F.col("number").alias("anchor"), "id", "label", "v",
        F.pmod(block_of, F.lit(anchor_blocks)).cast("int").alias("anchor_block")), "anchors")
    keys = ["anchor_block", "row_block"]

    def meet(anchors: DataFrame, fn, schema: str) -> DataFrame:
        spread = anchors.withColumn("row_block", every(row_blocks))
        return spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(fn, schema)

    def first(table: DataFrame, by: list[str], count: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
        return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)

    chosen = pin(first(meet(asked, _positives(positives), POSITIVE), ["anchor"], positives)
                 .withColumn("upper", F.expr(_SHARE_DOWN.format(p=high)))
                 .withColumn("lower", F.expr(_SHARE_UP.format(p=low))), "positives")
    slots = chosen.groupBy("anchor").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("limits"),
                                         F.min("lower").alias("lowest"))
    best = first(meet(asked.join(slots, "anchor"), _negatives(top), NEGATIVE), ["anchor", "slot"], top)
    lists = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "score", "id"))).alias("down"))
    answers = (chosen.join(slots, "anchor").join(lists, "anchor")
               .withColumn("slot", F.array_position("limits", F.col("upper")) - 1)
               .withColumn("suffix", F.slice(F.filter("down", lambda x: x["slot"] >= F.col("slot")), 1, top))
               .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                       F.posexplode(F.filter("suffix", lambda x: x["score"] >= F.col("lower"))).alias("at", "hit")))
    return answers.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                          F.col("hit.id").alias("negative_id"), "positive_score",
                          F.col("hit.score").alias("negative_score"))

