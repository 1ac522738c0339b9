"""Exact similarity self-join of small word sets, and groups of linked rows.

All words stand in one global order, rarest first.  Two sets of la >= lb words reach a
Jaccard similarity c only if they share ``need = ceil(c / (1 + c) * (la + lb))`` words,
and then the first word they share has at least ``need - 1`` shared words behind it in
both.  So a set is filed, for every size a partner may have, under its first
``own size - need + 1`` words only, and sets meet on (word, larger size, smaller size).
A word that all sets hold stands last in each of them and is filed only for partners
that it alone would make similar.  A pair that meets under several words is kept under
the first one, so each pair is verified once and no duplicates need removing.

Meant for names and titles: a set of n words is filed about n * n times at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.session import pin

_ROUNDING = 1e-9


def ordered_sets(sets: DataFrame, keep: Sequence[str], items: str) -> DataFrame:
    """``keep`` and ``items`` in the global order: rarest word first, ties by the word.

    Empty and null sets are left out; ``keep`` names each row.
    """
    spread = sets.select(*keep, F.explode(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("_word"))
    often = spread.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    ranked = spread.join(often, "_word").groupBy(*keep).agg(
        F.array_sort(F.collect_list(F.struct("_n", "_word"))).alias("_ranked"))
    return ranked.select(*keep, F.transform("_ranked", lambda r: r["_word"]).alias(items))


def similar_pairs(sets: DataFrame, name: str, items: str, cut: float, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, left, right, similarity``: every pair of sets with a Jaccard similarity of ``cut`` or more.

    ``name`` tells the rows of one value of ``keys`` apart; only rows with equal keys are
    compared.  ``left`` has the larger set, or the smaller name where the sizes are equal.
    Rows with a null key or name, and empty sets, are in no pair.
    """
    if not 0 < cut <= 1:
        raise ValueError("cut lies above 0 and up to 1")
    own = F.size(items)
    rows = pin(ordered_sets(sets.dropna(subset=[*keys, name]), [*keys, name], items), "word-sets")

    def filed(low: Column, high: Column, side: str) -> DataFrame:
        sized = rows.withColumn("_other", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        need = F.ceil(F.lit(cut / (1 + cut)) * (own + F.col("_other")) - _ROUNDING).cast("int")
        first = sized.select("*", F.explode(F.slice(items, 1, own - need + 1)).alias("_word"))
        larger, smaller = (own, F.col("_other")) if side == "left" else (F.col("_other"), own)
        return first.select(*keys, "_word", larger.alias("_la"), smaller.alias("_lb"),
                            F.col(name).alias(side), F.col(items).alias(f"_{side}"))

    left = filed(F.greatest(F.lit(1), F.ceil(own * cut - _ROUNDING)), own, "left")
    right = filed(own, F.floor(own / cut + _ROUNDING), "right")
    met = left.join(right, [*keys, "_word", "_la", "_lb"]).filter(
        (F.col("_la") > F.col("_lb")) | (F.col("left") < F.col("right")))
    common = F.array_intersect("_left", "_right")
    union = F.col("_la") + F.col("_lb") - F.size(common)
    return (met.withColumn("similarity", F.size(common) / union)
            .filter((F.col("similarity") >= cut) & (common[0] == F.col("_word")))
            .select(*keys, "left", "right", "similarity"))


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Nodes may be of any type with an order; nulls and loops are ignored, repeated edges
    count once.  Every node holds the least node it knows of.  A round takes the least
    among the neighbours' and then the one that this one holds, so what a node knows
    reaches twice as far each time; it ends when a round changes nothing.  A node with
    most of the edges is one row per task in the group-by.  Rounds are written to the
    shared folder.
    """
    a, b = F.col(left), F.col(right)
    one_way = edges.filter(a != b).select(a.alias("node"), b.alias("near"))
    both = pin(one_way.unionByName(one_way.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(),
               "edges")
    held = pin(both.groupBy("node").agg(F.min("near").alias("near")).select(
        "node", F.least("node", "near").alias("component")), "components")
    while True:
        heard = both.join(held.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(
            F.min("component").alias("heard"))
        lower = held.join(heard, "node").select("node", F.col("component").alias("before"),
                                                F.least("component", "heard").alias("component"))
        jump = held.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = pin(lower.join(jump, "component", "left").select(
            "node", "before", F.least("component", "further").alias("component")), "components")
        held = moved.select("node", "component")
        if moved.filter("before != component").isEmpty():
            return held
