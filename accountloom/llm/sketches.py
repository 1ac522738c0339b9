"""Bottom-k sketches of shingle hashes, in built-in expressions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's word
shingles.  Sketches of parts merge into the sketch of the whole, and two of them give
estimates of resemblance, containment and the number of distinct shingles.

Defined results: a null text is an empty text; a text without words has the empty
sketch, which resembles another empty one fully and anything else not at all; a text
with fewer words than a shingle is one shingle; equal texts have equal sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.operators.ordering import global_rank

K = 128
WORDS = 5


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` smallest distinct hashes of all shingles of ``words`` words, ascending."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.transform(F.sequence(F.lit(0), n - words),
                            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        short = F.array(F.xxhash64(h))
        return F.when(n >= words, whole).when(n > 0, short).otherwise(F.expr("cast(array() as array<bigint>)"))

    # a one-element transform names the array once, so that it is not computed per use
    made = F.transform(F.array(hashes), shingles)[0]
    return F.slice(F.sort_array(F.array_distinct(made)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shingles that two texts have in common, 0 to 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    highest = (F.element_at(a, k).cast("double") + F.lit(2.0 ** 63) + 1) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / highest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, keys: Sequence[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its rows, however many: only ``k`` hashes meet."""
    parts = df.select(*keys, F.explode(column).alias("_h")).distinct()
    least = Window.partitionBy(*keys).orderBy("_h")
    return (parts.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k)
            .groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column)))


def to_text(a: Column) -> Column:
    """A sketch as text: its hashes, eight bytes each, in base 64."""
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.base64(F.unhex(digits))


def from_text(a: Column) -> Column:
    digits = F.hex(F.unbase64(a))
    numbers = F.transform(F.sequence(F.lit(0), (F.length(digits) / 16).cast("int") - 1), lambda i: F.conv(
        F.substring(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    return F.when(digits == "", F.expr("cast(array() as array<bigint>)")).otherwise(numbers)


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Sketches of every text and of a copy whose last quarter is the start of the next document.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The next document has the next larger id (after the
    last: the smallest); of rows that share that id, the one with the least text hash.
    Only ids, lengths and hashes are ranked; a text moves once, and its head once more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = rows.groupBy("doc_id").agg(F.max(quarter).alias("need"), F.min(F.xxhash64("text")).alias("pick"),
                                     F.count(F.lit(1)).alias("rows"))
    ranked = global_rank(ids, [F.col("doc_id")])
    sizes = ranked.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).collect()[0]
    here = ranked.select(F.col("doc_id").alias("asker"), "need", (F.col("rank") % max(sizes["n"], 1) + 1).alias("rank"))
    asks = here.join(ranked.select("doc_id", "pick", "rank"), "rank").select(
        F.col("doc_id").alias("giver"), "asker", "need", "pick")

    sketched = rows.select("doc_id", "text", sketch(F.col("text"), k, words).alias("own"))
    heads = sketched.join(asks, F.col("doc_id").eqNullSafe(F.col("giver")))
    if (sizes["most"] or 0) > 1:
        heads = heads.filter(F.xxhash64("text") == F.col("pick")).dropDuplicates(["asker"])
    heads = heads.select("asker", F.expr("substring(text, 1, need)").alias("head"), F.col("own").alias("next"))
    n, q = F.length("text"), quarter
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"),
                      F.substring("head", F.lit(1), q))
    both = (sketched.join(heads, F.col("doc_id").eqNullSafe(F.col("asker")))
            .select("doc_id", n.cast("long").alias("n_chars"), "own", "next", edited.alias("edited")))
    done = both.select("doc_id", "n_chars", "own", "next", F.sha2("edited", 256).alias("edited_sha256"),
                       F.inline(F.array(F.struct(sketch(F.col("edited"), k, words).alias("after")))))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("own")).alias("fingerprint"),
        to_text(F.col("after")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("after"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"))
