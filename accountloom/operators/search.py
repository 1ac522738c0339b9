"""Text search over any tables through an inverted index in Parquet.

``build_index`` files every row under its terms, the stretches of its lower-cased text
without white space.  Postings lie in ``buckets`` folders by hash of the term and are
sorted by term, kind and key inside, so Parquet keeps terms run-length encoded and keys
as deltas, and its statistics lead to the row groups of a term.  A second, much smaller
table holds every term once with the number of its postings.

``search`` looks a word up in the terms, reads only the folders of the terms that hold
it, and intersects the words' postings, rarest word first.  It finds the rows whose text
contains every word, whatever the case, as a scan of the texts would.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "term string, kind string, key string, bucket int"
TERMS = "term string, n long, bucket int"
BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def searchable(rows: DataFrame, kind: str, key: str, text: Column) -> DataFrame:
    """Rows of one table in the shape that an index takes: ``kind, key, text``."""
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), text.alias("text"))


def build_index(rows: Sequence[DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Index ``searchable`` rows under ``path``; rows without a key or text are in no posting.

    A term of most rows is spread over all tasks while it is sorted, by its kind and key.
    """
    every = reduce(DataFrame.unionByName, rows).filter("key is not null and text is not null")
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""))
    postings = (every.select("kind", "key", F.explode(terms).alias("term")).distinct()
                .withColumn("bucket", _bucket(F.col("term"), buckets)))
    (postings.repartitionByRange("bucket", "term", "kind", "key").sortWithinPartitions("bucket", "term", "kind", "key")
     .write.partitionBy("bucket").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary#key", "false").parquet(f"{path}/postings"))
    written = rows[0].sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    written.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("n")).select("term", "n", "bucket").write.parquet(
        f"{path}/terms")


def search(spark: SparkSession, path: str, words: Sequence[str], kinds: Sequence[str] | None = None) -> DataFrame:
    """``kind, key`` of the indexed rows whose text contains every word.

    A word is any text without white space, as it may stand inside a term; one with white
    space is refused.  Without words nothing is asked, and nothing found.
    """
    if any(not w or len(w.split()) != 1 or w != w.strip() for w in words):
        raise ValueError("a word holds no white space")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").select("term", "kind", "key", "bucket")
    if kinds is not None:
        postings = postings.filter(F.col("kind").isin(*kinds))
    found = []
    for word in sorted({w.lower() for w in words}):
        terms = spark.read.schema(TERMS).parquet(f"{path}/terms").filter(F.contains("term", F.lit(word)))
        # one row per folder at most
        places = terms.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        hit = postings.filter(F.col("bucket").isin(*[r["bucket"] for r in places])).join(
            terms.select("term"), "term", "left_semi").select("kind", "key")
        found.append((sum(r["n"] for r in places), word, hit))
    if not found:
        return postings.select("kind", "key").limit(0)
    rarest, *others = [hit for _, _, hit in sorted(found, key=lambda f: f[:2])]
    return reduce(lambda a, b: a.join(b, ["kind", "key"], "left_semi"), others, rarest.distinct())
