"""The document pipeline: language, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountloom.llm import language, packing, simhash, templates
from accountloom.llm.frames import fresh, table
from accountloom.session import pin


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject."""
    fold = language.held_out(4, 2)
    model = language.fit(docs, ~fold)
    return language.predict(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: the smallest id, then the least text hash.

    Rows without an id come last in their group.  Rows are told apart by id and text, so
    different texts under one id, or under none, stay unless they are near duplicates; of
    rows equal in both, the one whose columns have the least hash stays.
    """
    groups = simhash.similar_groups(docs, similarity=0.8, words_per_shingle=5)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("least")
    key, text, number = fresh(docs, "kept_id"), fresh(docs, "kept_text"), fresh(docs, "copy")
    kept = groups.groupBy("component").agg(least).select(
        F.col("least.doc_id").alias(key), F.col("least.text_hash").alias(text))
    one = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text)),
                    "left_semi")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*hashed))
    return one.withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).drop(number)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# tokenizers, hashes and centroids are out of SQL's reach
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
