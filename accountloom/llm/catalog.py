"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.llm import (chat, hard_negatives, html_blocks, language, language_model, packing, phrases, simhash,
                             sketches, sql, templates, token_files, toxicity, url_rules)
from accountloom.llm.frames import table
from accountloom.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op5_decontamination": sql.DECONTAMINATION, "op7_url_rules": sql.URL_RULES,
                       "op12_hard_negatives": sql.HARD_NEGATIVES, "op13_collocations": sql.COLLOCATIONS}

URL_RULES = (
    url_rules.UrlRule("allow", "com", "/"),
    url_rules.UrlRule("block", "example.com", "/en/"),
    url_rules.UrlRule("allow", "www.example.com", "/en/"),
    url_rules.UrlRule("block", "net", "/es/"),
    url_rules.UrlRule("block", "net", "/fr/"),
)


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def work_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/accountloom/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@_query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op2_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, folder, "pages"))


@_query
def op3_chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.sql(f"""select cast(-1 as bigint) conv_id, cast(turn as bigint) turn, role, '{control}' text
                      from values (0, 'user'), (1, 'assistant') as t(turn, role)"""))
    path = work_path(spark, "chat")
    chat.expand_conversations(rows).write.option("compression", "zstd").parquet(path)
    return chat.examples_digest(spark.read.schema(chat.EXAMPLES).parquet(path))


@_query
def op4_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_model.score_documents(docs, ~language.held_out(7, 2))


@_query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return templates.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "item_id", "matched", "windows", "verbatim", "slots_changed")


@_query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words_per_shingle=4, distance=4)


@_query
def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@_query
def op8_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, folder, "documents"))


@_query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = language.held_out(4, 2)
    model = language.fit(docs, ~fold)
    return language.predict(docs.select("doc_id", fold.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path)
    return token_files.token_file_digest(spark, path)


@_query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


@_query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@_query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = language.held_out(4, 2)
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~fold)
    return toxicity.score_texts(docs.select("doc_id", fold.alias("held_out"), "text"), model,
                                keep=("doc_id", "held_out"))
