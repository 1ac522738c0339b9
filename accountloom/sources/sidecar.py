"""The judgment sidecar: an append-only table keyed by request hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.operators.ordering import latest_per_key
from accountloom.sources.commit_log import CommitLog

SCHEMA = """request_hash string, response_hash string, prompt_version string, model_version string,
source string, account string,
state struct<account:string,vertical_naics:string,states:string,site_count:bigint,
total_chlorine_lb:bigint,site_names_sample:array<string>,additional_sites_not_listed:bigint>,
answers struct<buffer_class:struct<score:double,probabilities:map<string,double>>,
process_continuous:double,regulated_utility:double>,
judgments struct<buffer_level_selected:int,buffer_level_top:int,buffer_p_top:double,
buffer_probabilities:map<string,double>,continuous_p_yes:double,regulated_p_yes:double>,
usage struct<input_tokens:bigint,output_tokens:bigint>, wall_ms bigint, judged_at string"""


def _log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, SCHEMA, "json")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Last row per request hash; a sidecar that does not exist yet is empty."""
    return latest_per_key(_log(spark, path).read(), ["request_hash"], [F.desc("judged_at"), F.desc("response_hash")])


def append_sidecar(rows: DataFrame, path: str) -> None:
    """Add the rows whose request has not been answered before, whoever else appends."""
    _log(rows.sparkSession, path).append(rows, ["request_hash"])
