"""The ``filings`` view over the star-schema tables, and readers for the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.operators.ordering import latest_per_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def landed_at(spark: SparkSession, folder: str) -> tuple[int, ...]:
    """When the tables behind the filings were last written: a run is reused only while these hold."""
    conf = spark._jsc.hadoopConfiguration()
    times = []
    for name in ("lineitem", "part", "supplier", "nation", "region"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        times.append(path.getFileSystem(conf).getFileStatus(path).getModificationTime())
    return tuple(times)


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def reported_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every reported line, repeats of a facility included."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")


def with_dimensions(line: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Join the dimensions without hints: Spark broadcasts a side only while its
    size is under the threshold."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))


def _pick(*cases, otherwise=None):
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def shape_filings(rows: DataFrame) -> DataFrame:
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    fid = F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_KEY])
    name = F.col("p_name")
    huge = F.when(order % 5000 == 1, 10_000).otherwise(1)
    charge = (F.col("l_quantity") * 1000).cast("long") * huge
    chlorine = F.when(n % 2 == 1, (F.col("l_quantity") * 2500).cast("long")
                      * F.when(order % 7000 == 2, 1000).otherwise(1)).otherwise(0)
    # four integer keys side by side: order-preserving, and fixed-width in a hash aggregate
    ordinal = F.concat((order * 10 + n).cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
                       F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).cast("decimal(38,0)")
    return rows.select(
        fid.alias("facility_id"), ordinal.alias("ord"),
        _pick((order % 200 == 7, F.concat(F.lit("Depot "), fid)),
              (order % 500 == 3, F.lit("N/A")),
              (n == 1, F.concat(name, F.lit(", Inc."))),
              (n == 2, F.concat(name, F.lit(" LLC"))),
              (n == 3, F.upper(name)),
              (n == 4, F.replace(name, F.lit(" "), F.lit("-"))),
              (n == 5, F.concat(name, F.lit(" III")))).alias("parent_name"),
        _pick((n == 6, F.initcap(name)),
              (n == 7, F.concat(name, F.lit(" Foods, Inc.")))).alias("operator_name"),
        F.concat(name, F.lit(" Works ("), F.col("n_name"), F.lit(")")).alias("facility_name"),
        F.col("s_name").alias("city"), F.col("n_name").alias("state"), F.col("r_name").alias("rto"),
        F.col("p_brand").alias("naics"), charge.alias("charge_lb"), chlorine.alias("chlorine_lb"),
        F.array(
            F.struct(F.lit(56).alias("id"), F.lit("Anhydrous ammonia").alias("name"),
                     charge.alias("quantity")),
            F.struct(F.lit(17).alias("id"), F.lit("Chlorine").alias("name"),
                     chlorine.alias("quantity"))).alias("chemicals"),
        (n % 3 + 1).alias("program_level"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("accidents"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 1).otherwise(0)
        .alias("recent_accidents"),
        (n % 4).cast("int").alias("submissions"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("is_deregistered"),
        F.col("l_shipdate").alias("filed_at"), F.col("l_extendedprice").alias("version_price"))


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """The view every registry query reads: one row per facility, last filing kept.

    Repeats are removed on the four integer keys, before any text is built."""
    lines = latest_per_key(reported_lines(spark, folder), LINE_KEY,
                           [F.desc("l_shipdate"), F.desc("l_extendedprice")])
    return shape_filings(with_dimensions(lines, spark, folder))


def all_filings(spark: SparkSession, folder: str) -> DataFrame:
    """The same view with repeats of a facility left in."""
    return shape_filings(with_dimensions(reported_lines(spark, folder), spark, folder))
