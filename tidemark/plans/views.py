"""The driver's tables seen as reads, genes and matrices: one definition for Spark and one in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that the event axis spans, and where it begins.
AXIS = 30 * 86_400
EPOCH_DAYS = 19_723


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Seconds since the axis began, the same in every session time zone."""
    t = F.col(ts)
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")) - EPOCH_DAYS
    return (day.cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60 + F.second(t)).cast("long")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as aligned reads: the type is the reference, the user the sample's cell, four experiments."""
    e = table(spark, sf_dir, "events")
    start = seconds("ts")
    return e.select(
        F.col("event_id").alias("name"), F.col("event_type").alias("chr"), start.alias("start"), (start + 60 + F.col("event_id") % 240).alias("end"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("event_id") % 61).cast("int").alias("mapq"), (1 + F.col("user_id") % 3).cast("int").alias("nh"),
        (F.col("event_id") % 5 != 0).alias("is_paired"), (F.col("event_id") % 11 == 0).alias("is_duplicate"), F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string")).alias("exp"), "user_id", "value",
    )


READS = """reads AS (
  SELECT event_id AS name, event_type AS chr, s AS start, s + 60 + event_id % 240 AS "end", CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
    (event_id % 61)::INTEGER AS mapq, (1 + user_id % 3)::INTEGER AS nh, event_id % 5 <> 0 AS is_paired, event_id % 11 = 0 AS is_duplicate, 'e' || (user_id % 4) AS exp, user_id, value
  FROM (SELECT *, epoch_us(ts) // 1000000 - 1704067200 AS s FROM events)
)"""

TYPES = ("click", "error", "purchase", "signup", "view")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as genes on the event axis."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") * 7_919 % AXIS
    return o.select(
        F.col("o_orderkey").alias("name"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("chr"), start.alias("start"),
        (start + 600 + F.col("o_orderkey") % 3_000).alias("end"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"), F.col("o_totalprice").alias("score"),
    )


GENES = f"""genes AS (
  SELECT o_orderkey AS name, ['click', 'error', 'purchase', 'signup', 'view'][(o_orderkey % 5 + 1)::INTEGER] AS chr, o_orderkey * 7919 % {AXIS} AS start,
    o_orderkey * 7919 % {AXIS} + 600 + o_orderkey % 3000 AS "end", CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand, o_totalprice AS score FROM orders
)"""


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the exons of their orders' genes: up to seven stretches of 100, 300 apart."""
    g = genes(spark, sf_dir).withColumnsRenamed({"start": "g_start", "end": "g_end"})
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("i")).distinct()
    start = F.col("g_start") + (F.col("i") - 1) * 300
    return g.join(n, "name").select("name", "chr", "strand", "i", start.alias("start"), (start + 100).alias("end"), "g_start", "g_end")


EXONS = """exons AS (
  SELECT name, chr, strand, i, start + (i - 1) * 300 AS start, start + (i - 1) * 300 + 100 AS "end", start AS g_start, "end" AS g_end
  FROM genes JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS i FROM lineitem) ON l_orderkey = name
)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by brand and ship mode in long form: ``row, col, value``."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = li.select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.concat_ws("/", "p_brand", "p_type").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("col")).agg(F.sum("l_quantity").alias("value"))


MATRIX = """matrix AS (
  SELECT p_brand || '/' || p_type AS row, l_returnflag || l_linestatus AS col, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
)"""


def references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, AXIS) for t in TYPES], "chr string, length long")


REFERENCES = f"refs AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS chr, {AXIS}::BIGINT AS length)"
