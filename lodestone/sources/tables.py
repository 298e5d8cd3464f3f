"""The tables, and the roles that they play: recipes, chunks, vectors, cases, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Lines that one task gathers by order, so that its memory doesn't grow with the table.
LINES_A_TASK = 500_000


def tasks_for_lines(spark: SparkSession, folder: str) -> int | None:
    """How many tasks gather so many lines each; None where the session shuffles to as many anyway. Reads the files' footers."""
    tasks = -(-table(spark, folder, "lineitem").count() // LINES_A_TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order that has lines: dataset_id, source_id, title, minutes, servings, names.

    names holds the parts' names in line order, repeats kept; minutes has null, zero, negative
    and NaN values, as sources have.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    tasks = tasks_for_lines(spark, folder)
    if tasks:
        parts = parts.repartition(tasks, "p_partkey")
    named = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    if tasks:
        named = named.repartition(tasks, "l_orderkey")
    names = (
        named.groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("ls"))
        .select("l_orderkey", F.transform("ls", lambda s: s["p_name"]).alias("names"))
    )
    k = F.col("o_orderkey")
    minutes = (
        F.when(k % 11 == 0, F.lit(None).cast("double")).when(k % 13 == 0, 0.0).when(k % 17 == 0, -5.0)
        .when(k % 19 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("o_totalprice").cast("double") / 10) / 100)
    )
    orders = table(spark, folder, "orders")
    return orders.join(names, orders["o_orderkey"] == names["l_orderkey"]).select(
        F.col("o_orderpriority").alias("dataset_id"), F.lpad(k.cast("string"), 9, "0").alias("source_id"), k.alias("okey"),
        F.concat_ws(" ", F.lit("dish"), F.element_at("names", 1), F.lit("status"), "o_orderstatus").alias("title"),
        minutes.alias("minutes"), (k % 9).cast("double").alias("servings"), "names",
    )


#: The same as a common table expression ``recipes``.
RECIPES_SQL = """
recipe_lines AS (
  SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey, p_name) AS names
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
), recipes AS (
  SELECT o_orderpriority AS dataset_id, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS source_id, o_orderkey AS okey,
    'dish ' || names[1] || ' status ' || o_orderstatus AS title,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 17 = 0 THEN -5.0
      WHEN o_orderkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE floor(CAST(o_totalprice AS DOUBLE) / 10) / 100 END AS minutes,
    CAST(o_orderkey % 9 AS DOUBLE) AS servings, names
  FROM orders JOIN recipe_lines ON o_orderkey = l_orderkey
)"""


def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an append-only log: session_id, seq (from 1), event_type, k (payload), value, ts."""
    e = table(spark, folder, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("session_id"), F.row_number().over(order).cast("long").alias("seq"), "event_id", "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"), "value", "ts",
    )


SESSIONS_SQL = """
session_events AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, ts FROM events
)"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval cases: case_id and the distinct tokens (three at most) that open a benchmark text."""
    from ..functions.text import tokens

    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("case_id"), F.array_distinct(F.slice(tokens(F.col("text")), 1, 3)).alias("terms"),
    )


CASES_SQL = """
cases AS (
  SELECT item_id AS case_id, list_distinct(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 3)) AS terms,
    regexp_extract_all(lower(text), '[a-z0-9]+')[1] AS opener FROM benchmark
)"""


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Grades by document: 2 good and harmless, 1 good, else 0; documents without a row are unjudged."""
    return table(spark, folder, "labels").select(
        "doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0).alias("grade"),
    )


JUDGMENTS_SQL = """
judgments AS (
  SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM labels
)"""
