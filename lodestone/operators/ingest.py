"""Ingestion: strict scans, typed nested documents, quarantine, upserts and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from .joins import first_per

VERSION = "1"


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strict CSV, UTF-8 with or without mark: all columns as text, a missing column or an uneven row is an error."""
    head = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    head = [c.lstrip("﻿") for c in head]
    if missing := [c for c in columns if c not in head]:
        raise ValueError(f"columns {missing} are missing")
    schema = StructType([StructField(c, StringType()) for c in head])
    options = {"header": True, "multiLine": True, "mode": "FAILFAST", "enforceSchema": False, "escape": '"'}
    return spark.read.options(**options).schema(schema).csv(path).select(*columns)


def read_texts(spark: SparkSession, path: str, column: str = "texts") -> DataFrame:
    """One text column, rows numbered in file order from 1."""
    rows = read_csv(spark, path, [column]).withColumn("m_", F.monotonically_increasing_id())
    from .limits import numbered

    return numbered(rows, "m_").select(F.col("r").alias("row_number"), column)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines split at newlines only; a line that can't be read has null in ``record`` and its text in ``raw``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.filter(F.trim("value") != "").select(F.col("value").alias("raw"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("record"))


def write_dataset(df: DataFrame, path: str, dataset: str) -> None:
    """Replace the data sets that ``df`` holds, and no other: dynamic partition overwrite."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(dataset).parquet(path)


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with new ones in place of those of equal key."""
    union = stored.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return first_per(union, keys, [F.desc("new_")]).drop("new_")


def inserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those new ones whose key isn't there yet (do-nothing upsert)."""
    return stored.unionByName(new.join(stored, keys, "left_anti").select(*stored.columns))


def changed(stored: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """New rows that aren't stored with the same digest."""
    return new.join(stored.select(key, digest), [key, digest], "left_anti")


def rebuilt(df: DataFrame, column: str, expected) -> tuple[DataFrame, DataFrame]:
    """A derived column made anew, and a dry run's counts (checked, would_update)."""
    stale = ~F.col(column).eqNullSafe(expected)
    return df.withColumn(column, expected), df.agg(F.count("*").alias("checked"), F.count_if(stale).alias("would_update"))


def normalised(docs: DataFrame) -> DataFrame:
    """Documents as typed nested records with flags and a quarantine status."""
    t = F.col("text")
    steps = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    flags = F.array_compact(F.array(
        F.when(F.length(t) < 30, "too_short"), F.when(t.contains("|"), "list_layout"), F.when(t.rlike(r"[*#$%&]{3}"), "symbols"), F.when(t.rlike(T.EMAIL), "contact_data")))
    title = F.element_at(F.split(t, r"[.\n]"), 1)
    return docs.select(
        F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("source_id"),
        F.struct(
            T.collapsed(title).alias("title"), F.transform(steps, lambda s, i: F.struct((i + 1).alias("position"), s.alias("text"))).alias("instructions"), flags.alias("flags"),
            F.sha2(T.plain(t), 256).alias("content_hash"), F.lit(VERSION).alias("version")).alias("document"),
        F.when(F.array_contains(flags, "too_short"), "quarantined").when(F.array_contains(flags, "symbols"), "rejected").otherwise("accepted").alias("status"))


def report(docs: DataFrame) -> DataFrame:
    """Counts by status and flag."""
    return docs.select("status", F.explode_outer("document.flags").alias("flag")).groupBy("status", "flag").agg(F.count("*").alias("n"))
