"""Aggregation, deduplication and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    """md5 of the columns as text, null marked apart from empty."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)).cast("binary"))


def table_fingerprint(df: DataFrame, key: list[str], columns: list[str], buckets: int = 256) -> DataFrame:
    """Order-sensitive fingerprint of a table in two steps: one digest per key bucket, then one of those.

    The bucket is taken from the first key's digest, so that no task gets the whole table.
    """
    h = df.select(*key, row_hash(*columns).alias("h"), F.pmod(F.conv(F.substring(F.md5(F.col(key[0]).cast("string").cast("binary")), 1, 4), 16, 10).cast("long"), F.lit(buckets)).alias("b"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda s: s["h"]), "")
    per = h.groupBy("b").agg(F.md5(joined(F.struct(*key, "h")).cast("binary")).alias("h"), F.count("*").alias("n"))
    return per.agg(F.md5(joined(F.struct("b", "h")).cast("binary")).alias("fingerprint"), F.sum("n").alias("n"))


def content_hash(*columns: Column) -> Column:
    """sha256 of the parts, each closed by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def exact_sources(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Alias map of equal raw texts: member, canonical (the least id), sha256, members."""
    sha = F.sha2(F.col(text_col), 256)
    groups = df.groupBy(F.col(text_col).alias("t_")).agg(F.min(id_col).alias("canonical"), F.count("*").alias("members"))
    return df.join(groups, df[text_col] == groups["t_"]).select(F.col(id_col).alias("member"), "canonical", sha.alias("sha256"), "members")


def duplicate_status(df: DataFrame, id_col: str, content: Column, order: list[str]) -> DataFrame:
    """A repeated id is quarantined (the first stays); repeated content is only flagged."""
    by_id = Window.partitionBy(id_col).orderBy(*order)
    out = df.withColumn("c_", content).withColumn("nth_", F.row_number().over(by_id))
    by_content = Window.partitionBy("c_", F.col("nth_") == 1).orderBy(*order)
    return out.withColumn(
        "status", F.when(F.col("nth_") > 1, "duplicate_id").when(F.row_number().over(by_content) > 1, "duplicate_content").otherwise("accepted")
    ).drop("c_", "nth_")


def first_seen(df: DataFrame, case: str, key: str, rank: str) -> DataFrame:
    """Order-preserving distinct: each key once per case at its best rank, ranked anew."""
    best = df.groupBy(case, key).agg(F.min(rank).alias(rank))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy(rank, key)))


def percentile(column: str, p: float) -> Column:
    """Exact percentile, interpolated linearly."""
    return F.percentile(column, p)
