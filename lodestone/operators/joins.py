"""Join patterns: keep-latest, preferred rows, alignment, reconciliation, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given total order."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")


def embedding_join(embeddings: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of embeddings with what they describe; Spark picks the strategy."""
    return embeddings.join(owners, keys)


def left_with_version(left: DataFrame, right: DataFrame, keys: list[str], current: Column) -> DataFrame:
    """Left join whose version test is part of the join: rows never embedded stay."""
    return left.join(right.filter(current), keys, "left")


def survivors(df: DataFrame, condemned: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(condemned.select(*keys).distinct(), keys, "left_anti")


def fetch(df: DataFrame, wanted: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """Rows of the wanted exact keys; with ``default``, one row per source id, that data set first."""
    if default is None:
        return df.join(wanted, keys)
    found = df.join(wanted, "source_id")
    return first_per(found, ["source_id"], [F.col("dataset_id") != default, F.col("dataset_id")])


def aligned_lines(parsed: DataFrame, lines: DataFrame, doc: str = "doc", text: str = "text", pos: str = "pos") -> DataFrame:
    """Parsed lines with their source line: equal texts pair up in order, each line used once."""
    nth = F.row_number().over(Window.partitionBy(doc, text).orderBy(pos))
    left = parsed.withColumn("nth_", nth)
    right = lines.withColumn("nth_", nth).withColumnRenamed(pos, "line")
    return left.join(right.select(doc, text, "nth_", "line"), [doc, text, "nth_"], "left").drop("nth_")


def merged_answers(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str, cap: int = 200) -> DataFrame:
    """Incoming answers replace stored ones of the same key; more than ``cap`` per first key is an error."""
    out = stored.join(incoming.withColumnRenamed(value, "new_"), keys, "full").withColumn(value, F.coalesce("new_", value)).drop("new_")
    n = F.count("*").over(Window.partitionBy(keys[0]))
    return out.withColumn("n_", n).withColumn(value, F.when(F.col("n_") > cap, F.raise_error(F.lit("too many answers"))).otherwise(F.col(value))).drop("n_")


def nth_match(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on the left with the n-th of that key on the right, else nulls."""
    a = left.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "nth"], "left")


def pooled(lists: list[DataFrame], keys: list[str], rank: str = "rank", cap: int = 20) -> DataFrame:
    """Union of ranked lists per case: earlier lists first, first seen wins, ranked anew up to ``cap``.

    Each list has columns case_id, the keys and rank.
    """
    union = None
    for i, one in enumerate(lists):
        one = one.select("case_id", *keys, rank).withColumn("from_", F.lit(i))
        union = one if union is None else union.unionByName(one)
    first = first_per(union, ["case_id", *keys], [F.col("from_"), F.col(rank)])
    again = F.row_number().over(Window.partitionBy("case_id").orderBy("from_", rank, *keys))
    return first.withColumn("pool_rank", again).filter(F.col("pool_rank") <= cap).drop("from_", rank)


def reconciled(asked: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Asked ids against result rows (file, line, status): ok, failed, unknown, duplicate or missing.

    Of several results the first by (file, line) counts, the others are duplicates.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy("file", "line"))
    known = asked.select(key).distinct().withColumn("asked_", F.lit(True))
    return results.withColumn("nth_", nth).join(known, key, "full").select(
        key, "file", "line",
        F.when(F.col("file").isNull(), "missing").when(F.col("asked_").isNull(), "unknown").when(F.col("nth_") > 1, "duplicate")
        .when(F.col("status") == "ok", "ok").otherwise("failed").alias("outcome"))
