"""Slices, samples and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def ranged(items: Column, start: int, stop: int, most: int = 12) -> Column:
    """Items start to stop (exclusive), from 0; the range is checked before a plan is built."""
    if not 0 <= start < stop or stop - start > most:
        raise ValueError("the range is empty, reversed or too long")
    return F.slice(items, start + 1, stop - start)


def stride_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at equal strides of the order by ``key``; positions r count from 1.

    Positions come from range-partitioned ranks, so that no task sorts the whole table.
    """
    ordered = numbered(df, key)
    total = df.agg(F.count("*").alias("n"))
    picks = total.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("n") / float(n)) + 1)).alias("r")).distinct()
    return ordered.join(F.broadcast(picks), "r", "left_semi").select(key, "r")  # n picks


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds r: the position from 1 in the order of a unique key; null keys come first.

    Rows are sorted in range partitions and written with their place in them, as a range
    partitioning made anew would have other borders; the partitions' sizes give the rest.
    """
    place = F.monotonically_increasing_id()  # the partition above 33 bits, the place below
    parts = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("m_", place)
    parts = written(parts.withColumns({"p_": F.shiftright("m_", 33), "i_": F.col("m_").bitwiseAND(F.lit((1 << 33) - 1))}).drop("m_"), "numbered")
    sizes = parts.groupBy("p_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("p_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return parts.join(F.broadcast(starts), "p_").withColumn("r", F.col("before_") + F.col("i_") + 1).drop("p_", "i_", "before_")


def hash_ordered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A reproducible random order: by sha256 of seed and key."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)


def greedy_fit(sizes: Column, budget: int) -> Column:
    """struct(used, kept): items in order, each taken if it still fits (skipping, not stopping)."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))
    return F.aggregate(sizes, start, lambda s, x: F.struct(
        F.when(s["used"] + x <= budget, s["used"] + x).otherwise(s["used"]).alias("used"), F.array_append(s["kept"], s["used"] + x <= budget).alias("kept")))


def next_fit(sizes: Column, most_items: int, most_tokens: int) -> Column:
    """struct(batches, n, t): items in order into the open batch, or a new one if it is full."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("batches"), zero.alias("n"), zero.alias("t"))

    def step(s, x):
        fits = (s["batches"] > 0) & (s["n"] < most_items) & (s["t"] + x <= most_tokens)
        return F.struct(
            F.when(fits, s["batches"]).otherwise(s["batches"] + 1).alias("batches"), F.when(fits, s["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"),
            F.when(fits, s["t"] + x).otherwise(x).alias("t"))

    return F.aggregate(sizes, start, step)


def tail_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest rows of each group within a budget; the newest one always."""
    newest = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"used_": F.sum(size).over(newest), "r_": F.count("*").over(newest)}).filter((F.col("used_") <= budget) | (F.col("r_") == 1)).drop("used_", "r_")


def newest_groups(df: DataFrame, key: str, order: str, opens: str, size: str, budget: int) -> DataFrame:
    """As ``tail_budget``, but whole groups go or stay; a row with ``opens`` starts a group."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("g_", F.sum(F.col(opens).cast("int")).over(upto))
    kept = tail_budget(rows.groupBy(key, "g_").agg(F.sum(size).alias("n_")), key, "g_", "n_", budget)
    return rows.join(kept.select(key, "g_"), [key, "g_"], "left_semi").drop("g_")
