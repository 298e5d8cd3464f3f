"""Offline evaluation of rankings against judgments, with honest denominators.

A ranking has case_id, doc_id, rank; judgments have doc_id (or case_id and doc_id) and grade.
Documents without a judgment are unjudged: they never count as grade 0 in a denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(ranking: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    return ranking.join(judgments.select(*keys, "grade"), keys, "left")


def recall_at(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per case with relevant documents: the share of them within rank k."""
    found = ranking.filter(F.col("rank") <= k).select("case_id", "doc_id", F.lit(1).alias("hit")).distinct()
    return relevant.join(found, ["case_id", "doc_id"], "left").groupBy("case_id").agg(
        F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), F.count("*").alias("relevant"))


def reciprocal_rank(judged_ranking: DataFrame, k: int, least_grade: int = 1) -> DataFrame:
    """Per case: 1 / the first relevant rank within k, else 0."""
    first = F.min(F.when((F.col("grade") >= least_grade) & (F.col("rank") <= k), F.col("rank")))
    return judged_ranking.groupBy("case_id").agg(F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("rr"))


def gain(grade: Column, violated: Column | None = None) -> Column:
    g = F.coalesce(grade, F.lit(0)).cast("double")
    return g if violated is None else F.when(violated, 0.0).otherwise(g)


def ndcg(judged_ranking: DataFrame, k: int = 5) -> DataFrame:
    """Per case: discounted gain over the ideal of all judged documents of the case; 0 if that is 0."""
    discount = lambda rank: F.log2(rank + F.lit(1.0))
    ideal_rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "doc_id"))
    rows = judged_ranking.withColumn("gain", gain(F.col("grade"))).withColumn("ideal", ideal_rank)
    sums = rows.groupBy("case_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("gain") / discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, F.col("gain") / discount(F.col("ideal"))).otherwise(0.0)).alias("idcg"))
    return sums.select("case_id", "dcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def verdict(checks: Column) -> Column:
    """Joint verdict of a map of checks: unjudged if empty, then unsuitable, unknown, suitable."""
    values = F.map_values(checks)
    return (
        F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, "unjudged").when(F.array_contains(values, "fail"), "unsuitable")
        .when(F.array_contains(values, "unknown"), "unknown").otherwise("suitable")
    )


def collapse(units: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Shared intents: best grade and worst verdict per unit and document."""
    order = F.when(F.col("verdict") == "unsuitable", 0).when(F.col("verdict") == "unknown", 1).when(F.col("verdict") == "unjudged", 2).otherwise(3)
    return units.groupBy(unit, *keys).agg(F.max("grade").alias("grade"), F.min_by("verdict", order).alias("verdict"))


def cutoff_grid() -> list[float | None]:
    """No cutoff, then 0.20 to 1.00 in steps of 0.01."""
    return [None, *(i / 100 for i in range(20, 101))]


def sweep(ranking: DataFrame, spark) -> DataFrame:
    """Per cutoff (null: none): cases kept, mean reciprocal rank and clean abstentions.

    ``ranking`` has case_id, rank, distance, grade, answerable.
    """
    grid = spark.createDataFrame([(c,) for c in cutoff_grid()], "cutoff double")
    rows = ranking.crossJoin(F.broadcast(grid))
    kept = F.col("cutoff").isNull() | (F.col("distance") <= F.col("cutoff"))
    per = rows.groupBy("cutoff", "case_id").agg(
        F.max("answerable").alias("answerable"), F.count_if(kept).alias("kept"), F.min(F.when(kept & (F.col("grade") >= 1), F.col("rank"))).alias("first"))
    return per.groupBy("cutoff").agg(
        F.avg(F.when(F.col("answerable"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)))).alias("mrr"),
        F.avg(F.when(~F.col("answerable"), (F.col("kept") == 0).cast("double"))).alias("abstention"))


def select_cutoff(curve: DataFrame, least_abstention: float) -> DataFrame:
    """The loosest cutoff of the highest mrr among those that abstain enough; no cutoff is the loosest."""
    ok = curve.filter(F.coalesce("abstention", F.lit(1.0)) >= least_abstention)
    return ok.orderBy(F.round("mrr", 9).desc(), F.desc_nulls_first("cutoff")).limit(1)


def decide(summary: DataFrame, baseline: str) -> DataFrame:
    """The winning configuration: gates against the baseline's row, then (net wins, ndcg, mrr); ties keep it."""
    base = summary.filter(F.col("config") == baseline).select(*(F.col(c).alias(f"b_{c}") for c in ("hit", "mrr", "ndcg", "abstention", "false_positives")))
    rows = summary.crossJoin(F.broadcast(base))
    passes = (F.col("hit") >= F.col("b_hit")) & (F.col("ndcg") >= F.col("b_ndcg")) & (F.col("abstention") >= F.col("b_abstention")) & (
        F.col("false_positives") <= F.col("b_false_positives")) & (F.col("net_wins") > 0)
    rows = rows.withColumn("passes", passes | (F.col("config") == baseline))
    order = Window.orderBy(F.desc("passes"), F.desc("net_wins"), F.desc("ndcg"), F.desc("mrr"), (F.col("config") != baseline), "config")  # a row per configuration
    return rows.withColumn("place", F.row_number().over(order)).select("config", "passes", "place")
