"""Queries: offline evaluation. Runs are the full-text lists of the cases, judged by labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evaluation as E
from ..operators import search as S
from ..operators import vectors as V
from ..sources.tables import JUDGMENTS_SQL, judgments, table
from .search import HITS_SQL, case_hits, query_vectors, vectors

RUN_SQL = f"""{HITS_SQL}, {JUDGMENTS_SQL},
run AS (SELECT query_id AS case_id, doc_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, hits DESC, doc_id) AS rank FROM hits),
judged AS (SELECT r.case_id, r.doc_id, r.hits, r.rank, j.grade FROM run r LEFT JOIN judgments j USING (doc_id) WHERE rank <= 20)"""


def run(spark, d):
    full = S.top(case_hits(spark, d), ["doc_id"], 20, [F.desc("matched"), F.desc("hits")])
    return full.select(F.col("query_id").alias("case_id"), "doc_id", "hits", "rank")


def judged(spark, d):
    return E.judged(run(spark, d), judgments(spark, d), ["doc_id"])


@query("evl01_recall", f"""WITH {RUN_SQL}, rel AS (SELECT case_id, doc_id FROM judged WHERE grade >= 1)
SELECT rel.case_id, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS relevant FROM rel JOIN judged USING (case_id, doc_id) GROUP BY 1""")
def evl01(spark, d):
    j = judged(spark, d)
    return E.recall_at(j, j.filter("grade >= 1").select("case_id", "doc_id"), 5).withColumn("recall", F.round("recall", 6))


@query("evl02_reciprocal_rank", f"WITH {RUN_SQL} SELECT case_id, round(coalesce(1e0 / min(rank) FILTER (grade >= 1 AND rank <= 5), 0e0), 6) AS rr FROM judged GROUP BY 1")
def evl02(spark, d):
    return E.reciprocal_rank(judged(spark, d), 5).withColumn("rr", F.round("rr", 6))


@query("evl03_joint_verdict", """
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'unsuitable' WHEN toxic = 1 THEN 'unsuitable' WHEN quality = 0 THEN 'unknown' ELSE 'suitable' END AS verdict FROM labels
UNION ALL SELECT doc_id, 'unjudged' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def evl03(spark, d):
    check = F.create_map(F.lit("quality"), F.when(F.col("quality") == 1, "pass").otherwise("unknown"), F.lit("toxic"), F.when(F.col("toxic") == 1, "fail").otherwise("pass"))
    checks = F.when(F.col("quality").isNotNull(), check)
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", E.verdict(checks).alias("verdict"))


@query("evl04_shared_intents", """
WITH u AS (SELECT doc_id % 50 AS unit, doc_id % 7 AS doc, quality AS grade, CASE WHEN toxic = 1 THEN 'unsuitable' WHEN quality = 0 THEN 'unknown' ELSE 'suitable' END AS verdict FROM labels)
SELECT unit, doc, max(grade) AS grade, CASE min(CASE verdict WHEN 'unsuitable' THEN 0 WHEN 'unknown' THEN 1 ELSE 3 END) WHEN 0 THEN 'unsuitable' WHEN 1 THEN 'unknown' ELSE 'suitable' END AS verdict FROM u GROUP BY ALL""")
def evl04(spark, d):
    verdict = F.when(F.col("toxic") == 1, "unsuitable").when(F.col("quality") == 0, "unknown").otherwise("suitable")
    u = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("unit"), (F.col("doc_id") % 7).alias("doc"), F.col("quality").alias("grade"), verdict.alias("verdict"))
    return E.collapse(u, "unit", ["doc"])


@query("evl05_case_metrics", f"""WITH {RUN_SQL} SELECT case_id, count(*) AS shown, count(grade) AS judged, count(*) - count(grade) AS unjudged, CASE WHEN count(grade) = 0 THEN NULL ELSE round(count(*) FILTER (grade >= 1) * 1e0 / count(grade), 6) END AS precision
FROM judged WHERE rank <= 5 GROUP BY 1""")
def evl05(spark, d):
    per = judged(spark, d).filter("rank <= 5").groupBy("case_id").agg(F.count("*").alias("shown"), F.count("grade").alias("judged"), F.count_if(F.col("grade") >= 1).alias("good"))
    return per.select("case_id", "shown", "judged", (F.col("shown") - F.col("judged")).alias("unjudged"), F.round(F.try_divide("good", "judged"), 6).alias("precision"))


_NDCG = f"""WITH {RUN_SQL}, g AS (SELECT case_id, doc_id, rank, coalesce(grade, 0) * 1e0 AS gain, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(grade, 0) DESC, doc_id) AS ideal FROM judged),
s AS (SELECT case_id, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN gain / log2(ideal + 1) ELSE 0 END) AS idcg FROM g GROUP BY 1)"""


@query("evl06_ndcg", _NDCG + "SELECT case_id, round(dcg, 6) AS dcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s")
def evl06(spark, d):
    return E.ndcg(judged(spark, d)).select("case_id", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


@query("evl07_net_wins", f"""WITH {RUN_SQL}, o AS (SELECT case_id, doc_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS rank FROM judged),
a AS (SELECT case_id, coalesce(1e0 / min(rank) FILTER (grade >= 1 AND rank <= 5), 0e0) AS rr FROM judged GROUP BY 1), b AS (SELECT case_id, coalesce(1e0 / min(rank) FILTER (grade >= 1 AND rank <= 5), 0e0) AS rr FROM o GROUP BY 1)
SELECT count(*) FILTER (b.rr > a.rr) AS wins, count(*) FILTER (b.rr < a.rr) AS losses, count(*) FILTER (b.rr = a.rr) AS ties, round(avg(a.rr), 6) AS base_mrr, round(avg(b.rr), 6) AS mrr FROM a JOIN b USING (case_id)""")
def evl07(spark, d):
    j = judged(spark, d)
    other = j.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id")))
    both = E.reciprocal_rank(j, 5).join(E.reciprocal_rank(other, 5).withColumnRenamed("rr", "new"), "case_id")
    return both.agg(
        F.count_if(F.col("new") > F.col("rr")).alias("wins"), F.count_if(F.col("new") < F.col("rr")).alias("losses"), F.count_if(F.col("new") == F.col("rr")).alias("ties"),
        F.round(F.avg("rr"), 6).alias("base_mrr"), F.round(F.avg("new"), 6).alias("mrr"))


@query("evl08_decision", """
WITH s(config, hit, mrr, ndcg, abstention, false_positives, net_wins) AS (
  SELECT * FROM (VALUES ('base', 0.4, 0.3, 0.4, 1.0, 3, 0), ('a', 0.8, 0.7, 0.8, 1.0, 2, 5), ('b', 0.8, 0.7, 0.8, 1.0, 2, 5), ('c', 0.9, 0.8, 0.9, 0.5, 1, 9))
  UNION ALL SELECT source, round(avg(quality), 6), round(avg(1 - toxic), 6), round(avg((quality + 1 - toxic) / 2), 6), CASE WHEN sum(toxic) > 2 THEN 0.5 ELSE 1.0 END, sum(toxic), sum(quality) - sum(toxic)
  FROM documents JOIN labels USING (doc_id) GROUP BY source),
p AS (SELECT *, config = 'base' OR (hit >= 0.4 AND ndcg >= 0.4 AND abstention >= 1.0 AND false_positives <= 3 AND net_wins > 0) AS passes FROM s)
SELECT config, passes, CAST(row_number() OVER (ORDER BY passes DESC, net_wins DESC, ndcg DESC, mrr DESC, config <> 'base', config) AS INTEGER) AS place FROM p""")
def evl08(spark, d):
    rows = [("base", 0.4, 0.3, 0.4, 1.0, 3, 0), ("a", 0.8, 0.7, 0.8, 1.0, 2, 5), ("b", 0.8, 0.7, 0.8, 1.0, 2, 5), ("c", 0.9, 0.8, 0.9, 0.5, 1, 9)]
    q, t = F.col("quality"), F.col("toxic")
    own = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("config")).agg(
        F.round(F.avg(q), 6).alias("hit"), F.round(F.avg(1 - t), 6).alias("mrr"), F.round(F.avg((q + 1 - t) / 2), 6).alias("ndcg"), F.when(F.sum(t) > 2, 0.5).otherwise(1.0).alias("abstention"),
        F.sum(t).cast("int").alias("false_positives"), (F.sum(q) - F.sum(t)).cast("int").alias("net_wins"))
    return E.decide(own.unionByName(spark.createDataFrame(rows, "config string, hit double, mrr double, ndcg double, abstention double, false_positives int, net_wins int")), "base")


@query("evl09_derived_configs", f"""WITH {RUN_SQL}, c(config, least, k) AS (VALUES ('all', 0, 5), ('strict', 20, 5), ('short', 0, 2))
SELECT config, case_id, doc_id, rank FROM judged, c WHERE hits >= least AND rank <= k""")
def evl09(spark, d):
    configs = spark.createDataFrame([("all", 0, 5), ("strict", 20, 5), ("short", 0, 2)], "config string, least int, k int")
    return run(spark, d).crossJoin(F.broadcast(configs)).filter("hits >= least and rank <= k").select("config", "case_id", "doc_id", "rank")


_SWEEP = f"""WITH {JUDGMENTS_SQL}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id IN (SELECT item_id FROM benchmark)),
dd AS (SELECT q.vec_id AS case_id, e.vec_id AS doc_id, round(list_cosine_distance(q.v, e.v), 9) AS distance FROM q JOIN e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, doc_id) AS rank FROM dd), t AS (SELECT r.*, grade, case_id % 4 <> 0 AS answerable FROM r LEFT JOIN judgments USING (doc_id) WHERE rank <= 20),
grid AS (SELECT CAST(NULL AS DOUBLE) AS cutoff UNION ALL SELECT i / 100e0 FROM range(20, 101) x(i)),
p AS (SELECT cutoff, case_id, any_value(answerable) AS answerable, count(*) FILTER (cutoff IS NULL OR distance <= cutoff) AS kept, min(rank) FILTER ((cutoff IS NULL OR distance <= cutoff) AND grade >= 1) AS first FROM t, grid GROUP BY ALL),
curve AS (SELECT cutoff, avg(coalesce(1e0 / first, 0e0)) FILTER (answerable) AS mrr, avg(CASE WHEN kept = 0 THEN 1e0 ELSE 0e0 END) FILTER (NOT answerable) AS abstention FROM p GROUP BY 1)"""


def _curve(spark, d):
    near = V.scored(vectors(spark, d).select("vec_id", "v"), query_vectors(spark, d), best=21).filter("query_id <> vec_id")  # the item's own vector is one of them
    pairs = near.select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("doc_id"), F.round("distance", 9).alias("distance"))
    w = Window.partitionBy("case_id").orderBy("distance", "doc_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 20")
    return E.sweep(E.judged(ranked, judgments(spark, d), ["doc_id"]).withColumn("answerable", F.col("case_id") % 4 != 0), spark)


@query("evl10_cutoff_sweep", _SWEEP + "SELECT cutoff, round(mrr, 6) AS mrr, round(abstention, 6) AS abstention FROM curve")
def evl10(spark, d):
    return _curve(spark, d).select("cutoff", F.round("mrr", 6).alias("mrr"), F.round("abstention", 6).alias("abstention"))


@query("evl10_selected_cutoff", _SWEEP + "SELECT cutoff FROM curve WHERE coalesce(abstention, 1) >= 0.6 ORDER BY round(mrr, 9) DESC, cutoff DESC NULLS FIRST LIMIT 1")
def evl10b(spark, d):
    return E.select_cutoff(_curve(spark, d), 0.6).select("cutoff")


@query("evl11_strict_and_broad", f"""WITH {RUN_SQL}, t(threshold) AS (VALUES (1), (2)), c AS (SELECT threshold, case_id, case_id % 2 = 0 AS held_out, coalesce(1e0 / min(rank) FILTER (grade >= threshold AND rank <= 5), 0e0) AS rr FROM judged, t GROUP BY ALL)
SELECT threshold, held_out, round(avg(rr), 6) AS mrr, count(*) AS units FROM c GROUP BY ALL""")
def evl11(spark, d):
    thresholds = spark.createDataFrame([(1,), (2,)], "threshold int")
    rows = judged(spark, d).crossJoin(F.broadcast(thresholds))
    first = F.min(F.when((F.col("grade") >= F.col("threshold")) & (F.col("rank") <= 5), F.col("rank")))
    c = rows.groupBy("threshold", "case_id").agg(F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("rr"))
    return c.groupBy("threshold", (F.col("case_id") % 2 == 0).alias("held_out")).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("units"))


@query("evl12_run_summary", f"""WITH {RUN_SQL} SELECT case_id % 2 AS split, case_id % 3 AS category, count(*) AS shown, count(DISTINCT case_id) AS cases FROM judged GROUP BY GROUPING SETS ((case_id % 2), (case_id % 3), ())""")
def evl12(spark, d):
    r = run(spark, d).withColumns({"split": F.col("case_id") % 2, "category": F.col("case_id") % 3})
    return r.groupingSets([["split"], ["category"], []], "split", "category").agg(F.count("*").alias("shown"), F.countDistinct("case_id").alias("cases"))


@query("evl13_gap_cases", f"""WITH {RUN_SQL}, c AS (SELECT case_id, min(rank) FILTER (grade >= 1 AND rank <= 5) AS first, count(*) FILTER (grade >= 1) = 0 AS gap FROM judged GROUP BY 1)
SELECT case_id, gap, CASE WHEN gap THEN NULL ELSE first IS NOT NULL END AS hit FROM c""")
def evl13(spark, d):
    good = F.col("grade") >= 1
    c = judged(spark, d).groupBy("case_id").agg(F.count_if(good & (F.col("rank") <= 5)).alias("near"), (F.count_if(good) == 0).alias("gap"))
    return c.select("case_id", "gap", F.when(~F.col("gap"), F.col("near") > 0).alias("hit"))


@query("evl14_adjudication", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)
SELECT doc_id, CASE WHEN list_has_any(ws, ['idiot', 'stupid', 'clown', 'pathetic']) THEN 'unsuitable' WHEN list_has_any(ws, ['loser', 'trash']) THEN 'unknown' ELSE 'suitable' END AS suitability FROM w""")
def evl14(spark, d):
    from ..functions.text import tokens

    ws = tokens(F.col("text"))
    any_of = lambda *words: F.arrays_overlap(ws, F.array(*map(F.lit, words)))
    status = F.when(any_of("idiot", "stupid", "clown", "pathetic"), "unsuitable").when(any_of("loser", "trash"), "unknown").otherwise("suitable")
    return table(spark, d, "documents").select("doc_id", status.alias("suitability"))


@query("evl15_top5_counts", f"""WITH {RUN_SQL} SELECT case_id, count(*) FILTER (grade >= 1) AS good, count(*) FILTER (grade IS NULL) AS unjudged, count(*) FILTER (contains(text, '###')) AS malformed FROM judged JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1""")
def evl15(spark, d):
    bad = table(spark, d, "documents").select("doc_id", F.col("text").contains("###").alias("bad"))
    return judged(spark, d).filter("rank <= 5").join(bad, "doc_id").groupBy("case_id").agg(
        F.count_if(F.col("grade") >= 1).alias("good"), F.count_if(F.col("grade").isNull()).alias("unjudged"), F.count_if("bad").alias("malformed"))


@query("evl16_config_hash", """
SELECT p_partkey, sha256('{"k":' || p_size || ',"limit":' || p_partkey || ',"name":"' || p_name || '"}') AS a, a AS b FROM part""")
def evl16(spark, d):
    """Canonical JSON with sorted keys, hashed: the same whatever the order of the settings."""
    from ..functions.manifest import object_hash

    k, limit, name = F.col("p_size"), F.col("p_partkey"), F.col("p_name")
    a, b = object_hash({"k": k, "limit": limit, "name": name}), object_hash({"name": name, "limit": limit, "k": k})
    return table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))


@query("evl17_case_checks", """
WITH c AS (SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM benchmark)
SELECT item_id, 'too_long' AS problem FROM c WHERE n > 60 UNION ALL SELECT min(item_id), 'repeated' FROM benchmark GROUP BY text HAVING count(*) > 1""")
def evl17(spark, d):
    from ..functions.text import tokens

    b = table(spark, d, "benchmark")
    long = b.filter(F.size(tokens(F.col("text"))) > 60).select("item_id", F.lit("too_long").alias("problem"))
    again = b.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n")).filter("n > 1").select("item_id", F.lit("repeated").alias("problem"))
    return long.unionByName(again)
