"""Queries: joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import joins as J
from ..operators import search as S
from ..operators.vectors import scored
from ..sources.tables import CASES_SQL, JUDGMENTS_SQL, RECIPES_SQL, SESSIONS_SQL, cases, judgments, recipes, session_events, table


@query("jn01_embedding_documents", "SELECT d.doc_id, d.source, e.label FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def jn01(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return J.embedding_join(e, table(spark, d, "documents").select("doc_id", "source"), ["doc_id"])


@query("jn02_chunk_document", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40")
def jn02(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return li.join(o, "l_orderkey")


@query("jn03_three_way", """
SELECT l_orderkey, l_linenumber, p_brand, o_orderpriority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size < 10""")
def jn03(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, d, "part").filter("p_size < 10").select("p_partkey", "p_brand")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "p_brand", "o_orderpriority")


@query("jn04_left_version_in_on", """
SELECT d.doc_id, e.label, e.vec_id IS NULL AS missing FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id AND e.label = 3""")
def jn04(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("there"))
    out = J.left_with_version(table(spark, d, "documents").select("doc_id"), e, ["doc_id"], F.col("label") == 3)
    return out.select("doc_id", "label", F.col("there").isNull().alias("missing"))


@query("jn05_orphans", "SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)")
def jn05(spark, d):
    return table(spark, d, "embeddings").select("vec_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("jn06_survivors", """
SELECT source, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x USING (doc_id) WHERE l.toxic = 1 AND x.source = d.source AND x.doc_id = d.doc_id)""")
def jn06(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    bad = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id")
    return J.survivors(docs, bad, ["source", "doc_id"])


@query("jn07_condemned_present", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jn07(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("jn08_unjudged_stay_null", f"WITH {JUDGMENTS_SQL} SELECT d.doc_id, grade, grade IS NULL AS unjudged FROM documents d LEFT JOIN judgments j USING (doc_id)")
def jn08(spark, d):
    return table(spark, d, "documents").select("doc_id").join(judgments(spark, d), "doc_id", "left").withColumn("unjudged", F.col("grade").isNull())


@query("jn09_exact_fetch", f"""
WITH {RECIPES_SQL} SELECT dataset_id, source_id, title FROM recipes WHERE (dataset_id, source_id) IN (('2-HIGH', '000000002'), ('5-LOW', '000000000'), ('5-LOW', '2'))""")
def jn09(spark, d):
    wanted = spark.createDataFrame([("2-HIGH", "000000002"), ("5-LOW", "000000000"), ("5-LOW", "2")], "dataset_id string, source_id string")
    return J.fetch(recipes(spark, d), wanted, ["dataset_id", "source_id"]).select("dataset_id", "source_id", "title")


@query("jn10_preferred_dataset", """
WITH x AS (SELECT o_orderpriority AS dataset_id, CAST(o_custkey AS VARCHAR) AS source_id, min(o_orderkey) AS first FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY dataset_id <> '3-MEDIUM', dataset_id) AS n FROM x WHERE source_id IN ('1', '2', '17', '99'))
SELECT source_id, dataset_id, first FROM r WHERE n = 1""")
def jn10(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset_id"), F.col("o_custkey").cast("string").alias("source_id")).agg(F.min("o_orderkey").alias("first"))
    wanted = spark.createDataFrame([("1",), ("2",), ("17",), ("99",)], "source_id string")
    return J.fetch(x, wanted, [], "3-MEDIUM").select("source_id", "dataset_id", "first")


@query("jn11_resolve_line", "SELECT o_orderkey, o_orderstatus, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7 AND l_linenumber <= 3")
def jn11(spark, d):
    li = table(spark, d, "lineitem").filter("l_orderkey = 7 and l_linenumber <= 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus").join(li, "o_orderkey")


@query("jn12_query_vector_distances", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), v), 6) AS distance FROM embeddings, q""")
def jn12(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return scored(e, q).select("vec_id", F.round("distance", 6).alias("distance"))


@query("jn13_products_without_self", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS seed, b.vec_id, round(list_inner_product(a.v, b.v), 6) AS product FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id""")
def jn13(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    seeds = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = scored(e, seeds, product=True).withColumnRenamed("query_id", "seed")
    return found.filter("vec_id <> seed").select("seed", "vec_id", F.round("similarity", 6).alias("product"))


@query("jn14_aligned_lines", """
WITH a AS (SELECT l_orderkey AS doc, p_name AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT *, row_number() OVER (PARTITION BY doc, text ORDER BY pos) AS n FROM a WHERE pos % 2 = 1), l AS (SELECT *, row_number() OVER (PARTITION BY doc, text ORDER BY pos) AS n FROM a)
SELECT p.doc, p.text, p.pos, l.pos AS line FROM p LEFT JOIN l USING (doc, text, n)""")
def jn14(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = li.select(F.col("l_orderkey").alias("doc"), F.col("p_name").alias("text"), F.row_number().over(order).cast("long").alias("pos"))
    return J.aligned_lines(a.filter("pos % 2 = 1"), a)


@query("jn15_event_chains", f"""
WITH {SESSIONS_SQL} SELECT session_id, k AS call_id, max(seq) FILTER (event_type = 'click') AS clicked, max(seq) FILTER (event_type = 'view') AS viewed,
  max(seq) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (event_type = 'error') AS errors FROM session_events GROUP BY ALL""")
def jn15(spark, d):
    seq = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("seq")))
    return session_events(spark, d).groupBy("session_id", F.col("k").alias("call_id")).agg(
        seq("click").alias("clicked"), seq("view").alias("viewed"), seq("purchase").alias("bought"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("jn16_ordinal_costs", f"""
WITH {SESSIONS_SQL}, a AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM session_events WHERE event_type = 'view'),
b AS (SELECT session_id, value, CASE WHEN k > 90 THEN value / 2 END AS correction, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM session_events WHERE event_type = 'purchase')
SELECT session_id, seq, nth, round(coalesce(correction, value), 6) AS cost FROM a LEFT JOIN b USING (session_id, nth)""")
def jn16(spark, d):
    e = session_events(spark, d)
    a = e.filter("event_type = 'view'").select("session_id", "seq")
    b = e.filter("event_type = 'purchase'").select("session_id", F.col("seq").alias("s"), "value", F.when(F.col("k") > 90, F.col("value") / 2).alias("correction"))
    return J.nth_match(a, b, "session_id", ["seq"], ["s"]).select(
        "session_id", "seq", F.col("nth").cast("long").alias("nth"), F.round(F.coalesce("correction", "value"), 6).alias("cost"))


@query("jn17_dataset_overlap", """
SELECT count(DISTINCT a.c_custkey) AS ids, count(DISTINCT a.c_mktsegment) AS segments FROM customer a
WHERE a.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def jn17(spark, d):
    seen = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_semi").agg(F.countDistinct("c_custkey").alias("ids"), F.countDistinct("c_mktsegment").alias("segments"))


@query("jn18_merged_answers", f"""
WITH {SESSIONS_SQL}, s AS (SELECT session_id, k, max(value) AS v FROM session_events WHERE event_type = 'click' GROUP BY ALL), i AS (SELECT session_id, k, min(value) AS v FROM session_events WHERE event_type = 'signup' GROUP BY ALL)
SELECT session_id, k, coalesce(i.v, s.v) AS answer FROM s FULL JOIN i USING (session_id, k)""")
def jn18(spark, d):
    e = session_events(spark, d)
    s = e.filter("event_type = 'click'").groupBy("session_id", "k").agg(F.max("value").alias("answer"))
    i = e.filter("event_type = 'signup'").groupBy("session_id", "k").agg(F.min("value").alias("answer"))
    return J.merged_answers(s, i, ["session_id", "k"], "answer")


@query("jn19_candidate_pool", f"""
WITH {CASES_SQL}, w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
a AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY len(list_filter(ws, lambda x: list_contains(terms, x))) DESC, doc_id) AS rank FROM cases, w WHERE list_has_all(ws, terms)),
b AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS rank FROM cases, w WHERE list_contains(ws, opener)),
u AS (SELECT case_id, doc_id, 0 AS src, rank FROM a WHERE rank <= 15 UNION ALL SELECT case_id, doc_id, 1, rank FROM b WHERE rank <= 10),
f AS (SELECT *, row_number() OVER (PARTITION BY case_id, doc_id ORDER BY src, rank) AS n FROM u),
p AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY src, rank, doc_id) AS pool_rank FROM f WHERE n = 1)
SELECT * FROM p WHERE pool_rank <= 20""")
def jn19(spark, d):
    found = table(spark, d, "documents")
    asked = cases(spark, d).withColumnRenamed("case_id", "query_id")
    opener = asked.select("query_id", F.slice("terms", 1, 1).alias("terms"))
    first = S.top(S.only_all(S.hits(found, asked, ["doc_id"])), ["doc_id"], 15, [F.desc("hits")])
    second = S.top(S.hits(found, opener, ["doc_id"]), ["doc_id"], 10, [F.col("doc_id")])
    lists = [x.withColumnRenamed("query_id", "case_id") for x in (first, second)]
    return J.pooled(lists, ["doc_id"]).withColumn("pool_rank", F.col("pool_rank").cast("long"))


@query("jn20_verified_urls", r"""
WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^www\.', ''), '/+$', '')) AS k FROM pages),
q AS (SELECT page_id, k || CASE WHEN page_id % 3 = 0 THEN '/moved' ELSE '' END AS k FROM p) SELECT page_id, k IN (SELECT k FROM p) AS verified FROM q""")
def jn20(spark, d):
    """Every page's URL, a third of them changed, against all URLs that were retrieved."""
    p = table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("k"))
    known = p.select("k").distinct().withColumn("there", F.lit(True))
    parsed = p.withColumn("k", F.when(F.col("page_id") % 3 == 0, F.concat("k", F.lit("/moved"))).otherwise(F.col("k")))
    return parsed.join(known, "k", "left").select("page_id", F.col("there").isNotNull().alias("verified"))


@query("jn21_reference_reasons", f"""
WITH {SESSIONS_SQL}, r AS (SELECT session_id, seq, k FROM session_events WHERE event_type = 'purchase'), v AS (SELECT DISTINCT session_id, k FROM session_events WHERE event_type = 'view')
SELECT r.session_id, r.seq, CASE WHEN d.doc_id IS NULL THEN 'unresolved' WHEN v.k IS NULL THEN 'not_returned' WHEN d.lang <> 'en' THEN 'wrong_kind' ELSE 'ok' END AS reason
FROM r LEFT JOIN documents d ON d.doc_id = r.k * 20 LEFT JOIN v ON v.session_id = r.session_id AND v.k = r.k""")
def jn21(spark, d):
    e = session_events(spark, d)
    r = e.filter("event_type = 'purchase'").select("session_id", "seq", "k", (F.col("k") * 20).alias("doc_id"))
    v = e.filter("event_type = 'view'").select("session_id", "k", F.lit(True).alias("seen")).distinct()
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return r.join(docs, "doc_id", "left").join(v, ["session_id", "k"], "left").select(
        "session_id", "seq",
        F.when(F.col("lang").isNull(), "unresolved").when(F.col("seen").isNull(), "not_returned").when(F.col("lang") != "en", "wrong_kind").otherwise("ok").alias("reason"))


@query("jn22_last_label_wins", f"""
WITH {SESSIONS_SQL} SELECT d.c_custkey, coalesce(l.label, 'unclassified') AS label FROM customer d
LEFT JOIN (SELECT session_id, max_by(event_type, seq) AS label FROM session_events WHERE event_type IN ('click', 'view') GROUP BY 1) l ON l.session_id = d.c_custkey""")
def jn22(spark, d):
    last = session_events(spark, d).filter("event_type in ('click', 'view')").groupBy(F.col("session_id").alias("c_custkey")).agg(F.max_by("event_type", "seq").alias("label"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("label", F.lit("unclassified")).alias("label"))


@query("jn23_reconciled_results", """
WITH asked AS (SELECT DISTINCT l_partkey AS custom_id FROM lineitem WHERE l_returnflag <> 'N' AND l_tax > 0.05), res AS (SELECT l_partkey AS custom_id, l_linenumber AS file, l_orderkey AS line, CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE 'ok' END AS status FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.04),
r AS (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY file, line) AS n FROM res)
SELECT custom_id, file, line, CASE WHEN file IS NULL THEN 'missing' WHEN a.custom_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN status = 'ok' THEN 'ok' ELSE 'failed' END AS outcome
FROM (SELECT coalesce(a.custom_id, r.custom_id) AS custom_id, file, line, n, status, a.custom_id AS aid FROM asked a FULL JOIN r ON a.custom_id = r.custom_id) x LEFT JOIN asked a USING (custom_id)""")
def jn23(spark, d):
    li = table(spark, d, "lineitem")
    asked = li.filter("l_returnflag <> 'N' and l_tax > 0.05").select(F.col("l_partkey").alias("custom_id"))
    res = li.filter("l_linestatus = 'F' and l_tax > 0.04").select(
        F.col("l_partkey").alias("custom_id"), F.col("l_linenumber").alias("file"), F.col("l_orderkey").alias("line"), F.when(F.col("l_returnflag") == "R", "bad").otherwise("ok").alias("status"))
    return J.reconciled(asked, res)


@query("jn24_outside_pool", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn24(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("set01_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set01(spark, d):
    region = table(spark, d, "region")
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(region.select(region.columns[1])).distinct()


@query("set02_keep_first_union", """
WITH u AS (SELECT l_suppkey, l_partkey, l_linenumber AS ord FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, l_partkey, l_linenumber + 100 FROM lineitem WHERE l_linestatus = 'F')
SELECT l_suppkey, l_partkey, min(ord) AS ord FROM u GROUP BY ALL""")
def set02(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'A'").select("l_suppkey", "l_partkey", F.col("l_linenumber").alias("ord"))
    b = li.filter("l_linestatus = 'F'").select("l_suppkey", "l_partkey", (F.col("l_linenumber") + 100).alias("ord"))
    return a.union(b).groupBy("l_suppkey", "l_partkey").agg(F.min("ord").alias("ord"))


@query("set03_difference", """
WITH {recipes} SELECT source_id, array_to_string(list_sort(list_filter(['red bolt', 'blue nut', 'small ring'], lambda x: NOT list_contains(names, x))), ',') AS missing FROM recipes""".format(recipes=RECIPES_SQL))
def set03(spark, d):
    need = F.array(F.lit("red bolt"), F.lit("blue nut"), F.lit("small ring"))
    return recipes(spark, d).select("source_id", F.array_join(F.array_sort(F.array_except(need, "names")), ",").alias("missing"))


@query("set04_intersection", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def set04(spark, d):
    return table(spark, d, "labels").select("doc_id").intersect(table(spark, d, "embeddings").select("vec_id"))


@query("set05_manifest_equality", """
SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS extra, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS missing""")
def set05(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id")
    return a.exceptAll(b).agg(F.count("*").alias("extra")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("missing")))
