"""Queries: aggregation, distinct, deduplication, fingerprints, limits and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import limits as L
from ..sources.tables import RECIPES_SQL, SESSIONS_SQL, recipes, session_events, table


@query("agg01_best_chunk", "SELECT l_orderkey, min(l_discount) AS distance, count(*) AS chunks FROM lineitem GROUP BY l_orderkey ORDER BY distance, l_orderkey LIMIT 50")
def agg01(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("distance"), F.count("*").alias("chunks")).orderBy("distance", "l_orderkey").limit(50)


@query("agg02_ingestion_report", f"""
WITH {RECIPES_SQL} SELECT dataset_id, count(*) AS total, count(*) FILTER (minutes IS NULL) AS missing_minutes, count(*) FILTER (minutes <= 0) AS unusable,
  round(avg(CASE WHEN minutes IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, count(*) - count(DISTINCT names) AS duplicates, CAST(sum(len(names)) AS BIGINT) AS lines FROM recipes GROUP BY dataset_id""")
def agg02(spark, d):
    r = recipes(spark, d)
    return r.groupBy("dataset_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("minutes").isNull()).alias("missing_minutes"), F.count_if(F.col("minutes") <= 0).alias("unusable"),
        F.round(F.avg(F.col("minutes").isNull().cast("double")), 6).alias("missing_rate"), (F.count("*") - F.countDistinct("names")).alias("duplicates"),
        F.sum(F.size("names")).alias("lines"))


@query("agg02_flag_histogram", """
WITH f AS (SELECT unnest(list_filter([CASE WHEN contains(text, '|') THEN 'bars' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN length(text) < 100 THEN 'short' END], lambda x: x IS NOT NULL)) AS flag FROM documents)
SELECT flag, count(*) AS n FROM f GROUP BY flag""")
def agg02b(spark, d):
    t = F.col("text")
    flags = F.array_compact(F.array(F.when(t.contains("|"), "bars"), F.when(t.contains("!!"), "shouting"), F.when(F.length(t) < 100, "short")))
    return table(spark, d, "documents").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("agg03_version_counts", "SELECT l_returnflag AS dataset, l_linestatus AS version, count(*) AS n FROM lineitem GROUP BY ALL")
def agg03(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("version")).agg(F.count("*").alias("n"))


@query("agg04_invariant_counts", """
SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'orphan_labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings""")
def agg04(spark, d):
    docs = table(spark, d, "documents")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    orphans = table(spark, d, "labels").join(docs, "doc_id", "left_anti")
    return count(docs, "documents").unionByName(count(orphans, "orphan_labels")).unionByName(count(table(spark, d, "embeddings"), "embeddings"))


_FINGERPRINT = """
WITH h AS (SELECT {key} AS k, md5(concat_ws(chr(31), {cols})) AS h, CAST(('0x' || substring(md5(CAST({key} AS VARCHAR)), 1, 4)) AS BIGINT) % 256 AS b FROM {table}),
p AS (SELECT b, md5(string_agg(h, '' ORDER BY k, h)) AS h, count(*) AS n FROM h GROUP BY b)
SELECT md5(string_agg(h, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM p"""


@query("agg05_table_fingerprint", _FINGERPRINT.format(key="s_suppkey", cols="CAST(s_suppkey AS VARCHAR), coalesce(s_name, '\\N'), CAST(s_nationkey AS VARCHAR)", table="supplier"))
def agg05(spark, d):
    return A.table_fingerprint(table(spark, d, "supplier"), ["s_suppkey"], ["s_suppkey", "s_name", "s_nationkey"])


@query("agg18_document_fingerprint", _FINGERPRINT.format(key="doc_id", cols="CAST(doc_id AS VARCHAR), coalesce(text, '\\N'), coalesce(lang, '\\N')", table="documents"))
def agg18(spark, d):
    return A.table_fingerprint(table(spark, d, "documents"), ["doc_id"], ["doc_id", "text", "lang"])


@query("agg18_changed_columns", """
SELECT count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS changed, count(*) AS n FROM documents""")
def agg18b(spark, d):
    before = table(spark, d, "documents")
    after = before.withColumn("n_chars", F.length("text").cast("long"))
    both = before.select("doc_id", "n_chars").join(after.select("doc_id", F.col("n_chars").alias("new")), "doc_id")
    return both.agg(F.count_if(~F.col("n_chars").eqNullSafe(F.col("new"))).alias("changed"), F.count("*").alias("n"))


@query("agg06_category_profile", f"""
WITH {RECIPES_SQL}, c AS (SELECT dataset_id, CASE WHEN contains(title, 'bolt') THEN 'bolt' WHEN contains(title, 'ring') THEN 'ring' ELSE 'other' END AS category,
  substring(sha256(lower(title) || chr(31) || array_to_string(list_sort(list_distinct(names)), ',')), 1, 16) AS dup, servings, len(names) AS lines FROM recipes)
SELECT dataset_id, category, count(*) AS recipes, count(DISTINCT dup) AS groups, count(DISTINCT CASE WHEN lines >= 3 THEN dup END) AS ratio_ready,
  count(*) FILTER (servings > 0) AS with_servings, CAST(sum(lines) AS BIGINT) AS lines FROM c GROUP BY ALL""")
def agg06(spark, d):
    dup = F.substring(A.content_hash(F.lower("title"), F.array_join(F.array_sort(F.array_distinct("names")), ",")), 1, 16)
    category = T.first_match(F.col("title"), [("bolt", "bolt"), ("ring", "ring")], "other")
    c = recipes(spark, d).select("dataset_id", category.alias("category"), dup.alias("dup"), "servings", F.size("names").alias("k"))
    return c.groupBy("dataset_id", "category").agg(
        F.count("*").alias("recipes"), F.countDistinct("dup").alias("groups"), F.countDistinct(F.when(F.col("k") >= 3, F.col("dup"))).alias("ratio_ready"),
        F.count_if(F.col("servings") > 0).alias("with_servings"), F.sum("k").alias("lines"))


@query("agg07_direction_audit", """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos, len(ls) AS n FROM s),
c AS (SELECT *, CASE WHEN contains(line, '|') THEN 'list' WHEN regexp_matches(line, '[*#$%&]{3}') THEN 'noise' WHEN line = '' THEN 'empty' ELSE 'prose' END AS class,
  CASE WHEN pos = n THEN 'last' WHEN pos = 1 THEN 'first' ELSE 'middle' END AS place FROM l)
SELECT class, place, count(*) AS lines, count(DISTINCT doc_id) AS documents, count(DISTINCT line) AS texts FROM c GROUP BY ALL""")
def agg07(spark, d):
    lines = F.split("text", "\n")
    rows = table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), F.posexplode(lines).alias("pos", "line"))
    kind = F.when(F.col("line").contains("|"), "list").when(F.col("line").rlike(r"[*#$%&]{3}"), "noise").when(F.col("line") == "", "empty").otherwise("prose")
    place = F.when(F.col("pos") == F.col("n") - 1, "last").when(F.col("pos") == 0, "first").otherwise("middle")
    return rows.groupBy(kind.alias("class"), place.alias("place")).agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("line").alias("texts"))


@query("agg08_copy_sweep", """
WITH v AS (SELECT source AS dataset, unnest(['plain', 'collapsed', 'lower']) AS variant, text FROM documents),
c AS (SELECT dataset, variant, CASE variant WHEN 'plain' THEN text WHEN 'collapsed' THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE lower(text) END = text AS same FROM v)
SELECT dataset, variant, same, count(*) AS n FROM c GROUP BY ALL""".replace("\\\\", "\\"))
def agg08(spark, d):
    v = table(spark, d, "documents").select(F.col("source").alias("dataset"), F.explode(F.array(*map(F.lit, ("plain", "collapsed", "lower")))).alias("variant"), "text")
    copy = F.when(F.col("variant") == "plain", F.col("text")).when(F.col("variant") == "collapsed", T.collapsed(F.col("text"))).otherwise(F.lower("text"))
    return v.groupBy("dataset", "variant", (copy == F.col("text")).alias("same")).agg(F.count("*").alias("n"))


@query("agg09_routing_summary", """
WITH r AS (SELECT CASE WHEN length(text) < 30 THEN 'quarantine' WHEN contains(text, '###') THEN 'needs_review' ELSE 'accept' END AS route FROM documents)
SELECT route, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM documents), 6) AS share FROM r GROUP BY route""")
def agg09(spark, d):
    route = F.when(F.length("text") < 30, "quarantine").when(F.col("text").contains("###"), "needs_review").otherwise("accept")
    n = table(spark, d, "documents").groupBy(route.alias("route")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("route", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("agg10_coverage_ratios", """
SELECT p_type, round(avg(CASE WHEN l_quantity > 5 THEN 1.0 ELSE 0.0 END), 6) AS measured, round(avg(CASE WHEN l_tax = 0 THEN 1.0 ELSE 0.0 END), 6) AS qualitative, count(*) AS lines
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def agg10(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_tax").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return li.groupBy("p_type").agg(share(F.col("l_quantity") > 5).alias("measured"), share(F.col("l_tax") == 0).alias("qualitative"), F.count("*").alias("lines"))


@query("agg11_scalar_audit", f"""
WITH {RECIPES_SQL} SELECT count(DISTINCT source_id) AS ids, count(*) FILTER (minutes IS NULL) AS missing, count(*) FILTER (minutes < 0) AS negative, count(*) FILTER (minutes = 0) AS zero,
  count(*) FILTER (minutes > 300 AND NOT isnan(minutes)) AS long, max(CASE WHEN isnan(minutes) THEN NULL ELSE minutes END) AS longest FROM recipes""")
def agg11(spark, d):
    m = F.col("minutes")
    return recipes(spark, d).agg(
        F.countDistinct("source_id").alias("ids"), F.count_if(m.isNull()).alias("missing"), F.count_if(m < 0).alias("negative"), F.count_if(m == 0).alias("zero"),
        F.count_if((m > 300) & ~F.isnan(m)).alias("long"), F.max(F.when(~F.isnan(m), m)).alias("longest"))


@query("agg11_list_lengths", f"WITH {RECIPES_SQL} SELECT CAST(len(names) AS BIGINT) AS length, count(*) AS n FROM recipes GROUP BY 1")
def agg11b(spark, d):
    return recipes(spark, d).groupBy(F.size("names").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query("agg12_session_tokens", f"""
WITH {SESSIONS_SQL} SELECT session_id, CAST(sum(greatest(0, k - 10)) AS BIGINT) AS tokens, count(*) AS calls FROM session_events WHERE k IS NOT NULL GROUP BY 1""")
def agg12(spark, d):
    e = session_events(spark, d).filter("k is not null")  # a payload that can't be read leaves the whole event out
    return e.groupBy("session_id").agg(F.sum(F.greatest(F.lit(0), F.col("k") - 10)).alias("tokens"), F.count("*").alias("calls"))


@query("agg13_spend", f"""
WITH {SESSIONS_SQL} SELECT event_type, round(sum(CASE WHEN k % 2 = 0 THEN value ELSE 0 END), 6) AS reconciled, round(sum(CASE WHEN k % 2 = 1 THEN value ELSE 0 END), 6) AS reserved FROM session_events GROUP BY 1""")
def agg13(spark, d):
    part = lambda r: F.round(F.sum(F.when(F.col("k") % 2 == r, F.col("value")).otherwise(0)), 6)
    return session_events(spark, d).groupBy("event_type").agg(part(0).alias("reconciled"), part(1).alias("reserved"))


@query("agg14_session_listing", """
SELECT conv_id, count(*) AS turns, min_by(text, turn) FILTER (role = 'user') AS first_message FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 40""")
def agg14(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_message")).orderBy(F.desc("conv_id")).limit(40)


@query("agg15_harness", "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS completed, count(*) AS runs FROM orders GROUP BY 1")
def agg15(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("completed"), F.count("*").alias("runs"))


@query("agg16_percentiles", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def agg16(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(A.percentile("value", 0.5), 6).alias("p50"), F.round(A.percentile("value", 0.95), 6).alias("p95"))


@query("agg17_median", "SELECT user_id, round(median(value), 6) AS median FROM events GROUP BY 1")
def agg17(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("median"))


@query("agg19_freeze_counts", "SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'reviewer' || doc_id % 3 END, 'first') AS reviewer, quality, count(*) AS n FROM labels GROUP BY ALL")
def agg19(spark, d):
    who = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("reviewer"), (F.col("doc_id") % 3).cast("string")))
    return table(spark, d, "labels").groupBy(F.coalesce(who, F.lit("first")).alias("reviewer"), "quality").agg(F.count("*").alias("n"))


@query("agg20_calibration_tallies", """
SELECT count(*) FILTER (doc_id % 4 = 0) AS anchored, count(*) FILTER (doc_id % 4 <> 0) AS fresh, count(*) FILTER (toxic = 1) AS unsuitable, count(*) FILTER (quality = 1 AND toxic = 0) AS suitable FROM labels""")
def agg20(spark, d):
    k = F.col("doc_id") % 4
    return table(spark, d, "labels").agg(
        F.count_if(k == 0).alias("anchored"), F.count_if(k != 0).alias("fresh"), F.count_if(F.col("toxic") == 1).alias("unsuitable"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("suitable"))


@query("agg21_claims", """
WITH r AS (SELECT o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT unnest(['F', 'O', 'P', 'X']) AS outcome, unnest([5000, 1, 2, 3]) AS claimed)
SELECT coalesce(r.outcome, c.outcome) AS outcome, coalesce(n, 0) = coalesce(claimed, 0) AS agrees FROM r FULL JOIN c ON r.outcome = c.outcome""")
def agg21(spark, d):
    claimed = spark.createDataFrame([("F", 5000), ("O", 1), ("P", 2), ("X", 3)], "outcome string, claimed long")
    counted = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return counted.join(claimed, "outcome", "full").select("outcome", (F.coalesce("n", F.lit(0)) == F.coalesce("claimed", F.lit(0))).alias("agrees"))


@query("ded01_exact_sources", """
WITH g AS (SELECT text, min(doc_id) AS canonical, count(*) AS members FROM documents GROUP BY text)
SELECT doc_id AS member, canonical, sha256(d.text) AS sha256, members FROM documents d JOIN g ON d.text = g.text""")
def ded01(spark, d):
    return A.exact_sources(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("ded02_duplicate_status", """
WITH x AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CAST(l_partkey AS VARCHAR) AS c FROM lineitem),
y AS (SELECT *, row_number() OVER (PARTITION BY c, n = 1 ORDER BY l_linenumber, l_partkey, l_suppkey, id) AS m FROM x)
SELECT id, l_linenumber, l_partkey, CASE WHEN n > 1 THEN 'duplicate_id' WHEN m > 1 THEN 'duplicate_content' ELSE 'accepted' END AS status FROM y""")
def ded02(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    return A.duplicate_status(li, "id", F.col("l_partkey").cast("string"), ["l_linenumber", "l_partkey", "l_suppkey", "id"]).drop("l_suppkey")


@query("ded03_content_hash", f"""
WITH {RECIPES_SQL} SELECT source_id, sha256(lower(trim(title)) || chr(31) || array_to_string(names, ',') || chr(31) || CAST(okey AS VARCHAR)) AS content_hash FROM recipes""")
def ded03(spark, d):
    return recipes(spark, d).select("source_id", A.content_hash(T.plain(F.col("title")), F.array_join("names", ","), F.col("okey").cast("string")).alias("content_hash"))


@query("ded04_near_key", f"""
WITH {RECIPES_SQL}, k AS (SELECT substring(sha256(lower(title) || chr(31) || array_to_string(list_sort(list_distinct(names)), ',')), 1, 16) AS dup FROM recipes)
SELECT dup, count(*) AS n FROM k GROUP BY dup HAVING count(*) > 1""")
def ded04(spark, d):
    dup = F.substring(A.content_hash(T.plain(F.col("title")), F.array_join(F.array_sort(F.array_distinct("names")), ",")), 1, 16)
    return recipes(spark, d).groupBy(dup.alias("dup")).agg(F.count("*").alias("n")).filter("n > 1")


@query("ded05_first_seen_documents", """
WITH h AS (SELECT l_suppkey AS case_id, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem),
b AS (SELECT case_id, doc, min(rank) AS rank FROM h GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, doc) AS place FROM b""")
def ded05(spark, d):
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey")
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("doc"), F.row_number().over(order).cast("long").alias("rank"))
    return A.first_seen(h, "case_id", "doc", "rank").withColumn("place", F.col("place").cast("long"))


@query("ded06_pool", "SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings UNION SELECT item_id FROM benchmark")
def ded06(spark, d):
    ids = [table(spark, d, t).select(F.col(c).alias("doc_id")) for t, c in (("labels", "doc_id"), ("embeddings", "vec_id"), ("benchmark", "item_id"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct().orderBy("doc_id")


@query("srt01_ordered_limit", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey LIMIT 25")
def srt01(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderpriority", "o_orderkey").limit(25).select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("srt02_first_per_parent", f"WITH {RECIPES_SQL} SELECT source_id, array_to_string(list_transform(list_slice(names, 1, 3), lambda x: substring(x, 1, 6)), ',') AS first FROM recipes")
def srt02(spark, d):
    return recipes(spark, d).select("source_id", F.array_join(F.transform(F.slice("names", 1, 3), lambda x: F.substring(x, 1, 6)), ",").alias("first"))


@query("srt03_ranged_slice", f"WITH {RECIPES_SQL} SELECT source_id, array_to_string(list_slice(names, 2, 4), ',') AS part FROM recipes")
def srt03(spark, d):
    return recipes(spark, d).select("source_id", F.array_join(L.ranged(F.col("names"), 1, 4), ",").alias("part"))


@query("srt04_stride_sample", """
WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT o_orderkey, r FROM o, n WHERE r IN (SELECT 1 + CAST(floor(i * n / 100.0) AS BIGINT) FROM range(100) t(i))""")
def srt04(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return L.stride_sample(o, "o_orderkey", 100)


@query("srt05_audit_sample", "SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20")
def srt05(spark, d):
    return L.hash_ordered(table(spark, d, "documents"), "doc_id", 7).limit(20).select("doc_id")


@query("srt06_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY sha256('11:' || doc_id), doc_id) AS place FROM labels WHERE toxic = 1")
def srt06(spark, d):
    pool = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return L.numbered(pool, "h").select("doc_id", F.col("r").alias("place"))


@query("srt07_budget_fit", """
WITH s AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey) AS sizes FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_reduce(list_prepend(CAST(0 AS BIGINT), sizes), lambda a, x: CASE WHEN a + x <= 60 THEN a + x ELSE a END) AS used FROM s""")
def srt07(spark, d):
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")))), lambda s: s["q"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(sizes.alias("sizes")).select("l_orderkey", L.greedy_fit(F.col("sizes"), 60)["used"].alias("used"))


@query("srt08_token_packing", """
WITH s AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey) AS sizes FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_reduce(list_prepend({'b': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}, list_transform(sizes, lambda x: {'b': CAST(0 AS BIGINT), 'n': CAST(1 AS BIGINT), 't': x})),
  lambda a, x: CASE WHEN a.b > 0 AND a.n < 3 AND a.t + x.t <= 80 THEN {'b': a.b, 'n': a.n + 1, 't': a.t + x.t} ELSE {'b': a.b + 1, 'n': CAST(1 AS BIGINT), 't': x.t} END).b AS batches FROM s""")
def srt08(spark, d):
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")))), lambda s: s["q"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(sizes.alias("sizes")).select("l_orderkey", L.next_fit(F.col("sizes"), 3, 80)["batches"].alias("batches"))


@query("srt09_segments", """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, ls, CAST(ceil(len(ls) / 4.0) AS BIGINT) AS parts FROM s),
l AS (SELECT doc_id, parts, (generate_subscripts(ls, 1) - 1) // 4 AS seg, unnest(ls) AS line FROM n)
SELECT doc_id, 'seg' || (seg + 1) || 'of' || parts AS segment, count(*) AS lines FROM l GROUP BY ALL""")
def srt09(spark, d):
    ls = F.split("text", "\n")
    rows = table(spark, d, "documents").select("doc_id", F.ceil(F.size(ls) / 4).alias("parts"), F.posexplode(ls).alias("pos", "line"))
    seg = F.concat(F.lit("seg"), (F.expr("pos div 4") + 1).cast("string"), F.lit("of"), F.col("parts").cast("string"))
    return rows.groupBy("doc_id", seg.alias("segment")).agg(F.count("*").alias("lines"))


@query("srt10_tail_budget", """
WITH t AS (SELECT conv_id, turn, length(text) + 1 AS n FROM conversations), c AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t)
SELECT conv_id, turn FROM c WHERE used <= 600 OR r = 1""")
def srt10(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") + 1).alias("n"))
    return L.tail_budget(rows, "conv_id", "turn", "n", 600).select("conv_id", "turn")


@query("srt11_newest_groups", """
WITH t AS (SELECT conv_id, turn, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
s AS (SELECT conv_id, g, sum(n) AS n FROM t GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY g DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY g DESC) AS r FROM s)
SELECT t.conv_id, t.turn FROM t JOIN c ON t.conv_id = c.conv_id AND t.g = c.g WHERE used <= 1500 OR r = 1""")
def srt11(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (F.col("role") == "user").alias("opens"))
    return L.newest_groups(rows, "conv_id", "turn", "opens", "n", 1500).select("conv_id", "turn")


@query("srt13_stratified", """
WITH r AS (SELECT source, lang, doc_id, CASE WHEN contains(text, '|') THEN 'bars' WHEN contains(text, '!!') THEN 'shouting' END AS failing FROM documents)
SELECT source, lang, m.d AS doc_id, m.f AS failing FROM (SELECT source, lang, min({'d': doc_id, 'f': failing}) AS m FROM r GROUP BY ALL)""")
def srt13(spark, d):
    failing = F.when(F.col("text").contains("|"), "bars").when(F.col("text").contains("!!"), "shouting")
    s = F.min(F.struct("doc_id", failing.alias("failing")))
    return table(spark, d, "documents").groupBy("source", "lang").agg(s.alias("s")).select("source", "lang", "s.doc_id", "s.failing")
