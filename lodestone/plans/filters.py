"""Queries: predicates, projections and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import requests as Q
from ..functions import text as T
from ..operators import filters as P
from ..sources.tables import RECIPES_SQL, recipes, table

WANTED = ["red bolt", "blue widget", "small ring"]
_WANTED = "['red bolt', 'blue widget', 'small ring']"


@query("src03_parquet_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def src03(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src05_document_scan", "SELECT source AS dataset_id, doc_id AS source_id, n_chars FROM documents")
def src05(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("source_id"), "n_chars")


@query("src07_numbered_lines", """
WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line,
  generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS n FROM documents)
SELECT doc_id, 'L' || n AS line_id, length(line) AS chars FROM l""")
def src07(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line")).select(
        "doc_id", F.concat(F.lit("L"), (F.col("pos") + 1).cast("string")).alias("line_id"), F.length("line").cast("long").alias("chars"))


@query("src06_unit_vectors", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
SELECT vec_id, CAST(len(e) AS INTEGER) AS dimension, round(norm, 6) AS norm, round(e[1] / norm, 6) AS first FROM n WHERE norm > 0 AND isfinite(norm)""")
def src06(spark, d):
    from ..operators.vectors import norm

    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("norm", norm(F.col("e"))).filter("norm > 0 and not isnan(norm)")
    return v.select("vec_id", F.size("e").alias("dimension"), F.round("norm", 6).alias("norm"), F.round(F.element_at("e", 1) / F.col("norm"), 6).alias("first"))


@query("src08_checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def src08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("flt01_duration_ceiling", f"""
WITH {RECIPES_SQL}
SELECT dataset_id, source_id, minutes FROM recipes WHERE minutes > 0 AND minutes <= 120 AND NOT isnan(minutes)""")
def flt01(spark, d):
    return recipes(spark, d).filter(P.under_ceiling(F.col("minutes"), 120)).select("dataset_id", "source_id", "minutes")


@query("flt02_total_status", f"""
WITH {RECIPES_SQL}
SELECT dataset_id, CASE WHEN minutes IS NULL THEN 'missing' WHEN isnan(minutes) OR isinf(minutes) THEN 'non_finite' WHEN minutes < 0 THEN 'negative'
  WHEN minutes = 0 THEN 'reported_zero_unverified' ELSE 'reported' END AS status, count(*) AS n FROM recipes GROUP BY ALL""")
def flt02(spark, d):
    return recipes(spark, d).groupBy("dataset_id", P.total_status(F.col("minutes")).alias("status")).agg(F.count("*").alias("n"))


@query("flt03_contains_all", f"WITH {RECIPES_SQL} SELECT dataset_id, source_id FROM recipes WHERE list_has_all(names, ['red bolt', 'small ring'])")
def flt03(spark, d):
    return recipes(spark, d).filter(P.contains_all(F.col("names"), ["red bolt", "small ring"])).select("dataset_id", "source_id")


@query("flt04_contains_any", f"WITH {RECIPES_SQL} SELECT dataset_id, source_id FROM recipes WHERE list_has_any(names, {_WANTED})")
def flt04(spark, d):
    return recipes(spark, d).filter(P.contains_any(F.col("names"), WANTED)).select("dataset_id", "source_id")


@query("flt05_overlap_count", f"""
WITH {RECIPES_SQL}, c AS (SELECT dataset_id, source_id, len(list_filter(names, lambda x: list_contains({_WANTED}, x))) AS overlap FROM recipes)
SELECT dataset_id, source_id, CAST(overlap AS BIGINT) AS overlap FROM c WHERE overlap > 0""")
def flt05(spark, d):
    return recipes(spark, d).select("dataset_id", "source_id", P.overlap_count(F.col("names"), WANTED).alias("overlap")).filter("overlap > 0")


@query("flt06_overlap_set", f"""
WITH {RECIPES_SQL}, c AS (SELECT dataset_id, source_id, len(list_intersect(list_distinct(names), {_WANTED})) AS overlap FROM recipes)
SELECT dataset_id, source_id, CAST(overlap AS BIGINT) AS overlap FROM c WHERE overlap > 0""")
def flt06(spark, d):
    return recipes(spark, d).select("dataset_id", "source_id", P.overlap_set(F.col("names"), WANTED).alias("overlap")).filter("overlap > 0")


@query("flt07_dataset_scope", f"WITH {RECIPES_SQL} SELECT source_id, title FROM recipes WHERE dataset_id = '2-HIGH'")
def flt07(spark, d):
    known = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return P.in_dataset(recipes(spark, d), "2-HIGH", known).select("source_id", "title")


@query("flt08_argument_problems", f"""
WITH {RECIPES_SQL} SELECT dataset_id, source_id, CASE WHEN okey % 7 = 0 OR NOT okey % 60 BETWEEN 1 AND 50 THEN 'query_or_limit' WHEN isnan(minutes) OR isinf(minutes) OR minutes <= 0 THEN 'max_minutes' END AS problem FROM recipes""")
def flt08(spark, d):
    asked = F.when(F.col("okey") % 7 == 0, " \t ").otherwise(F.col("title"))
    return recipes(spark, d).select("dataset_id", "source_id", P.search_problem(asked, F.col("okey") % 60, F.col("minutes")).alias("problem"))


@query("flt19_search_arguments", f"""
WITH {RECIPES_SQL}, a AS (SELECT source_id, CASE okey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || title || '  x ' ELSE repeat(title || ' ', 20) END AS dish, names, CASE okey % 4 WHEN 0 THEN 'soon' WHEN 1 THEN CAST(okey % 3000 AS VARCHAR) WHEN 2 THEN '12.5' END AS t FROM recipes),
b AS (SELECT *, trim(regexp_replace(dish, '\\s+', ' ', 'g')) AS whole, names[1:5] AS hints, try_cast(t AS DOUBLE) AS n FROM a)
SELECT source_id, substring(CASE WHEN whole = '' THEN array_to_string(hints, ' ') ELSE substring(whole, 1, 200) END, 1, 500) AS query, whole = '' AS by_overlap, array_to_string(hints, ',') AS hints,
  CASE WHEN n BETWEEN 1 AND 1440 THEN n END AS max_minutes, concat_ws(',', CASE WHEN length(whole) > 200 THEN 'dish_shortened' END, CASE WHEN len(names) > 5 THEN 'pantry_capped' END) AS changes FROM b""")
def flt19(spark, d):
    k = F.col("okey")
    dish = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), "title", F.lit("  x "))).otherwise(F.repeat(F.concat("title", F.lit(" ")), 20))
    minutes = F.when(k % 4 == 0, "soon").when(k % 4 == 1, (k % 3000).cast("string")).when(k % 4 == 2, "12.5")
    return recipes(spark, d).select("source_id", Q.search_columns(dish, F.col("names"), minutes).alias("a")).select(
        "source_id", "a.query", "a.by_overlap", F.array_join("a.hints", ",").alias("hints"), "a.max_minutes", F.array_join("a.changes", ",").alias("changes"))


@query("flt09_current_versions", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax = 0.03 AND l_linenumber = 2""")
def flt09(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0.03) & (F.col("l_linenumber") == 2)).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("flt12_violations", f"""
WITH {RECIPES_SQL}, v AS (SELECT dataset_id, source_id,
  CASE WHEN dataset_id <> '2-HIGH' THEN 'dataset' END AS a,
  CASE WHEN NOT coalesce(minutes > 0 AND minutes <= 60 AND NOT isnan(minutes), false) THEN 'time' END AS b FROM recipes)
SELECT dataset_id, source_id, concat_ws(',', a, b) AS violations FROM v WHERE a IS NOT NULL OR b IS NOT NULL""")
def flt12(spark, d):
    v = P.violations(F.col("minutes"), 60, F.col("dataset_id"), F.lit("2-HIGH"))
    return recipes(spark, d).select("dataset_id", "source_id", F.concat_ws(",", v).alias("violations")).filter("violations <> ''")


@query("flt13_evidence_summary", r"""
WITH t AS (SELECT source AS dataset_id, doc_id AS source_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS steps, lang FROM documents),
s AS (SELECT *, trim(regexp_replace(array_to_string(list_slice(steps, 1, 2), ' | '), '\s+', ' ', 'g')) AS joined FROM t)
SELECT dataset_id, source_id, CASE WHEN length(joined) <= 600 THEN joined ELSE rtrim(substring(joined, 1, 600)) || '…' END AS excerpt,
  CAST(len(steps) AS BIGINT) AS n_steps, CASE WHEN lang = 'en' THEN '' ELSE 'language' END AS unknown FROM s""")
def flt13(spark, d):
    steps = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    docs = table(spark, d, "documents").withColumn("steps", steps)
    return docs.select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("source_id"), T.excerpt(F.array_join(F.slice("steps", 1, 2), " | ")).alias("excerpt"),
        F.size("steps").cast("long").alias("n_steps"), F.when(F.col("lang") == "en", "").otherwise("language").alias("unknown"))


@query("flt14_candidate_admission", """
SELECT source AS dataset_id, doc_id AS source_id, length(text) >= 40 AND contains(text, chr(10)) AND NOT contains(text, '***') AS recommendable,
  CASE WHEN contains(text, '***') THEN 'error' WHEN length(text) < 40 THEN 'omitted' ELSE '' END AS defect FROM documents""")
def flt14(spark, d):
    t = F.col("text")
    issues = F.array_compact(F.array(F.when(t.contains("***"), F.struct(F.lit("symbols").alias("code"), F.lit("error").alias("severity")))))
    admitted = (F.length(t) >= 40) & t.contains("\n") & ~F.exists(issues, lambda q: q["severity"] == "error")
    return table(spark, d, "documents").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("source_id"), admitted.alias("recommendable"),
        F.when(t.contains("***"), "error").when(F.length(t) < 40, "omitted").otherwise("").alias("defect"))


@query("flt15_malformed", "SELECT doc_id FROM documents WHERE source = 'src0' AND text = (SELECT min(text) FROM documents WHERE source = 'src0')")
def flt15(spark, d):
    docs = table(spark, d, "documents").filter("source = 'src0'")
    return docs.join(F.broadcast(docs.agg(F.min("text").alias("text"))), "text", "left_semi").select("doc_id")


@query("flt16_defect_flags", """
SELECT lang, count(*) FILTER (contains(text, '|') OR contains(text, '!!')) AS defective, count(*) FILTER (contains(text, chr(10))) AS with_lines, count(*) AS n
FROM documents GROUP BY lang""")
def flt16(spark, d):
    t = F.col("text")

    def issue(cond, severity):
        return F.when(cond, F.struct(F.lit(severity).alias("severity")))

    issues = F.array_compact(F.array(issue(t.contains("|"), "warning"), issue(t.contains("!!"), "error"), issue(t.contains("."), "info")))
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count_if(P.defective(issues)).alias("defective"), F.count_if(t.contains("\n")).alias("with_lines"), F.count("*").alias("n"))


@query("flt17_capabilities", f"""
WITH {RECIPES_SQL}, b AS (SELECT dataset_id, source_id, len(names) > 1 AS ns, minutes > 0 AND NOT isnan(minutes) AS st, servings > 0 AS sv FROM recipes)
SELECT dataset_id, source_id, true AS searchable, coalesce(st, false) AS evidence_usable, coalesce(st, false) AND ns AS quantities_validated,
  coalesce(st, false) AND ns AS complete_eligible, coalesce(st, false) AND ns AND sv AS scalable FROM b""")
def flt17(spark, d):
    many, timed = F.size("names") > 1, P.under_ceiling(F.col("minutes"), float("inf"))
    c = P.capabilities(F.lit(True), F.size("names") > 0, F.lit(True), many, F.col("servings") > 0, many, timed)
    return recipes(spark, d).select("dataset_id", "source_id", c.alias("c")).select("dataset_id", "source_id", "c.*")


@query("flt18_readiness", """
SELECT c_custkey, CASE WHEN c_acctbal < -500 AND c_mktsegment = 'BUILDING' THEN 'conflicting' WHEN c_acctbal < -500 THEN 'blocked'
  WHEN c_acctbal < 1000 THEN 'needs_clarification' ELSE 'ready' END AS readiness FROM customer""")
def flt18(spark, d):
    low = F.col("c_acctbal") < -500
    return table(spark, d, "customer").select(
        "c_custkey", P.readiness(low & (F.col("c_mktsegment") == "BUILDING"), low, F.col("c_acctbal") < 1000).alias("readiness"))


@query("flt20_quality_routing", """
WITH r AS (SELECT doc_id, CASE WHEN length(text) < 30 THEN 'too_short' END AS a, CASE WHEN contains(text, '###') OR contains(text, '%%%') THEN 'symbols' END AS b,
  CASE WHEN contains(text, ' | ') THEN 'list_only' END AS c FROM documents)
SELECT doc_id, CASE WHEN a IS NOT NULL THEN 'quarantine' WHEN b IS NOT NULL OR c IS NOT NULL THEN 'needs_review' ELSE 'deterministic_accept' END AS route,
  concat_ws(',', c, b, a) AS reasons FROM r""")
def flt20(spark, d):
    t = F.col("text")
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(F.length(t) < 30, "too_short"), F.when(t.contains("###") | t.contains("%%%"), "symbols"), F.when(t.contains(" | "), "list_only")))))
    route = F.when(F.array_contains("r", "too_short"), "quarantine").when(F.size("r") > 0, "needs_review").otherwise("deterministic_accept")
    return table(spark, d, "documents").select("doc_id", reasons.alias("r")).select("doc_id", route.alias("route"), F.array_join("r", ",").alias("reasons"))


@query("flt21_ordered_pattern", f"""
WITH {RECIPES_SQL} SELECT source_id, title FROM recipes WHERE title ILIKE '%dish%ring%status%' ORDER BY dataset_id, source_id LIMIT 10""")
def flt21(spark, d):
    terms = F.array(F.lit("dish"), F.lit("of"), F.lit("ring"), F.lit("status"), F.lit("extra"))
    return recipes(spark, d).filter(P.ordered_pattern(F.col("title"), terms)).orderBy("dataset_id", "source_id").limit(10).select("source_id", "title")


@query("flt22_prefixes", "SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE 'Supplier#00000000%' OR s_name LIKE 'Supplier#00000002%'")
def flt22(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").filter(n.startswith("Supplier#00000000") | n.startswith("Supplier#00000002")).select("s_suppkey", "s_name")


@query("flt23_grounded_quote", r"""
WITH m AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS message FROM conversations)
SELECT conv_id, turn, length('the ') >= 4 AND contains(message, 'the th') AS supported FROM m""")
def flt23(spark, d):
    quote = T.plain(F.lit(" The  TH"))
    return table(spark, d, "conversations").select("conv_id", "turn", ((F.length(quote) >= 4) & T.plain(F.col("text")).contains(quote)).alias("supported"))


@query("flt24_same_sentence", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?;]+'), lambda s: regexp_matches(lower(s), '\bthe\b') AND regexp_matches(s, '[0-9]'))) > 0 AS ok FROM documents""")
def flt24(spark, d):
    ok = F.exists(F.split("text", r"[.!?;]+"), lambda s: F.lower(s).rlike(r"\bthe\b") & s.rlike("[0-9]"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(ok, F.lit(False)).alias("ok"))


@query("flt25_two_class_age", """
SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-01' - CASE WHEN event_type = 'error' THEN INTERVAL 10 DAY ELSE INTERVAL 25 DAY END""")
def flt25(spark, d):
    age = F.when(F.col("event_type") == "error", F.expr("interval 10 days")).otherwise(F.expr("interval 25 days"))
    return table(spark, d, "events").filter(F.col("ts") < F.expr("timestamp_ntz'2024-02-01'") - age).select("event_id")
