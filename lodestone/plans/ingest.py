"""Queries: sources, sinks and incremental work. Files go to a folder of their own."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import ingest as I
from ..operators.storage import fresh_folder
from ..sources.tables import table


def _folder(spark) -> str:
    return fresh_folder(spark, "io")


@query("src01_strict_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def src01(spark, d):
    at = _folder(spark)
    table(spark, d, "supplier").write.option("header", True).csv(at)
    return I.read_csv(spark, at, ["s_suppkey", "s_name"])


@query("src02_numbered_texts", "SELECT row_number() OVER (ORDER BY s_suppkey) AS row_number, s_name AS texts FROM supplier")
def src02(spark, d):
    at = _folder(spark)
    table(spark, d, "supplier").orderBy("s_suppkey").select(F.col("s_name").alias("texts")).write.option("header", True).csv(at)
    return I.read_texts(spark, at)


@query("src04_json_lines", "SELECT c_custkey, c_mktsegment FROM customer")
def src04(spark, d):
    at = _folder(spark)
    table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit(" x")).alias("c_mktsegment")).write.json(at)
    read = I.read_jsonl(spark, at, "c_custkey long, c_mktsegment string")
    return read.select("record.c_custkey", F.regexp_replace("record.c_mktsegment", " x$", "").alias("c_mktsegment"))


@query("snk01_dataset_replace", "SELECT n_regionkey, n_name || CASE WHEN n_regionkey = 1 THEN '+' ELSE '' END AS n_name FROM nation")
def snk01(spark, d):
    at = _folder(spark)
    n = table(spark, d, "nation").select("n_regionkey", "n_name")
    I.write_dataset(n, at, "n_regionkey")
    I.write_dataset(n.filter("n_regionkey = 1").withColumn("n_name", F.concat("n_name", F.lit("+"))), at, "n_regionkey")
    return spark.read.parquet(at).select("n_regionkey", "n_name")


@query("snk02_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def snk02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    new = o.filter("o_orderstatus = 'F'").withColumn("price", F.col("price") * 2)
    return I.upserted(o, new, ["o_orderkey"]).select("o_orderkey", "price")


@query("snk03_quarantine_upsert", """
SELECT doc_id, CASE WHEN length(text) < 60 THEN 'rejected' ELSE 'quarantined' END AS status FROM documents WHERE length(text) < 120""")
def snk03(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") < 120)
    stored = docs.select("doc_id", F.lit("quarantined").alias("status"))
    return I.upserted(stored, docs.filter(F.length("text") < 60).select("doc_id", F.lit("rejected").alias("status")), ["doc_id"])


@query("snk04_ledger_insert", "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'old' ELSE 'new' END AS run FROM nation")
def snk04(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    return I.inserted(n.filter("n_nationkey < 10").withColumn("run", F.lit("old")), n.withColumn("run", F.lit("new")), ["n_nationkey"])


@query("snk05_json_sink", "SELECT p_partkey, p_name FROM part")
def snk05(spark, d):
    at = _folder(spark)
    table(spark, d, "part").select("p_partkey", "p_name").write.json(at)
    return spark.read.schema("p_partkey long, p_name string").json(at)


@query("snk06_atomic_cache", "SELECT p_size, count(*) AS entries, true AS fresh, true AS stale FROM part GROUP BY p_size")
def snk06(spark, d):
    """A result per part, stored under the hash of its request and its renderer's version: fresh for that version only."""
    from ..functions.manifest import object_hash
    from ..operators.committed import Store

    part, store = table(spark, d, "part"), Store(spark, fresh_folder(spark, "cache"))
    asked = part.select("p_partkey", "p_size", object_hash({"id": F.col("p_partkey")}).alias("key"))
    t = store.begin()
    t.upsert("results", part.select(object_hash({"id": F.col("p_partkey")}).alias("key"), F.lit("1").alias("renderer"), F.upper("p_name").alias("value")), ["key"])
    t.commit()
    found = asked.join(store.read("results"), "key", "left")
    return found.groupBy("p_size").agg(
        F.count("*").alias("entries"), F.bool_and(F.coalesce(F.col("renderer") == "1", F.lit(False))).alias("fresh"),
        F.bool_and(F.coalesce(F.col("renderer") != "2", F.lit(True))).alias("stale"))


@query("snk07_changed_documents", "SELECT doc_id, lang FROM documents WHERE doc_id % 10 = 0")
def snk07(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    stored = docs.withColumn("sha256", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("sha256")))
    return I.changed(stored, docs, "doc_id", "sha256").select("doc_id", "lang")


@query("snk08_rebuild_counts", "SELECT count(*) AS checked, count(*) FILTER (doc_id % 7 = 0) AS would_update FROM documents")
def snk08(spark, d):
    docs = table(spark, d, "documents").withColumn("search_text", F.when(F.col("doc_id") % 7 == 0, None).otherwise(T.collapsed(F.col("text"))))
    return I.rebuilt(docs, "search_text", T.collapsed(F.col("text")))[1]


def _schema_json(*fields: tuple[str, str]) -> str:
    return '{"fields":[' + ",".join(f'{{"metadata":{{}},"name":"{n}","nullable":true,"type":"{t}"}}' for n, t in fields) + '],"type":"struct"}'


_DOCUMENTS = _schema_json(("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))
_LABELS = _schema_json(("doc_id", "long"), ("quality", "integer"), ("toxic", "integer"))


@query("snk09_schema_pins", f"SELECT 'documents' AS name, sha256('{_DOCUMENTS}') AS pin, true AS unchanged UNION ALL SELECT 'labels', sha256('{_LABELS}'), true")
def snk09(spark, d):
    from ..functions.manifest import canonical_hash, verify_frozen

    schemas = {n: table(spark, d, n).schema.jsonValue() for n in ("documents", "labels")}
    pins = {n: canonical_hash(s) for n, s in schemas.items()}
    return spark.createDataFrame([(n, h, not verify_frozen(schemas, pins)) for n, h in pins.items()], "name string, pin string, unchanged boolean")


@query("inc01_unchanged_skipped", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) OR doc_id % 13 = 0")
def inc01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    ledger = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").withColumn("identity", F.when(F.col("doc_id") % 13 == 0, "stale").otherwise(F.col("identity")))
    return I.changed(ledger, docs, "doc_id", "identity").select("doc_id")


@query("inc02_recheck_before_commit", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def inc02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("now"))
    made = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "before").otherwise(F.col("now")).alias("then"))
    return made.join(docs, "doc_id").filter("then = now").select("doc_id")


@query("inc03_missing_or_stale", "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'stale' END AS why FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR label = 4")
def inc03(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") == 4, "old").otherwise("current").alias("version"))
    joined = table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").filter(~F.col("version").eqNullSafe("current"))
    return joined.select("doc_id", F.when(F.col("version").isNull(), "missing").otherwise("stale").alias("why"))


@query("inc04_manifest_apply", """
WITH w AS (SELECT doc_id FROM labels WHERE toxic = 1), e AS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM w)
SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM w)) AS deleted, (SELECT count(*) FROM e) AS left, 0 AS rerun_deletes""")
def inc04(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    manifest = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    after = docs.join(manifest, "doc_id", "left_anti")
    rerun = after.join(manifest, "doc_id", "left_semi").agg(F.count("*").cast("int").alias("rerun_deletes"))
    return docs.join(manifest, "doc_id", "left_semi").agg(F.count("*").alias("deleted")).crossJoin(after.agg(F.count("*").alias("left"))).crossJoin(rerun)


@query("inc06_batch_reconciliation", """
SELECT count(*) FILTER (a.doc_id IS NULL) AS unknown, count(*) FILTER (b.vec_id IS NULL) AS missing, count(*) FILTER (a.doc_id IS NOT NULL AND b.vec_id IS NOT NULL) AS matched FROM labels a FULL JOIN embeddings b ON a.doc_id = b.vec_id""")
def inc06(spark, d):
    a = table(spark, d, "labels").select(F.col("doc_id").alias("a"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("b"))
    n = F.count_if
    return a.join(b, F.col("a") == F.col("b"), "full").agg(
        n(F.col("a").isNull()).alias("unknown"), n(F.col("b").isNull()).alias("missing"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"))
