"""Queries that write: each makes a store of its own in the shared folder, changes it, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ingest as I
from ..operators.committed import Store
from ..operators.storage import fresh_folder
from ..sources.tables import table

#: Buckets of the stores of these queries: few, as their tables are small.
BUCKETS = 8


def _store(spark) -> Store:
    return Store(spark, fresh_folder(spark, "store"))


def _committed(store, *changes):
    """One transaction of (method, table, rows, keys, more); returns it."""
    t = store.begin()
    for method, name, rows, keys, more in changes:
        getattr(t, method)(name, rows, keys, buckets=BUCKETS, **more)
    t.commit()
    return t


@query("snk01_committed_snapshot", """
SELECT n_nationkey, n_regionkey, n_name || CASE WHEN n_regionkey = 1 THEN '+' ELSE '' END AS n_name FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey + 100, 1, n_name FROM nation WHERE n_regionkey = 2""")
def snk01_committed(spark, d):
    """A region's nations replaced as a whole: some change, some go, some are new."""
    n, store = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name"), _store(spark)
    _committed(store, ("upsert", "nation", n, ["n_nationkey"], {}))
    own = n.filter("n_regionkey = 1 AND n_nationkey % 2 = 0").withColumn("n_name", F.concat("n_name", F.lit("+")))
    more = n.filter("n_regionkey = 2").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.lit(1).cast(n.schema["n_regionkey"].dataType).alias("n_regionkey"), "n_name")
    _committed(store, ("replace", "nation", own.unionByName(more.select(*n.columns)).select(*(F.col(f.name).cast(f.dataType) for f in n.schema)), ["n_nationkey"], {"scope": F.col("n_regionkey") == 1}))
    return store.read("nation")


@query("snk02_committed_upsert", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE 'first' END AS run
FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_totalprice, 'again' FROM orders WHERE o_orderstatus = 'P'""")
def snk02_committed(spark, d):
    """Orders of two states first; then one of them again with other prices, and those of a third."""
    o, store = table(spark, d, "orders"), _store(spark)
    rows = lambda df, price, run: df.select("o_orderkey", price.alias("price"), F.lit(run).alias("run"))
    p = F.col("o_totalprice")
    _committed(store, ("upsert", "orders", rows(o.filter("o_orderstatus <> 'P'"), p, "first"), ["o_orderkey"], {}))
    again = rows(o.filter("o_orderstatus = 'F'"), p * 2, "again").unionByName(rows(o.filter("o_orderstatus = 'P'"), p, "again"))
    _committed(store, ("upsert", "orders", again, ["o_orderkey"], {}))
    return store.read("orders")


_STATUS = r"""CASE WHEN length(text) < 30 THEN 'quarantined' WHEN regexp_matches(text, '[*#$%&]{3}') THEN 'rejected' ELSE 'accepted' END"""


@query("snk04_ingest_transaction", f"""
WITH s AS (SELECT doc_id, source, {_STATUS} AS status FROM documents)
SELECT source AS import_id, count(*) FILTER (status = 'accepted') AS ready, count(*) FILTER (status <> 'accepted') AS quarantined, 2 AS version, 0 AS written_again FROM s GROUP BY source""")
def snk04_committed(spark, d):
    """Ready rows, quarantine and ledger of each import in one transaction; a second run of it commits nothing."""
    docs = I.normalised(table(spark, d, "documents")).select("dataset_id", "source_id", "status", F.col("document.content_hash").alias("content_hash"))
    store = _store(spark)
    first = docs.filter("dataset_id = 'src0'")
    again = None
    for rows in (first, docs, docs):
        ready = rows.filter("status = 'accepted'").drop("status")
        bad = rows.filter("status <> 'accepted'").select(F.col("dataset_id").alias("import_id"), F.col("source_id").alias("row_number"), "status")
        ledger = rows.groupBy(F.col("dataset_id").alias("import_id")).agg(F.count("*").alias("rows"))
        again = _committed(
            store, ("upsert", "ready", ready, ["dataset_id", "source_id"], {}), ("upsert", "quarantine", bad, ["import_id", "row_number"], {}),
            ("upsert", "ledger", ledger, ["import_id"], {"only_new": True}))
    rewritten = sum(n for counts in again.counts.values() for n in counts.values())
    ready = store.read("ready").groupBy(F.col("dataset_id").alias("import_id")).agg(F.count("*").alias("ready"))
    bad = store.read("quarantine").groupBy("import_id").agg(F.count("*").alias("quarantined"))
    none = F.lit(0).cast("long")
    return store.read("ledger").join(ready, "import_id", "left").join(bad, "import_id", "left").select(
        "import_id", F.coalesce("ready", none).alias("ready"), F.coalesce("quarantined", none).alias("quarantined"), F.lit(store.version()).alias("version"),
        F.lit(rewritten).alias("written_again"))


@query("inc04_committed_manifest", """
WITH w AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM w)) AS deleted, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM w)) AS left, true AS as_wanted, 0 AS rerun_deletes""")
def inc04_committed(spark, d):
    """A manifest of documents to delete, checked before, applied, checked after, and applied once more."""
    docs, store = table(spark, d, "documents").select("doc_id", "lang"), _store(spark)
    wanted = table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    _committed(store, ("upsert", "documents", docs.withColumn("condemned", F.lit(False)), ["doc_id"], {}))

    def apply():
        marked = store.read("documents").join(wanted, "doc_id", "left_semi").withColumn("condemned", F.lit(True))
        _committed(store, ("upsert", "documents", marked, ["doc_id"], {}))
        return _committed(store, ("replace", "documents", store.read("documents").limit(0), ["doc_id"], {"scope": F.col("condemned")})).counts["documents"]["deleted"]

    deleted, rerun = apply(), apply()
    left = store.read("documents")
    ok = left.join(wanted, "doc_id", "left_semi").limit(1).count() == 0
    return left.agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("left"), F.lit(ok).alias("as_wanted"), F.lit(rerun).alias("rerun_deletes"))
