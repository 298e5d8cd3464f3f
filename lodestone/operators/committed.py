"""Tables that change in whole versions: upserts, replacements and deletions that are really written.

A store is a folder of Parquet files and of manifests. Rows of a table lie in buckets by the hash of
their key; the manifest of a version says, per table and bucket, which folder holds it. A change
reads only the buckets that its rows touch, writes those of them whose rows differ, and leaves all
other files as they are. All tables of a transaction become visible together when its
manifest appears under the next version's name, which only one writer can give it: another
that started from the same version has a conflict and must begin again. What a killed
writer left behind belongs to no manifest, so readers never see it.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import _mounted, written

#: Buckets of a new table. They stay for its life: take about one per 128 MB that it will have.
BUCKETS = 16


class Conflict(Exception):
    """Another writer committed first."""


class Store:
    """Versioned tables below ``uri``."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{at}")

    def _names(self, at: str) -> list[str]:
        files, path = self._files(), self._path(at)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def version(self) -> int:
        """The newest version; 0 for a store without commits."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._files().open(self._path(f"versions/{version:010d}.json")), "UTF-8"))

    def _publish(self, manifest: dict) -> None:
        """Give the manifest its version's name, unless another has it."""
        name = f"versions/{manifest['version']:010d}.json"
        text = json.dumps(manifest, sort_keys=True)
        folder = _mounted(self.uri)
        if folder:  # a hard link appears whole, and only where there is none of that name
            os.makedirs(f"{folder}/versions", exist_ok=True)
            part = f"{folder}/versions/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(part, f"{folder}/{name}")
            except FileExistsError:
                raise Conflict(f"version {manifest['version']} exists") from None
            finally:
                os.unlink(part)
            return
        files, part = self._files(), self._path(f"versions/.{uuid.uuid4().hex}")
        out = files.create(part, False)
        out.write(text.encode())
        out.close()
        if files.exists(self._path(name)) or not files.rename(part, self._path(name)):
            files.delete(part, False)
            raise Conflict(f"version {manifest['version']} exists")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """All rows of a table at a version."""
        return self._rows(self.manifest(version)["tables"][table])

    def _rows(self, entry: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.uri}/{p}" for b, p in sorted(entry["buckets"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete old manifests but the newest ``keep``, and data that no manifest left names; not while others write."""
        newest = self.version()
        old = [v for v in range(1, newest - keep + 1)]
        for v in old:
            self._files().delete(self._path(f"versions/{v:010d}.json"), False)
        named = {p.split("/")[1] for v in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(v)["tables"].values() for p in t["buckets"].values()}
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            self._files().delete(self._path(f"data/{n}"), True)
        return gone


class Transaction:
    """Changes of several tables that appear together, or not at all."""

    def __init__(self, store: Store, base: dict):
        self.store, self.base = store, base
        self.tables = json.loads(json.dumps(base["tables"]))
        self.counts: dict[str, dict[str, int]] = {}

    def _entry(self, table: str, rows: DataFrame, keys: list[str], buckets: int) -> dict:
        if table not in self.tables:
            self.tables[table] = {"schema": json.loads(rows.schema.json()), "keys": keys, "count": buckets, "buckets": {}}
        entry = self.tables[table]
        if entry["keys"] != keys or [f["name"] for f in entry["schema"]["fields"]] != rows.columns:
            raise ValueError(f"{table} has the keys {entry['keys']} and other columns than {rows.columns}")
        return entry

    def upsert(self, table: str, rows: DataFrame, keys: list[str], only_new: bool = False, buckets: int = BUCKETS) -> None:
        """Rows in place of those of equal keys (nulls are equal), or only those of new keys (``only_new``).

        Several rows of one key are an error. A row that is already there as it is changes nothing.
        """
        entry = self._entry(table, rows, keys, buckets)
        self._change(table, entry, written(rows, "incoming"), keys, F.lit(False), only_new)

    def replace(self, table: str, rows: DataFrame, keys: list[str], scope: Column, buckets: int = BUCKETS) -> None:
        """Rows in place of all stored ones for which ``scope`` holds; with no rows, those are deleted."""
        entry = self._entry(table, rows, keys, buckets)
        self._change(table, entry, written(rows, "incoming"), keys, F.coalesce(scope, F.lit(False)), False)

    def _change(self, table: str, entry: dict, new: DataFrame, keys: list[str], scope: Column, only_new: bool) -> None:
        if new.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"several rows for {table} have one key")
        columns = new.columns
        bucket = F.pmod(F.xxhash64(*keys), F.lit(entry["count"])).cast("int")
        old = self.store._rows(entry)
        # which buckets differ: keys and digests of rows are compared, not rows moved
        digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        told = old.select(*keys, digest.alias("was"), scope.alias("goes"))
        said = new.select(*keys, digest.alias("is"))
        same = [told[k].eqNullSafe(said[k]) for k in keys]
        place = lambda x: F.pmod(F.xxhash64(*(x[k] for k in keys)), F.lit(entry["count"])).cast("int")
        both = told.join(said, same, "full").select(
            F.when(F.col("was").isNotNull(), place(told)).otherwise(place(said)).alias("bucket"), "was", "is", F.coalesce("goes", F.lit(False)).alias("goes"))
        kind = (
            F.when(F.col("was").isNull(), "inserted").when(F.col("is").isNull() & F.col("goes"), "deleted")
            .when(F.col("is").isNotNull() & (F.col("was") != F.col("is")) & F.lit(not only_new), "updated"))
        found = both.withColumn("kind", kind).filter("kind is not null").groupBy("bucket", "kind").agg(F.count("*").alias("n")).collect()  # a few per bucket
        self.counts[table] = {k: sum(r.n for r in found if r.kind == k) for k in ("inserted", "updated", "deleted")}
        touched = sorted({str(r.bucket) for r in found})
        if not touched:
            return
        stays = self.store._rows(entry, touched).filter(~scope)
        coming = new.filter(bucket.isin([int(b) for b in touched]))
        match = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
        if only_new:
            coming = coming.join(stays.select(*keys), match(coming, stays), "left_anti")
        else:
            stays = stays.join(coming.select(*keys), match(stays, coming), "left_anti")
        name = uuid.uuid4().hex
        rows = stays.unionByName(coming).withColumn("bucket_", bucket)
        rows.repartition(len(touched), "bucket_").write.partitionBy("bucket_").parquet(f"{self.store.uri}/data/{name}")
        full = {n.split("=")[1] for n in self.store._names(f"data/{name}") if n.startswith("bucket_=")}
        for b in touched:
            entry["buckets"].pop(b, None)
            if b in full:
                entry["buckets"][b] = f"data/{name}/bucket_={b}"

    def commit(self) -> int:
        """Publish the changes and return the version; without any, the version that was there."""
        if self.tables == self.base["tables"]:
            return self.base["version"]
        self.store._publish({"version": self.base["version"] + 1, "tables": self.tables})
        return self.base["version"] + 1
