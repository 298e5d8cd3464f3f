"""Versioned tables: what is written, what is left alone, and who may commit."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators.committed import Conflict, Store

SCHEMA = "k long, d string, v double, a array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def data_files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def rows(store, table="t", version=None):
    return sorted((tuple(map(repr, r)) for r in store.read(table, version).collect()))


def shown(data):
    return sorted(tuple(map(repr, r)) for r in data)


FIRST = [(k, f"d{k % 3}", k / 2, ["x", None] if k % 2 else None) for k in range(60)] + [(None, "d9", None, [])]


def test_upsert_writes_only_what_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() == 0
    t = store.begin()
    t.upsert("t", frame(spark, FIRST), ["k"], buckets=8)
    assert t.commit() == 1 and rows(store) == shown(FIRST) and t.counts["t"] == {"inserted": 61, "updated": 0, "deleted": 0}
    before = data_files(tmp_path / "s")
    t = store.begin()
    t.upsert("t", frame(spark, FIRST[:40]), ["k"])  # all of it is there already
    assert t.commit() == 1 and data_files(tmp_path / "s") == before
    t = store.begin()
    t.upsert("t", frame(spark, [(3, "new", None, ["y"]), (None, "d9", 1.0, None), (4, *FIRST[4][1:])]), ["k"])
    assert t.counts["t"] == {"inserted": 0, "updated": 2, "deleted": 0} and t.commit() == 2
    want = [r for r in FIRST if r[0] not in (3, None)] + [(3, "new", None, ["y"]), (None, "d9", 1.0, None)]
    assert rows(store) == shown(want) and rows(store, version=1) == shown(FIRST)
    old, new = (store.manifest(v)["tables"]["t"]["buckets"] for v in (1, 2))
    assert 1 <= sum(old[b] != new[b] for b in old) <= 2 and set(old) == set(new)


def test_only_new_replacement_and_deletion(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    t = store.begin()
    t.upsert("t", frame(spark, FIRST), ["k"], buckets=4)
    t.commit()
    t = store.begin()
    t.upsert("t", frame(spark, [(1, "other", 0.0, None), (100, "other", 0.0, None)]), ["k"], only_new=True)
    assert t.counts["t"] == {"inserted": 1, "updated": 0, "deleted": 0}
    t.commit()
    assert rows(store) == shown([*FIRST, (100, "other", 0.0, None)])
    t = store.begin()
    t.replace("t", frame(spark, [(0, "d0", 7.0, None), (200, "d0", 8.0, None)]), ["k"], F.col("d") == "d0")
    assert t.counts["t"] == {"inserted": 1, "updated": 1, "deleted": 19} and t.commit() == 3
    want = [r for r in FIRST if r[1] != "d0"] + [(100, "other", 0.0, None), (0, "d0", 7.0, None), (200, "d0", 8.0, None)]
    assert rows(store) == shown(want)
    t = store.begin()
    t.replace("t", frame(spark, []), ["k"], F.lit(True))
    assert t.commit() == 4 and rows(store) == [] and rows(store, version=3) == shown(want)
    assert len(store.vacuum()) == 4 and rows(store) == [] and store.version() == 4


def test_one_of_two_writers_loses_and_no_table_changes_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one, two = store.begin(), store.begin()
    for t, v in ((one, 1.0), (two, 2.0)):
        t.upsert("t", frame(spark, [(1, "x", v, None)]), ["k"])
        t.upsert("ledger", spark.createDataFrame([("run", v)], "id string, v double"), ["id"])
    assert one.commit() == 1
    with pytest.raises(Conflict):
        two.commit()
    assert [r.v for r in store.read("t").collect()] == [1.0] and [r.v for r in store.read("ledger").collect()] == [1.0]
    again = store.begin()
    again.upsert("t", frame(spark, [(1, "x", 2.0, None)]), ["k"])
    assert again.commit() == 2 and [r.v for r in store.read("ledger").collect()] == [1.0]


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    t = store.begin()
    t.upsert("t", frame(spark, FIRST), ["k"])
    t.commit()
    t = store.begin()
    t.upsert("t", frame(spark, [(1, "lost", 1.0, None)]), ["k"])  # data written, never committed
    assert rows(store) == shown(FIRST) and store.version() == 1
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        t.commit()
    monkeypatch.undo()
    assert rows(store) == shown(FIRST) and os.listdir(tmp_path / "s" / "versions") == ["0000000001.json"]
    assert len(store.vacuum()) == 1 and rows(store) == shown(FIRST)
    json.dumps(store.manifest())


def test_repeated_keys_and_other_columns_are_errors(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.begin().upsert("t", frame(spark, [(1, "a", 1.0, None), (1, "b", 1.0, None)]), ["k"])
    t = store.begin()
    t.upsert("t", frame(spark, FIRST), ["k"])
    with pytest.raises(ValueError):
        t.upsert("t", spark.createDataFrame([(1,)], "k long"), ["k"])
    with pytest.raises(ValueError):
        t.upsert("t", frame(spark, FIRST), ["d"])
