"""SafeTensors files and checksums: round trips, row ranges, and faults that are refused."""

import hashlib
import json
import struct

import numpy as np
import pytest

from lodestone.sources import tensors as T


def test_matrices_by_row_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    matrix, ids = rng.normal(size=(1000, 7)).astype("<f4"), np.arange(1000, dtype="<i8") * 3
    path = f"{tmp_path}/m.safetensors"
    T.write_file(path, {"matrix": matrix, "ids": ids, "none": np.empty((0, 5), "<f8")}, {"vocab": "[1]"})
    header, start = T.header_of(path)
    assert header["__metadata__"] == {"vocab": "[1]"} and start % 1 == 0
    df = T.read_safetensors(spark, path, "matrix", partitionbytes=7 * 4 * 90)
    assert df.rdd.getNumPartitions() == 12
    got = sorted((r.row, r["values"]) for r in df.select("row", "values").collect())
    assert [k for k, _ in got] == list(range(1000)) and np.array_equal(np.array([v for _, v in got], "<f4"), matrix)
    assert sorted(r["values"][0] for r in T.read_safetensors(spark, path, "ids").collect()) == ids.tolist()
    assert T.read_safetensors(spark, path, "none").collect() == []


def test_written_by_tasks_and_read_as_a_folder(spark, tmp_path):
    rows = [(i, [float(i), i / 3, -1.0]) for i in range(500)] + [(None, [1.0, 2.0, 3.0]), (7000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    uri = f"file://{tmp_path}/folder"
    assert T.write_safetensors(df, uri, "id", "v", most_rows=100) >= 3
    ids = T.read_safetensors(spark, uri, "ids").selectExpr("file", "row", "cast(values[0] as long) as id")
    both = ids.join(T.read_safetensors(spark, uri, "matrix"), ["file", "row"]).collect()
    assert sorted((r.id, [np.float32(x) for x in r["values"]]) for r in both) == [(i, [np.float32(x) for x in v]) for i, v in rows[:500]]


def broken(tmp_path, name, header, data=b"\0" * 16):
    text = header if isinstance(header, bytes) else json.dumps(header).encode()
    path = tmp_path / f"{name}.safetensors"
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)
    return str(path)


def test_faults_are_refused(spark, tmp_path):
    one = lambda lo, hi, shape=(2, 2), kind="F32": {"dtype": kind, "shape": list(shape), "data_offsets": [lo, hi]}
    faults = {
        "gap": {"a": one(4, 20)}, "short": {"a": one(0, 8, (2,))}, "shape": {"a": one(0, 16, (3, 2))}, "type": {"a": one(0, 16, kind="X8")},
        "overlap": {"a": one(0, 16), "b": one(8, 24)}, "json": b"{nope", "list": [], "rest": {}}
    for name, header in faults.items():
        with pytest.raises(ValueError):
            T.header_of(broken(tmp_path, name, header))
    (tmp_path / "tiny.safetensors").write_bytes(b"abc")
    (tmp_path / "long.safetensors").write_bytes(struct.pack("<Q", 1 << 40) + b"{}")
    for name in ("tiny", "long"):
        with pytest.raises(ValueError):
            T.header_of(f"{tmp_path}/{name}.safetensors")
    T.write_file(f"{tmp_path}/nan.safetensors", {"m": np.array([[1.0, np.nan]]), "c": np.zeros((1, 1, 1))})
    assert T.read_safetensors(spark, f"{tmp_path}/nan.safetensors", "m", finite="false").count() == 1
    for tensor in ("m", "c", "absent"):
        with pytest.raises(Exception, match="not finite|dimensions|no tensor"):
            T.read_safetensors(spark, f"{tmp_path}/nan.safetensors", tensor).collect()


def test_checksums_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 1000)
    texts = {f"{tmp_path}/{i}.bin": bytes([i]) * (2500 * i) for i in range(4)}
    for path, data in texts.items():
        with open(path, "wb") as out:
            out.write(data)
    found = T.file_checksums(spark, list(texts))
    assert {r.path: (r.bytes, r.sha256) for r in found.collect()} == {p: (len(d), hashlib.sha256(d).hexdigest()) for p, d in texts.items()}
    pins = [(p, hashlib.sha256(d).hexdigest()) for p, d in texts.items()]
    assert T.verified(found, spark.createDataFrame(pins[:2], "path string, sha256 string")).count() == 2
    for wrong in ([(pins[0][0], "0" * 64)], [("/absent", pins[0][1])]):
        with pytest.raises(ValueError, match="checksums differ"):
            T.verified(found, spark.createDataFrame(wrong, "path string, sha256 string"))
    assert T.file_checksums(spark, []).collect() == []
