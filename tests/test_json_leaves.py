"""Leaves of JSON texts against a walk in Python."""

import json

from pyspark.sql import functions as F

from lodestone.functions.json_leaves import leaves


def walk(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            plain = k.isascii() and k.isidentifier()
            yield from walk(v, f"{path}.{k}" if plain else f"{path}[{json.dumps(k, ensure_ascii=False)}]")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    else:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}[type(value)]
        text = None if kind in ("object", "array", "null") else str(value).lower() if kind == "boolean" else str(value)
        yield path, kind, text


def test_leaves_of_any_depth(spark):
    deep = 0
    for k in range(24):
        deep = {"d": deep} if k % 2 else [deep, "x"]
    texts = [
        '{"a": 1, "b": {"c": [true, null, {"d e": "x\\"y", "é": 2.5}], "e": {}, "f": []}}', '"just"', "[]", "{}", "3", "null", '[[1, [2, ["s"]]], {"": {"k": "v"}}]',
        json.dumps(deep), "{broken", "", None, '{"a": "{\\"b\\": 1}"}', '{"big": 123456789012345678901234567890}']
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, j string, path string").repartition(3)
    got = sorted((r.id, r.path, r.kind or "", r.value, r.malformed) for r in leaves(df.select("id", "j"), ["id"], "j").collect())
    want = []
    for i, t in enumerate(texts):
        if t is None:
            continue
        try:
            want += [(i, p, k, v, False) for p, k, v in walk(json.loads(t))]
        except ValueError:
            want.append((i, "$", "", None, True))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=repr)] or sorted(map(repr, got)) == sorted(map(repr, want))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_no_texts(spark):
    assert leaves(spark.createDataFrame([], "id long, j string"), ["id"], "j").collect() == []


def test_one_pass(spark):
    """Building the leaves runs no job, and nothing is written: no round per level."""
    df = spark.createDataFrame([(1, '{"a": [[1], {"b": {"c": [2]}}]}')], "id long, j string")
    spark.sparkContext.setJobGroup("leaves", "leaves")
    try:
        found = leaves(df, ["id"], "j")
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("leaves")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert sorted((r.path, r.value) for r in found.collect()) == [("$.a[0][0]", "1"), ("$.a[1].b.c[0]", "2")]


def test_odd_texts(spark):
    """A thousand levels, texts that go on after their value, names that stand twice, numbers as variants write them."""
    texts = [
        "[" * 1000 + "]" * 1000, "[" * 1001 + "]" * 1001, "[" * 100_000 + "]" * 100_000, '{"a": 1} x', '{"a": 1, "a": 2}', "NaN", '"\\ud800"',
        "[-0, 1.50, 1.0, 1e5, 9223372036854775808, -12, 123456789012345678901234567890123456789]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    got = {}
    for r in leaves(df, ["id"], "j").collect():
        got.setdefault(r.id, []).append((r.path, r.kind, r.value, r.malformed))
    assert got[0] == [("$" + "[0]" * 999, "array", None, False)]
    assert all(got[i] == [("$", None, None, True)] for i in (1, 2, 3, 4, 5))
    assert got[6] == [("$", "string", "?", False)]
    assert [x[1:3] for x in sorted(got[7])] == [
        ("integer", "0"), ("number", "1.5"), ("integer", "1"), ("number", "100000.0"), ("integer", "9223372036854775808"), ("integer", "-12"), ("number", "1.2345678901234568E38")]
