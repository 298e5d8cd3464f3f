"""Suggestions by bounds equal suggestions by comparing everything."""

import difflib
import random

from lodestone.operators import similar


def strings(seed, n):
    rng = random.Random(seed)
    base = ["red bolt", "blue bolt", "thunderbolts are loud things", "ring", "a", "ab", "", None, "Éclair", "eclairs", "aaaa", "aaab", "x" * 230, "x" * 229 + "y"]
    return base + ["".join(rng.choice("abcde r") for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_suggestions_against_all_pairs(spark):
    names, terms = strings(1, 220), [*strings(2, 60), "bolt", "red bolts", "zzz", "e"]
    got = similar.suggestions(
        spark.createDataFrame([(x, 1) for x in names], "name string, term int").repartition(3), spark.createDataFrame([(x, 1) for x in terms], "term string, name int"))
    want = []
    for t in sorted({t for t in terms if t}):
        near, part = [], []
        for n in sorted({n for n in names if n}):
            r = difflib.SequenceMatcher(None, n, t).ratio()
            if r >= 0.6:
                near.append((r, n))
            elif t in n or n in t:
                part.append(n)
        best = [(n, r) for r, n in sorted(near, reverse=True)] + [(n, None) for n in part]
        want += [(t, i, n, r) for i, (n, r) in enumerate(best[:8], 1)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 200


def test_no_names_or_terms(spark):
    none = spark.createDataFrame([], "name string, term string")
    one = spark.createDataFrame([("a", "a")], "name string, term string")
    assert similar.suggestions(none, one).collect() == [] and similar.suggestions(one, none).collect() == []
