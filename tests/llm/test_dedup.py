"""Exact, substring and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import exact_dedup, jaccard_join, shared, substring_dedup

SCHEMA = "doc_id long, text string, n long, len int, keep_id string, id string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    shared = " ".join(words(rng, 40))
    base = words(rng, 120)
    for i in range(60):
        rows.append((i, " ".join(words(rng, rng.randrange(0, 90)))))
    for i in range(60, 75):
        rows.append((i, " ".join(words(rng, 20)) + "\n" + shared + " \t" + " ".join(words(rng, 15))))
    for i in range(75, 95):
        near = list(base)
        near[rng.randrange(120)] = "changed"
        rows.append((i, " ".join(near)))
    rows += [(95, "Same Text"), (96, "same text"), (97, "SAME TEXT"), (98, "same  text"), (99, None), (100, ""), (101, "äÄ"), (102, "ää"),
             (103, "x" * 9000 + "a"), (104, "x" * 9000 + "b"), (105, "x" * 9000 + "A"), (106, "one two"), (107, "one two"), (108, "   "),
             (109, " ".join(["again"] * 60)), (110, " ".join(["again"] * 30))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, "k", "x") for i, t in rows], SCHEMA).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_radix_against_groups(spark):
    rows = corpus() + [(200, "Same text"), (None, "null id"), (None, "null id")]
    got = exact_dedup.radix_dedup(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        own = [x for x in groups[lower(t)] if x is not None]
        want.append((i, max(own) if own else None, len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)


def test_radix_keeps_one_of_repeated_rows(spark):
    got = exact_dedup.radix_dedup(frame(spark, [(1, "a"), (1, "a"), (1, "b"), (0, "A")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 1, 3), (1, 1, 1), (1, 1, 3), (1, 1, 3)]
    assert sum(r.kept for r in got) == 2


@pytest.mark.parametrize("first,second", [(1, 2), (3, 5), (48, 4096)])
def test_radix_digits_do_not_matter(spark, monkeypatch, first, second):
    monkeypatch.setattr(exact_dedup, "FIRST", first)
    monkeypatch.setattr(exact_dedup, "SECOND", second)
    rows = [(i, t) for i, t in enumerate(["abcabc", "abcabd", "abcabc", "abcabcx", "ABCABC", "", "a", "A"])]
    got = {r.doc_id: r.group_size for r in exact_dedup.radix_dedup(frame(spark, rows)).collect()}
    assert got == {0: 3, 1: 1, 2: 3, 3: 1, 4: 3, 5: 1, 6: 2, 7: 2}


def brute_repeats(rows, width=13):
    starts = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            starts[k] = min(starts.get(k, i), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if starts[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("width", [13, 6, 3])
def test_repeats_against_all_windows(spark, width):
    rows = corpus(3) + [(-5, " ".join(["again"] * 14))]
    got = substring_dedup.mark_repeats(frame(spark, rows), width=width).collect()
    want = brute_repeats(rows, width)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)


def test_repeats_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(20))
    got = substring_dedup.mark_repeats(frame(spark, [(None, text), (4, text), (4, text), (5, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (4, 0), (4, 0), (5, 20)]


def brute_links(rows, width=5, threshold=0.8):
    sets = []
    for i, t in rows:
        w = (t or "").split()
        k = min(width, len(w))
        sets.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a in range(n):
        least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted((rows[a][0], least[find(a)], links[a]) for a in range(n))


def test_jaccard_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # several blocks in a bucket
    rng = random.Random(8)
    rows = corpus(5)
    base = words(rng, 150)
    for i in range(300, 340):  # a chain that drifts away from its start
        base = list(base)
        base[(i * 7) % 150] = f"drift{i}"
        rows.append((i, " ".join(base)))
    rows += [(400, rows[0][1]), (401, rows[0][1])]
    got = jaccard_join.jaccard_classes(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)
    assert all(r.is_first == (r.doc_id == r.class_id) for r in got)


def test_dense_and_single_intersections_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert jaccard_join._shared_counts(a, b, sets).tolist() == want
    few = jaccard_join._shared_counts(a[:2], b[:2], [np.r_[s, np.arange(10**6 + k, 10**6 + k + 20000, dtype=np.uint64)] for k, s in enumerate(sets)])
    assert len(few) == 2


def test_pruning_keeps_likely_pairs():
    for n in (32, 64, 96, 128):
        m = jaccard_join.least_matches(n, 0.8, 1e-9)
        assert 0 < m < 0.8 * n


@pytest.mark.parametrize("op", [exact_dedup.radix_dedup, substring_dedup.mark_repeats, jaccard_join.jaccard_classes])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1


def test_one_first_row_per_class(spark):
    rng = random.Random(4)
    groups = [[" ".join(words(rng, 100))] for _ in range(4)]
    for g in groups:
        g += [g[0] + " a", g[0] + " b", g[0]]
    # all ids null; the least id repeated; rows that repeat id and text; ids and nulls
    ids = [[None] * 4, [7, 7, 9, 9], [12, 14, 14, 12], [None, 20, 20, None]]
    rows = [(i, t) for own, g in zip(ids, groups) for i, t in zip(own, g)] + [(None, ""), (None, None)]
    got = jaccard_join.jaccard_classes(frame(spark, rows)).collect()
    first = [(r.class_id, r.doc_id) for r in got if r.is_first and r.n_shingles]
    assert sorted(first, key=str) == sorted([(None, None), (7, 7), (12, 12), (20, 20)], key=str)
    assert sum(r.is_first for r in got if not r.n_shingles) == 2
    by_text = {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == 7}
    assert [r.text_sha256 for r in got if r.is_first and r.doc_id == 7] == [min(by_text)]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_long_words_that_a_polynomial_takes_for_equal(spark):
    long = [thue_morse(1024), thue_morse(1024, "b", "a")]
    rows = [(i, " ".join(f"{w}{k}" for k in range(13)) if i < 2 else w) for i, w in enumerate([*long, *long])]
    assert {r.n_removed for r in substring_dedup.mark_repeats(frame(spark, rows)).collect()} == {0}
    got = jaccard_join.jaccard_classes(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {0, 1, 2, 3} and {r.n_links for r in got} == {0}
    hashes, counts = shared.hashed_words([" ".join(long), "x" * 3_000_000 + " y", "", "y " + long[0]])
    assert counts.tolist() == [2, 2, 0, 2] and len(set(hashes.tolist())) == 4 and hashes[0] == hashes[5] and hashes[3] == hashes[4]


def test_missing_segments_raise(tmp_path):
    table = shared.SortedMap(f"file://{tmp_path}/t", 4, {"v": "<i8"})
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64))  # in the lower two segments
    at = shared.segment_of(keys, 4)
    for part in (0, 1):
        table.put(part, keys[at == part], v=np.arange(int((at == part).sum())))
    with pytest.raises(FileNotFoundError):
        table.find(keys)
    table.seal([0])
    assert table.find(keys)[0].tolist() == (at == 0).tolist()
    table = shared.SortedMap(f"file://{tmp_path}/u", 4, {"v": "<i8"})
    table.put(0, keys[at == 0], v=np.arange(int((at == 0).sum())))
    table.seal([0, 1])
    with pytest.raises(FileNotFoundError):
        table.find(keys)
