"""The n-gram model, the quality classifier and top-k search against direct computation."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import kneser_ney, quality, shared, topk
from lodestone.llm.shared import local_path

from .test_dedup import frame, lower


def texts(seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("a b c d e the The of x{} y{}".split()).format(rng.randrange(30)) for _ in range(rng.randrange(60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "zz\tunseen\x0bwords\u00a0glued"), (503, "a " * 700)]


def direct(rows, order):
    """Interpolated modified Kneser-Ney straight from its definition."""
    def tokens(t):
        return lower(t).replace("\t", " ").replace("\x0b", " ").replace("\n", " ").split(" ") if t else []

    marked = lambda t: ["<s>"] * (order - 1) + [x for x in tokens(t) if x] + ["</s>"]
    train = [marked(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    raw = Counter(w for t in train for w in t if w != "<s>")
    a = {order: Counter(tuple(t[i : i + order]) for t in train for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    n, v, total = sum(raw.values()), len(raw), sum(a[1].values())
    d = {k: kneser_ney.discounts([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]) for k, c in a.items()}
    cut = lambda k, c: d[k][min(c, 3) - 1] if c else 0
    mass = sum(cut(1, c) for c in a[1].values()) / total
    follow, free = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in a[k].items():
            follow[g[:-1]] += c
            free[g[:-1]] += cut(k, c)

    def prob(h, w):
        if not h:
            return max(a[1][w,] - cut(1, a[1][w,]), 0) / total + mass / (v + 1)
        if not follow[h]:
            return prob(h[1:], w)
        k = len(h) + 1
        c = a[k][*h, w]
        return max(c - cut(k, c), 0) / follow[h] + free[h] / follow[h] * prob(h[1:], w)

    out = {}
    for i, t in rows:
        w = marked(t)
        own = w[order - 1 :]
        logs = [math.log10(prob(tuple(w[j - order + 1 : j]), w[j])) for j in range(order - 1, len(w))]
        out[i] = (len(own), sum(raw[x] > 0 for x in own), n, sum(math.log10((raw[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), sum(logs), prob, raw)
    return out


@pytest.mark.parametrize("order, segment", [(2, 50), (3, 100), (3, 2_000_000), (4, 300)])
def test_kneser_ney_against_definition(spark, monkeypatch, order, segment):
    monkeypatch.setattr(kneser_ney, "SEGMENT_TOKENS", segment)
    monkeypatch.setattr(kneser_ney, "TOGETHER", 100)
    rows = texts()
    want = direct(rows, order)
    got = kneser_ney.score_documents(frame(spark, rows), order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id][:5]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    prob, raw = want[0][5:]
    for h in (("a", "b", "c"), ("<s>",) * 3, ("<s>", "<s>", "a"), ("never", "a", "b"), ("a", "b", "never")):
        h = h[4 - order :]
        assert sum(prob(h, w) for w in raw) + prob(h, "unknown") == pytest.approx(1)
    if order == 2:  # these words are drawn one by one: longer contexts can't help with them
        held = [r for r in got if r.held_out and r.n_tokens > 5]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_kneser_ney_uses_longer_contexts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        w = [rng.randrange(12), rng.randrange(12)]
        while len(w) < 60:
            w.append((w[-1] + w[-2]) % 12 if rng.random() < 0.9 else rng.randrange(12))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    held = {k: sum(r.score for r in kneser_ney.score_documents(frame(spark, rows), order=k).collect() if r.held_out) for k in (2, 3)}
    assert held[3] > 0.5 * held[2]


def test_kneser_ney_counts_above_a_byte_and_order(spark):
    rows = [(i, "a b a b c") for i in range(400)]
    want = direct(rows, 3)
    got = kneser_ney.score_documents(frame(spark, rows)).collect()
    assert all(r.score == pytest.approx(want[r.doc_id][4], abs=1e-9) and r.train_tokens == want[r.doc_id][2] for r in got)
    with pytest.raises(ValueError):
        kneser_ney.train(frame(spark, rows), order=1)


def test_kneser_ney_takes_little_disk(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.5)), 5000)}" for _ in range(300))) for i in range(400)]
    models, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    assert kneser_ney.score_documents(frame(spark, rows)).count() == len(rows)
    files = [os.path.join(at, f) for at, _, names in os.walk(local_path(models[0].uri)) for f in names]
    # hashes and counts of every n-gram took 1.6 times the text
    assert sum(map(os.path.getsize, files)) < sum(len(t) for _, t in rows)


@pytest.mark.parametrize("segment", [100, 2_000_000])
def test_kneser_ney_serves_other_texts(spark, monkeypatch, segment):
    monkeypatch.setattr(kneser_ney, "SEGMENT_TOKENS", segment)
    rows = texts(9)
    model = kneser_ney.train(frame(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]))
    others = rows + [(900, "never seen a b"), (901, "a b never"), (902, "the never the")]
    got = {r.doc_id: r for r in kneser_ney.score(frame(spark, others), model).collect()}
    assert len(got) == len(others) and got[900].n_known == 3
    for r in kneser_ney.score_documents(frame(spark, rows)).collect():
        assert (r.n_tokens, r.n_known) == (got[r.doc_id].n_tokens, got[r.doc_id].n_known) and r.score == pytest.approx(got[r.doc_id].score, abs=1e-9)
    with pytest.raises(ValueError):
        kneser_ney.score(frame(spark, others), model, learned=F.lit(True))


def test_kneser_ney_sums_and_tables(monkeypatch, tmp_path):
    monkeypatch.setattr(kneser_ney, "HELD", 40)
    rng = np.random.default_rng(3)
    for top in (1, 3, 1 << 40):
        want, blobs = Counter(), [b""]
        for _ in range(30):
            columns = [rng.integers(0, top, 25).astype(np.uint64) for _ in range(3)]
            n = rng.integers(0, 400, 25)
            for *key, c in zip(*columns, n):
                want[tuple(map(int, key))] += int(c)
            blobs += [b for _, b in kneser_ney._dealt(np.zeros(25, np.int64), columns, [n])]
        columns, (n,) = kneser_ney._merged(blobs, 3, 1)
        assert [(*map(int, key), int(c)) for *key, c in zip(*columns, n)] == [(*key, c) for key, c in sorted(want.items())]
    table = kneser_ney.Keyed(str(tmp_path), 3, 2)
    keys = (np.array([7, 7, 7, 9, 2**32 - 1, 2**32 - 1]).astype(np.uint64) << np.uint64(32)) | (np.array([1, 5, 9, 5, 0, 65535]).astype(np.uint64) << np.uint64(16))
    table.put(2, keys[::-1].copy(), [np.array([6, 5, 4, 3, 2, 1]), np.array([0, 255, 254, 0, 10**12, 0])])
    table.seal([2])
    asked = np.r_[keys, keys[:2] + (np.uint64(3) << np.uint64(16)), keys[:1]]
    hit, got = table.find(np.array([2] * 8 + [1]), asked)
    assert hit.tolist() == [True] * 6 + [False] * 3
    assert got.tolist() == [[1, 0], [2, 10**12], [3, 0], [4, 254], [5, 255], [6, 0]] + [[0, 0]] * 3


def test_kneser_ney_files_and_messages_do_not_grow_with_segments(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SEGMENT_TOKENS", 40)
    monkeypatch.setattr(kneser_ney, "SHELVES", 3)
    monkeypatch.setattr(kneser_ney, "SEGMENTS", 100)
    monkeypatch.setattr(kneser_ney, "TOGETHER", 200)
    rows, models, train = texts(11), [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    got, want = kneser_ney.score_documents(frame(spark, rows)).collect(), direct(rows, 3)
    assert all(r.score == pytest.approx(want[r.doc_id][4], abs=1e-6) and r.n_known == want[r.doc_id][1] for r in got)
    files = [f for _, _, names in os.walk(local_path(models[0].uri)) for f in names]
    assert models[0].parts > 90 and models[0].per > 30 and len(files) < 30 * 3


def test_kneser_ney_looks_up_segments_of_a_shelf_at_once(tmp_path):
    rng = np.random.default_rng(7)
    table, want = kneser_ney.Keyed(str(tmp_path), 11, 2, 4), {}
    for shelf in (0, 2):
        own = table.shelf(shelf)
        for local in (0, 1, 3) if shelf == 0 else (1, 2):
            keys = np.unique(rng.integers(0, 1 << 63, int(rng.choice([0, 1, 5, 4000])), dtype=np.uint64) >> np.uint64(16)) << np.uint64(16)
            counts = [rng.integers(0, 300, len(keys)), rng.integers(0, 10**10, len(keys))]
            own.add(local, counts, keys)
            want |= {(4 * shelf + local, int(k)): (int(a), int(b)) for k, a, b in zip(keys, *counts)}
        own.close()
    table.seal([0, 2])
    asked = [*want, *want, *((p, k) for p in range(11) for k in (0, 5 << 16, 1 << 62))]
    rng.shuffle(asked)
    hit, got = table.find(np.array([p for p, _ in asked]), np.array([k for _, k in asked], np.uint64))
    assert hit.tolist() == [a in want for a in map(tuple, asked)]
    assert [tuple(r) for r in got.tolist()] == [want.get(a, (0, 0)) for a in map(tuple, asked)]


def test_segments_grow_in_any_store_and_appear_whole(monkeypatch, tmp_path):
    for remote in (False, True):
        if remote:
            monkeypatch.setattr(shared, "local_path", lambda uri: None)
        uri = f"file://{tmp_path}/{remote}"
        for _ in range(2):  # a task may run twice
            file = shared.Grown(uri, "x")
            file.add(np.arange(3))
            file.add(np.arange(3, 5))
            file.close()
        assert shared.map_array(uri, "x", "<i8").tolist() == [0, 1, 2, 3, 4] and os.listdir(f"{tmp_path}/{remote}") == ["x"]


def test_kneser_ney_without_training_rows(spark):
    assert kneser_ney.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = kneser_ney.score_documents(frame(spark, [(out, "only held out")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (4, 0, 0, 0.0)


def quality_rows(seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 200))]
        if not good:
            kind = rng.randrange(3)
            w = [x + "###" for x in w] if kind == 0 else [w[0]] * len(w) if kind == 1 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w) + "."))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    rows += [(900, None), (901, ""), (902, "x" * 200_000), (0, rows[0][1])]
    labels += [(None, 1, 0), (3, None, 0), (5, 7, 0), (7, 0, 0), (7, 1, 0)]
    got = quality.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 600 and r.doc_id % 2 == 0]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}


def test_bradley_terry_fit_is_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.WIDTH)) ** 2
    good = x[:, 1] + 0.3 * rng.normal(size=300) > 0.8
    model = quality.fit(x, good)
    z = (quality.expanded(x) - model.mean) / model.scale
    ridge = np.full(z.shape[1], quality.RIDGE)
    ridge[len(quality.NAMES) : quality.WIDTH] = quality.GRAM_RIDGE
    few, many = sorted((np.flatnonzero(good), np.flatnonzero(~good)), key=len)
    draw = np.random.default_rng(17)
    pairs = [(a, b) for a, b in zip(np.r_[np.repeat(few, quality.PAIRS), draw.choice(few, len(many))], np.r_[draw.choice(many, len(few) * quality.PAIRS), many])]
    pairs = [(a, b) if good[a] else (b, a) for a, b in pairs]

    def loss(w):
        u = z @ w
        return np.mean([math.log1p(math.exp(-(u[a] - u[b]))) for a, b in pairs]) + 0.5 * (ridge * w * w).sum()

    least = loss(model.weights)
    for _ in range(20):
        assert loss(model.weights + 1e-2 * rng.normal(size=len(ridge))) > least
    assert len(pairs) == quality.PAIRS * len(few) + len(many)


def test_quality_sample_is_one_row_per_label(spark, monkeypatch):
    rows, labels = quality_rows()
    rows += [(2, f"copy {i}") for i in range(500)]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, good, whole=quality.fit: seen.append(len(x)) or whole(x, good))
    quality.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in labels)]


def test_quality_without_labels(spark):
    rows, _ = quality_rows()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.classify(frame(spark, rows[:9]), none).collect())
    assert quality.classify(frame(spark, []), none).count() == 0
    poor = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, quality int")
    assert all(r.predicted == 0 for r in quality.classify(frame(spark, rows[:9]), poor).collect())


def brute_top(rows, k=5):
    ok = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % 50 == 0:
            scores = sorted((-int(q @ v), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,tasks", [(16, 9), (64, 1)])
def test_top_k_against_all_products(spark, monkeypatch, shard, tasks):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 8)) / 3)]
    rows += [(i, [0.25] * 8) for i in range(700, 900)]  # one vector in very many rows: ties
    rows += [(950, None), (951, [1.0, None] + [0.0] * 6), (952, [float("nan")] * 8), (1000, [float("inf")] * 8), (None, [1.0] * 8), (1050, [1.0, 2.0]), (1051, [3.0, 1.0]),
             (1100, []), (1101, []), (1150, [0.5] * 8), (1150, [0.5] * 8), (1150, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, score int")
    monkeypatch.setattr(topk, "DIRECTORY", 3)
    got = topk.exact_top_k(df, shard_rows=shard, block_rows=4, leaf=8, tasks=tasks)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components_uses_integers(spark):
    rows = [(i, [1e6 * (i % 7), 1e6 + i]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.exact_top_k(df, shard_rows=16, leaf=4).collect())) == brute_top(rows)
