"""Divergence of sources, collocations and SimHash classes against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lodestone.llm import collocations, divergence, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, word string, p long, fp string, a int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=5, rows=140):
    rng = random.Random(seed)
    names = ["the", "of", "new", "York", "City", "straße", "Été", "x1", "a-b", "été", "state", "a"]
    out = []
    for i in range(rows):
        words = [rng.choice(names) if rng.random() < 0.8 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 40))]
        text = " ".join(words)
        for _ in range(3):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice([". ", ",", "\n", "\t", ";x ", "  ", "\r\n"]) + text[k:]
        out.append((i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None])))
    out += [(500, None, "en", "s9"), (501, "", "zz", "only"), (502, "12 34 -- !", "zz", "other"), (None, "new york city", "en", "s1"), (None, "new york city", "en", "s1"),
            (503, "new york city " * 400, "en", "s0"), (504, "a a a a a a a a a a a a a a", "de", "s1"), (505, "ÀÀ àà ÀÀ", "en", "s2")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "t", "w", 2, "f", 3) for i, t, g, s in rows], SCHEMA).repartition(5)


def same_as_sql(got, rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def test_divergence_against_sql(spark):
    rows = corpus()
    same_as_sql(divergence.divergence(frame(spark, rows)), rows, divergence.DIVERGENCE_SQL)


def test_divergence_by_hand(spark):
    rows = [(1, "b a a", "x", "s"), (2, "a B", "x", "t"), (3, "a", "x", "t"), (4, "b", "x", "u"), (5, "", "y", "v"), (6, None, "y", "w")]
    got = {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in divergence.divergence(frame(spark, rows)).collect()}
    p = lambda n, total: 1 + 10**9 * (n + 1) // (total + 2)
    f = lambda p, q: (p - q) ** 2 // q
    s, t, u, whole = [p(2, 3), p(1, 3)], [p(2, 3), p(1, 3)], [p(0, 1), p(1, 1)], [p(4, 7), p(3, 7)]
    assert got["x", "s", "pair", "u"] == (f(s[0], u[0]) + f(s[1], u[1]), 1) and got["x", "s", "pair", "t"] == (0, 2)
    assert got["x", "u", "pair", "s"] == (f(u[0], s[0]) + f(u[1], s[1]), 1) and got["x", "u", "pair", "t"][1] == 2
    assert got["x", "s", "term", "a"] == (f(s[0], whole[0]), 1) and got["x", "u", "term", "b"] == (f(u[1], whole[1]), 1)
    assert got["y", "v", "pair", "w"] == (0, 1) and t == s
    assert {k for k in got if k[2] == "term"} == {("x", "s", "term", "a"), ("x", "t", "term", "a"), ("x", "u", "term", "b")}


def test_divergence_of_nothing(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []


@pytest.mark.parametrize("width", [1 << 16, 1 << 6])
def test_sketch_never_underestimates(spark, tmp_path, width):
    rng = random.Random(2)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(1, 4)) for _ in range(3000)] * 2
    df = spark.createDataFrame(rows, "key long, df long").repartition(6)
    sketch = divergence.CountMin(f"file://{tmp_path}", width, 5).fill(df)
    true = Counter()
    for k, n in rows:
        true[k] += n
    keys = np.array(list(true), np.int64).view(np.uint64)
    said = sketch.at_least(keys, 5)
    assert all(s for s, n in zip(said, true.values()) if n >= 5)
    if width == 1 << 16:
        assert not all(said)


def brute_phrases(rows, min_count=10, most=3, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(t)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or ("und" if lang is None else lang)] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {g: c for g, c in counts.items() if len(g) > 1 and c >= min_count}
        kept = []
        for g, a in good.items():
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * c >= cover * a for h, c in good.items()):
                continue
            cuts = [(10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(g).encode(), a, counts[g[:k]], counts[g[k:]], score))
        out += [(lang, i, p.decode(), a, l, r, n[lang], s) for i, (_, _, p, a, l, r, s) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_against_brute_force_and_sql(spark):
    rows = corpus()
    got = collocations.collocations(frame(spark, rows))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_phrases(rows)
    same_as_sql(got, rows, collocations.COLLOCATION_SQL)


@pytest.mark.parametrize("part_words,most", [(50, 3), (7, 2), (400, 4)])
def test_collocations_of_dealt_pivots(spark, monkeypatch, part_words, most):
    monkeypatch.setattr(collocations, "PART_WORDS", part_words)  # many partitions; frequent pivots over several
    rows = corpus(9)
    got = collocations.collocations(frame(spark, rows), min_count=5, most_words=most, top=40)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_phrases(rows, 5, most, top=40)


def test_partitions_too_large_to_hold_are_summed_later(spark):
    rows = corpus(3)
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    words = collocations.word_counts(docs)
    table, vocabulary = collocations.numbered_words(words, 10)
    whole, parts = (
        sorted(map(tuple, collocations.mined(docs, vocabulary, [], 1000, 1, 10, 3, held).collect())) for held in (10**6, 40))
    assert whole == parts and whole
    assert [r.id for r in table.orderBy("id").collect()] == list(range(1, table.count() + 1))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None), (2, "one two", "en", "s")])).collect() == []


def brute_fingerprint(text, width=4):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", lower(text)) if w]
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=4):
    fps = sorted({fp for _, fp in pairs})
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    array = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(f)) <= radius).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, f in pairs:
        k = find(at[f])
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted((i if i is not None else -1, f"{f:016x}", least.get(find(at[f]))) for i, f in pairs)


def near_corpus(seed=8):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 300, 900]))]
        for k in range(12):
            w = list(words)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = "Changed"
            rows.append((base * 100 + k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "One"), (5005, "one two three"), (5006, "a b c d"), (5006, "a b c d"),
             (None, rows[0][1]), (None, "nobody else says this"), (5007, "again " * 3000), (5008, "é à ü ß")]
    return rows


def test_simhash_against_brute_force(spark):
    rows = near_corpus()
    got = simhash.simhash_components(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) < len(want) - 60


def test_links_of_crowded_fingerprints(spark):
    """Random walks of a few bits, so that balls overlap in chains, against all pairs."""
    rng = random.Random(4)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(30):
            fps.add(f)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(3)
    label = {r.fp: r.root for r in simhash.components(simhash.near_links(df, 4)).collect()}
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    classes = defaultdict(set)
    for _, f, c in want:
        classes[c].add(f)
    found = defaultdict(set)
    for f in fps:
        signed = int(np.uint64(f).astype(np.int64))
        found[label.get(signed, signed)].add(f"{f:016x}")
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))


@pytest.mark.parametrize("pairwise", [2, 48])
@pytest.mark.parametrize("bits", [6, 12, 40])
def test_shared_numbers_lose_no_link(monkeypatch, pairwise, bits):
    """Few bits, so that many variants share a number: no link is false, and none is lost."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(6)]
    fps = np.array([f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for f in fps for _ in range(4)], np.uint64)
    fps = np.unique(fps)
    values = simhash.numbers((fps[:, None] ^ simhash.flips(2)).ravel(), bits)
    owners = np.repeat(np.arange(len(fps)), len(simhash.flips(2)))
    order = np.argsort(values, kind="stable")
    a, b = simhash.collisions(values[order], owners[order], fps, 4, bits)
    assert (simhash.distance(fps[a], fps[b]) <= 4).all()
    i, j = np.triu_indices(len(fps), 1)
    near = simhash.distance(fps[i], fps[j]) <= 4
    assert (simhash.roots(a, b, len(fps)) == simhash.roots(i[near], j[near], len(fps))).all()


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), 3)
