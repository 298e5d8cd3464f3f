"""Packing, mixing, chat rotation, URL rules and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import chat, mixing, packing, pipeline, url_filter
from lodestone.llm.catalog import SHARES, tokenizer_path

from .test_dedup import frame


def documents(seed=9, n=150):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"word{rng.randrange(99)}," for _ in range(int(rng.paretovariate(0.8) * 40) % 6000))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "don't  STOP\n\u00c9t\u00e9 e\u0301 <|endoftext|> 3.14 \u2028x\u00a0y"), (903, "a " * 9000), (None, "no id"), (5, rows[5][1]), (5, "other text")]


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [t or "" for _, t in documents()] + ["\u03a3\u03a3 \u0301a  b\x1cc d\x85e 'S x's", "\u1100\u1161 \u1161"]
    got = packing.WordIds(tokenizer_path())(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def test_every_letter_beside_punctuation_gets_its_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    ids_of = packing.WordIds(tokenizer_path())
    for shape in ("{}.", "a{}!", "{}b;", ".{}", "{}"):
        texts = [shape.format(c) for c in letters]
        for lo in range(0, len(texts), 4096):
            block = texts[lo : lo + 4096]
            want = [np.array([*e.ids, 1], "<u4").tobytes() for e in whole.encode_batch(block, add_special_tokens=False)]
            assert [t for t, a, b in zip(block, ids_of(block), want) if a != b] == []


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    assert packing.word_wise(tokenizer_path())
    made = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    made["normalizer"] = None  # upper case stays: word by word in lower case would be wrong
    path = f"{tmp_path}/t.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    assert not packing.word_wise(path)
    whole = Tokenizer.from_file(path)
    texts = ["Upper and lower", None, "x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordIds(path)(texts)] == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_sequences_follow_the_mix(spark, tmp_path):
    """Every prefix of the sequences has the tokens of each source that the same prefix of the mix has."""
    rng = random.Random(6)
    sources = ["src0"] * 900 + ["src1"] * 300 + ["src9"] * 500
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([20, 90, 300, 1100]))), s) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixing.in_mix_order(df, SHARES, block_rows=10).write.parquet(f"{tmp_path}/mix")
    docs = spark.read.parquet(f"{tmp_path}/mix")
    files = docs.selectExpr("_metadata.file_name AS f", "_metadata.row_index AS r", "doc_id").collect()
    assert len({r.f for r in files}) > 1
    source, tokens = {i: s for i, _, s in rows}, {}
    got = pipeline.packing(spark, docs, "").collect()
    for r in got:
        tokens[r.doc_id] = r.doc_tokens
    last = max(r.sequence_id for r in got) + 1
    in_order = [r.doc_id for r in sorted(files, key=lambda r: (r.f, r.r))]
    total = sum(tokens.values())
    assert sum(r.length for r in got) == total
    for tenth in range(1, 11):
        packed, mixed_, left = defaultdict(int), defaultdict(int), total * tenth / 10
        for r in got:
            if r.sequence_id < last * tenth / 10:
                packed[source[r.doc_id]] += r.length
        for i in in_order:
            if left <= 0:
                break
            mixed_[source[i]] += tokens[i]
            left -= tokens[i]
        for s in set(sources):
            assert abs(packed[s] / sum(packed.values()) - mixed_[s] / sum(mixed_.values())) < 0.06, (tenth, s, dict(packed), dict(mixed_))
    assert {source[i] for i in in_order[-100:]} != set(sources)  # a source has ended by then, so that a random order would differ


@pytest.mark.parametrize("n", [0, 3, 150])
def test_pack_is_an_exact_cover(spark, n):
    rows = documents(n=150) if n == 150 else documents()[:n]
    got = packing.pack(frame(spark, rows), tokenizer_path()).collect()
    ids = packing.WordIds(tokenizer_path())
    want = sorted(x.hex() for x in ids([t for _, t in rows]))
    docs = defaultdict(list)
    whole = {}
    for (i, _), x in zip(rows, ids([t for _, t in rows])):
        whole.setdefault(i, []).append(x)
    for r in got:
        fits = [x for x in whole[r.doc_id] if len(x) // 4 == r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        assert fits and r.length > 0
        docs[r.doc_id, r.doc_tokens].append(r)
    for (i, tokens), pieces in docs.items():
        copies = sum(len(x) // 4 == tokens for x in whole[i])
        cover = np.zeros(tokens, int)
        for r in pieces:
            cover[r.start : r.start + r.length] += 1
        assert (cover == copies).all()
    assert sum(r.length for r in got) == sum(len(bytes.fromhex(x)) // 4 for x in want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        pad = 0 if at & (at - 1) == 0 else 2048 - at
        assert {r.padding for r in pieces} == {pad}
        padding += pad
    assert padding <= 0.01 * sum(r.length for r in got)


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 41)
    demand = rng.integers(200, 900, 40)
    plan = packing.cutting_stock(sizes, demand, 64)
    used = sum(c * p for c, p in plan)
    assert (used <= demand).all() and all((p * sizes).sum() <= 64 for _, p in plan)
    bins = sum(c for c, _ in plan)
    assert (used * sizes).sum() > 0.999 * 64 * bins and (demand - used).sum() < 64 * 64
    value, pattern = packing.best_patterns(np.array([3, 5]), np.array([0.4, 0.7]), 11)[0]
    assert value == pytest.approx(1.5) and pattern.tolist() == [2, 1]


def left_over(sizes, demand, capacity):
    plan = packing.cutting_stock(sizes, demand, capacity)
    assert all(c > 0 and (p >= 0).all() and (p * sizes).sum() <= capacity for c, p in plan)
    left = demand - sum((c * p for c, p in plan), np.zeros(len(sizes), np.int64))
    assert (left >= 0).all()
    return int(left.sum()), sum(c for c, _ in plan)


def test_rounding_leaves_few_pieces_on_skewed_lengths():
    eight = {3: 227, 4: 9, 5: 1, 6: 1, 7: 1021, 9: 2383, 11: 175, 13: 500}
    sizes, demand = np.array(list(eight)), np.array(list(eight.values()))
    assert left_over(sizes, demand, 16)[0] <= packing.most_left(sizes, 16)
    rng = np.random.default_rng(5)
    for k in range(200):
        capacity = int(rng.choice([16, 64, 128]))
        sizes = np.sort(rng.choice(np.arange(1, capacity + 1), rng.integers(1, min(capacity, 40)), replace=False))
        demand = (10 ** rng.uniform(0, 7, len(sizes))).astype(np.int64) + 1
        left, bins = left_over(sizes, demand, capacity)
        assert left <= packing.most_left(sizes, capacity)
        assert bins <= demand.sum() and bins >= (sizes * demand).sum() / capacity - left
    sizes = np.sort(rng.choice(np.arange(1, 513), 40, replace=False))
    demand = (10 ** rng.uniform(2, 6.8, 40)).astype(np.int64)
    assert left_over(sizes, demand, 512)[0] <= packing.most_left(sizes, 512)


def test_pack_of_eight_lengths(spark):
    eight = {3: 227, 4: 9, 5: 1, 6: 1, 7: 1021, 9: 2383, 11: 175, 13: 500}
    lengths = [4 * c for c, n in eight.items() for _ in range(n)]
    rows = [(i, " ".join(["a"] * (n - 1))) for i, n in enumerate(lengths)]
    got = packing.pack(frame(spark, rows), tokenizer_path(), capacity=64).collect()
    assert sum(r.length for r in got) == sum(lengths) and {r.doc_id for r in got} == set(range(len(rows)))
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64


@pytest.mark.parametrize("shares", [[1], [4, 2, 2, 1, 1], [1, 1, 1], [50, 1, 7], [3, 5, 9, 11]])
def test_pfair_lag_is_below_one_block(shares):
    order, total = mixing.period(shares), sum(shares)
    done = [0] * len(shares)
    for t, s in enumerate(order):
        release, due = mixing.window_of(done[s], shares[s], total)
        assert release <= t < due
        done[s] += 1
        for k, share in enumerate(shares):
            assert abs(Fraction(share * (t + 1), total) - done[k]) < 1
    assert done == shares


def simulated(blocks, shares):
    """Slot by slot: of the released blocks of the live sources the one due first; a source's end starts anew."""
    done, out = [0] * len(blocks), []
    while any(d < b for d, b in zip(done, blocks)):
        live = [s for s in range(len(blocks)) if done[s] < blocks[s]]
        total = sum(shares[s] for s in live)
        own, t = dict.fromkeys(live, 0), 0
        while True:
            ready = [(Fraction((own[s] + 1) * total, shares[s]).__ceil__(), s) for s in live if own[s] * total // shares[s] <= t]
            s = min(ready)[1]
            if done[s] == blocks[s]:
                break
            out.append((s, done[s]))
            done[s] += 1
            own[s] += 1
            t += 1
            if all(d == b for d, b in zip(done, blocks)):
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_phases_equal_a_simulation(seed):
    rng = random.Random(seed)
    blocks = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 7))]
    shares = [rng.randrange(1, 9) for _ in blocks]
    runs, slots = mixing.phases(blocks, shares)
    at = {(s, p, k): t for s, p, k, t in slots}
    got = {}
    for s, phase, lo, hi, first, period, share in runs:
        for b in range(lo, hi):
            slot = first + (b - lo) // share * period + at[s, phase, (b - lo) % share]
            assert slot not in got
            got[slot] = (s, b)
    assert [got[t] for t in sorted(got)] == simulated(blocks, shares) and sorted(got) == list(range(sum(blocks)))


def test_mix_places_every_row_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["src0"] * 6 + ["src1", "src2", "s3", None])) for i in range(900)] + [(7, "s3"), (None, "s3")]
    df = spark.createDataFrame([(i, s, "t") for i, s in rows], "doc_id long, source string, n string")
    got = mixing.mix(df, SHARES, block_rows=5).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((i or -1, s or "") for i, s in rows)
    assert len({r.mix_position for r in got}) == len(rows)
    slots = defaultdict(set)
    for r in got:
        slots[r.mix_slot].add((r.source, r.mix_block, r.mix_phase))
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    first = [next(iter(slots[t])) for t in sorted(slots) if next(iter(slots[t]))[2] == 0]
    weights = {"src0": 4, "src1": 2, "src2": 2, "s3": 1, None: 1}
    done = defaultdict(int)
    for t, (s, _, _) in enumerate(first, 1):
        done[s] += 1
        assert all(abs(Fraction(w * t, 10) - done[k]) < 1 for k, w in weights.items())
    assert mixing.mix(df.limit(0), SHARES).count() == 0
    clash = df.selectExpr("*", "1 as mix_slot", "2 as mix_key", "3 as mix_i", "4 as `a.b`")
    again = mixing.mix(clash, SHARES, block_rows=5)
    assert set(again.columns) == {*df.columns, "mix_key", "mix_i", "a.b", "mix_block", "mix_slot", "mix_phase", "mix_position"}
    assert sorted(r.mix_position for r in again.collect()) == sorted(r.mix_position for r in got)
    with pytest.raises(ValueError):
        mixing.mix(df, {"src0": 0})


def test_rows_in_the_order_of_the_mix(spark, monkeypatch):
    rows = [(i, f"text {i} " * (i % 50), f"src{min(i % 7, 3)}" if i % 11 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    want = [r.doc_id for r in mixing.mix(df, SHARES, block_rows=5).orderBy("mix_position").collect()]
    for size in (1 << 25, 1 << 12):  # one file, many
        monkeypatch.setattr(mixing, "FILE_BYTES", size)
        monkeypatch.setattr(mixing, "LEAST_BYTES", size)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
        got = mixing.in_mix_order(df, SHARES, block_rows=5)
        assert got.columns == df.columns and [r.doc_id for r in got.collect()] == want
    assert got.rdd.getNumPartitions() > 20 and sorted(got.collect()) == sorted(df.collect())
    # repeated and null ids, equal rows, columns with the work columns' names
    same = [(None, "x" * (i % 9), "src0") for i in range(300)] + [(7, "y", "src1")] * 300 + [(8, None, "src2"), (8, "", "src2")]
    more = df.unionByName(spark.createDataFrame(same, df.schema)).selectExpr("*", "doc_id as mix_key", "source as mix_source", "1 as `a.b`")
    got = mixing.in_mix_order(more, SHARES, block_rows=5)
    places = {r.mix_position: r.source for r in mixing.mix(more, SHARES, block_rows=5).collect()}
    assert got.columns == more.columns and sorted(map(str, got.collect())) == sorted(map(str, more.collect()))
    assert len(places) == len(rows) + len(same)
    monkeypatch.setattr(mixing, "FILE_BYTES", 1 << 25)
    monkeypatch.setattr(mixing, "LEAST_BYTES", 1 << 25)
    assert [r.source for r in mixing.in_mix_order(more, SHARES, block_rows=5).collect()] == [places[p] for p in sorted(places)]
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_BUCKETS", 0)
    assert [r.doc_id for r in mixing.in_mix_order(df, SHARES, block_rows=5).collect()] == want
    assert mixing.in_mix_order(df.limit(0), SHARES).count() == 0


@pytest.mark.parametrize("most", [2, 4096])
def test_chat_rotation_by_hand(spark, monkeypatch, most):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, None, "ann", "late"), (2, 0, "system", "alone"),
             (None, 3, None, "who"), (3, 5, "x", "same"), (3, 5, "x", "same")] + [(4, i, "ab"[i % 2], str(i)) for i in range(40)]
    turns += [(4, 7, "ab"[i % 2], f"again {i // 3}") for i in range(90)] + [(4, None, "a", f"null {i % 20}") for i in range(50)]
    monkeypatch.setattr(chat, "MOST_TOGETHER", most)
    df = spark.createDataFrame([(*t, 1, "p") for t in turns], "conv_id long, turn long, role string, text string, position int, perspective string")
    got = chat.perspective_rotation(df, block_turns=4).collect()
    for conv in (1, None, 3, 4):
        own = [t for t in turns if t[0] == conv]
        own.sort(key=lambda t: (t[1] is None, t[1] or 0, hashlib.md5(f"{t[2] or 'unknown'}\n{t[3] or ''}".encode()).hexdigest()))
        for person in {t[2] or "unknown" for t in own} - {"system"}:
            rows = sorted((r for r in got if r.conv_id == conv and r.perspective == person), key=lambda r: r.position)
            assert [r.position for r in rows] == list(range(len(own)))
            whole = ""
            for r, (_, _, speaker, text) in zip(rows, own):
                speaker = speaker or "unknown"
                head = "<|system|>" if speaker == "system" else "<|assistant|>" if speaker == person else f"<|user:{speaker}|>"
                assert r.segment == f"{head}\n{text or ''}\n<|end|>\n" and r.char_start == len(whole)
                whole += r.segment
                assert r.char_end == len(whole) and r.is_target == (speaker == person)
                if r.is_target:
                    assert whole[r.mask_start : r.mask_end] == f"{text or ''}\n<|end|>"
                else:
                    assert r.mask_start is None and r.mask_end is None
    assert not [r for r in got if r.conv_id == 2]
    assert chat.perspective_rotation(df.limit(0)).count() == 0


URLS = [None, "", "no scheme/example.com/en/", "http://example.com/en/x", "https://WWW.Example.com/en/?q", "http://a.b.example.com/en/", "http://example.com/en",
        "http://example.com?x=/en/", "http://notexample.com/en/", "http://x.net/es/1#a", "http://x.net/fr/", "http://x.net/de/", "http://com", "http://com/",
        "http://example.com:80/en/", "a://b://example.com/en/", "http://example.com/en/\nnext", "http://.com/", "HTTP://EXAMPLE.COM/EN/", "http:///path"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(df, url_filter.rule_table(spark)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *judged(u)) for i, u in rows), key=key)
    assert url_filter.judge_urls(df.limit(0), url_filter.rule_table(spark)).count() == 0
    nothing = url_filter.judge_urls(df, url_filter.rule_table(spark).limit(0)).collect()
    assert len(nothing) == len(rows) and all(r.verdict == "allow" and r.rule is None for r in nothing)


def test_url_list_without_false_positives(spark):
    listed = spark.createDataFrame([(f"h{i}.org", f"/p{i}", "block") for i in range(0, 3000, 2)], "rule_host string, rule_path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p{i}") for i in range(3000)], "page_id long, url string")
    got = url_filter.judge_urls(pages, listed).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) and len(got) == 3000


def test_bloom_of_many_segments(spark):
    listed = spark.range(200_000).selectExpr("concat('host', id, '.org') key")
    bloom = url_filter.blocked_bloom(listed, segment=1 << 12)
    assert bloom.parts > 9
    hashes = lambda df: np.array([r[0] for r in df.selectExpr("xxhash64(key)").collect()], np.int64).view(np.uint64)
    assert bloom.passes(hashes(listed)).all()
    others = bloom.passes(hashes(spark.range(200_000, 300_000).selectExpr("concat('host', id, '.org') key")))
    assert 0 < others.mean() < 0.03
    assert not url_filter.blocked_bloom(listed.limit(0)).passes(hashes(listed.limit(9))).any()


def test_stages_keep_columns_and_rows(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        good = i % 5 > 0
        w = [f"w{rng.randrange(900)}" for _ in range(60)]
        docs.append((i, " ".join(w if good else [x + "###" for x in w]), "en", f"src{i % 3}", 1))
        labels.append((i, int(good), 0))
    docs += [(400, docs[1][1].upper(), "en", "src0", 1), (401, docs[2][1] + " more", "en", "src0", 1), (402, docs[2][1] + " more", "en", None, 1), (403, None, None, None, None),
             (6, docs[6][1], "en", "src0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, frame_, str(tmp_path))
        if k < 4:
            assert out.columns == frame_.columns
        out.write.parquet(f"{tmp_path}/{k}")
        frame_ = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = sorted(r.doc_id for r in frame_.select("doc_id").collect())
    clean = [i for i in range(300) if i % 5]
    assert kept["quality classifier"] == sorted([*clean, 6, 400, 401, 402, *([403] if 403 in kept["quality classifier"] else [])])
    after = kept["exact dedup"]
    assert 1 not in after and 400 in after and 401 not in after and 402 in after and after.count(6) == 1
    assert set(kept["n-gram Jaccard join"]) == set(after) - {402}
    assert kept["mixing sources to target weights"] == kept["n-gram Jaccard join"]
    assert set(kept["packing"]) == set(kept["n-gram Jaccard join"])
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_stages_judge_rows_not_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    text = lambda n=60: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    poor = lambda: " ".join(f"w{rng.randrange(900)}###" for _ in range(60))
    docs = [(i, text() if i % 5 else poor()) for i in range(300)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(300)]
    path = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def left(stage, rows):
        df = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stage(spark, df, path).collect()), key=str)

    def same(rows):
        return sorted(rows, key=str)

    ids = [None, None, None, 700, 700, 700, 701]
    clean = [(i, text()) for i in ids]
    rejected = [(i, poor()) for i in ids]
    good = [d for d in docs if d[0] % 5]
    twice = [clean[0], clean[3]]
    assert left(pipeline.quality_classifier, docs + clean + rejected + twice) == same(good + clean + twice)

    exact = [(None, good[0][1]), (None, good[1][1].upper()), (-5, clean[3][1]), (-5, clean[1][1]), (700, good[2][1]), (None, text()), (700, text())]
    # a copy with a larger id goes on, one with a smaller or null id goes
    want = good[:2] + good[3:] + [c for c in clean if c != clean[1]] + [exact[3], exact[4], exact[5], exact[6]]
    assert left(pipeline.exact_dedup, good + clean + twice + exact) == same(want)

    near = [(None, good[0][1] + " more"), (None, good[1][1] + " more"), (700, good[2][1] + " more"), (700, good[3][1] + " more"), (None, ""), (None, None), (700, "")]
    kept = good + clean + [r for r in near if not r[1]]
    assert left(pipeline.jaccard_join, good + clean + near) == same(kept)
    monkeypatch.setattr(pipeline, "BROADCAST_IDS", 0)
    monkeypatch.setattr(pipeline, "BROADCAST_KEYS", 0)
    assert left(pipeline.exact_dedup, good + clean + twice + exact) == same(want)
    assert left(pipeline.jaccard_join, good + clean + near) == same(kept)


def test_empty_documents_go_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
