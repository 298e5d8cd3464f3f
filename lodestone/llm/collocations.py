"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words that occur at least ``min_count`` times in their language get numbers, the most frequent
one the least; all others can be in no candidate and become blanks. An n-gram belongs to the
partition of its rarest word, its pivot. So every word occurrence sends its partition a
rewritten fragment of the piece around it: up to ``most_words`` - 1 words before it that are
more frequent, and after it that are not rarer, up to the first blank or rarer word on each
side. (Of a word that comes twice in an n-gram the first occurrence owns it.) A fragment
alone is nothing and isn't sent. Equal fragments are summed before they are shuffled. A
partition then counts the n-grams of its fragments that contain the pivot, in its own memory,
and gives those that are frequent enough: no other partition has any of their occurrences.

Partitions are groups of pivots; a pivot so frequent that its fragments would fill one alone is
dealt over several by fragment, and only the n-grams of such pivots are summed once more.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import SortedMap, bounded, mixed, part_of, scratch, tidy, written
from .terms import SLICE, Words, byte_class, combined, numbered

#: Piece ends, and the bytes between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD = byte_class(without=b" \t" + BREAKS)
#: Occurrences whose fragments one partition is planned for, and the most partitions.
PART_WORDS, MOST_PARTS = 1_000_000, 1 << 16
#: Words of the vocabulary in a segment of its sorted arrays.
SEGMENT_WORDS = 500_000
#: Fragments that a task sums together, and n-grams that a partition holds before it sums them.
HELD_FRAGMENTS, HELD_GRAMS = 1_500_000, 3_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n): all occurrences of each word."""

    def tables(batches):
        for batch in bounded(batches, "text", SLICE):
            words = Words(batch["text"], WORD)
            if not len(words):
                continue
            code, known = words.coded()
            lang, (langs,) = numbered(batch["lang"])
            keys, n = np.unique(lang[words.owner] * len(known) + code, return_counts=True)
            yield pa.table({
                "lang": langs.take(pa.array(keys // len(known))), "word": known.take(pa.array(keys % len(known))), "n": pa.array(n, pa.int64())})

    partial = documents.mapInArrow(lambda batches: combined(tables(batches), ["lang", "word"], ["n"]), "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of frequent words by a 64-bit key of (lang, word), in sorted arrays that workers map.

    ``salt`` is chosen so that no two words of the corpus, frequent or not, share a key.
    """

    def __init__(self, uri: str, parts: int, salt: str, size: int):
        self.map, self.salt, self.size = SortedMap(uri, parts, {"id": "<u4" if size < 1 << 32 else "<u8"}), salt, size

    def ids(self, lang: str, words: pa.Array) -> np.ndarray:
        """The numbers from 1 of distinct words, 0 for those without one."""
        seed = xxh64_intdigest(lang.encode(), xxh64_intdigest(self.salt.encode(), 42))
        raw = words.cast(pa.binary()).to_pylist()
        keys = np.fromiter((xxh64_intdigest(w, seed) for w in raw), np.uint64, len(raw))
        return self.map.lookup(keys, "id", 0, self.size)


def numbered_words(words: DataFrame, min_count: int) -> tuple[DataFrame, Vocabulary]:
    """Frequent words as (id, lang, word, n), ids from 1 by falling n, and their arrays."""
    spark = words.sparkSession
    for attempt in range(100):
        salt = f"salt {attempt}"
        key = F.xxhash64(F.lit(salt), "lang", "word")
        if not words.groupBy(key.alias("key")).count().filter("count > 1").limit(1).count():
            break
    frequent = words.filter(F.col("n") >= min_count)
    size = frequent.count()
    parts = max(1, ceil(size / SEGMENT_WORDS))
    order = [F.desc("n"), F.col("lang"), F.col("word")]
    ranked = frequent.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = written(ranked.select(
        "lang", "word", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per SEGMENT_WORDS words
    offsets = ranked.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    table = written(ranked.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("at") + 1).alias("id"), "lang", "word", "n"), "vocabulary")
    vocabulary = Vocabulary(scratch(spark, "vocabulary"), parts, salt, size)

    def segment(rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_numpy().view(np.uint64)
        by = np.argsort(keys)
        vocabulary.map.put(rows["segment"][0].as_py(), keys[by], id=rows["id"].to_numpy()[by])
        return rows.select(["segment"]).slice(0, 1)

    keyed = table.select("id", key.alias("key")).withColumn("segment", part_of(F.col("key"), parts))
    vocabulary.map.seal(r.segment for r in keyed.groupBy("segment").applyInArrow(segment, "segment int").collect())
    return table, vocabulary


def _runs(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where, in this order, a row begins that differs from the one before it."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def fragments(ids: np.ndarray, pieces: np.ndarray, most_words: int) -> np.ndarray:
    """Rows (pivot, words before it from the nearest on, words after it likewise); 0 is a blank.

    ``ids`` are numbers of consecutive words, ``pieces`` those of their pieces.
    """
    reach = most_words - 1
    out = np.zeros((2 * reach + 1, len(ids)), ids.dtype)
    out[0] = ids
    for side, (step, start) in enumerate(((-1, 1), (1, 1 + reach))):
        open_ = ids > 0
        for k in range(1, reach + 1):
            other = np.zeros_like(ids)
            same = np.zeros(len(ids), bool)
            if k < len(ids):
                here, there = (slice(k, None), slice(None, -k)) if step < 0 else (slice(None, -k), slice(k, None))
                other[here] = ids[there]
                same[here] = pieces[here] == pieces[there]
            open_ = open_ & same & (other > 0) & ((other < ids) if step < 0 else (other <= ids))
            out[start + k - 1] = np.where(open_, other, 0)
    return out[:, (out[1] > 0) | (out[1 + reach] > 0)]


def grams(rows: np.ndarray, weights: np.ndarray, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of two and more words that contain the fragments' pivots, padded with 0."""
    reach = most_words - 1
    found, times = [], []
    for before in range(reach + 1):
        for after in range(reach + 1 - before):
            if not before + after:
                continue
            whole = np.ones(rows.shape[1], bool)
            if before:
                whole &= rows[before] > 0
            if after:
                whole &= rows[reach + after] > 0
            words = [rows[k] for k in range(before, 0, -1)] + [rows[0]] + [rows[reach + k] for k in range(1, after + 1)]
            gram = np.zeros((most_words, int(whole.sum())), rows.dtype)
            for k, w in enumerate(words):
                gram[k] = w[whole]
            found.append(gram)
            times.append(weights[whole])
    return np.concatenate(found, axis=1), np.concatenate(times)


def _summed(rows: np.ndarray, weights: np.ndarray, leading: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Equal columns of ``rows`` summed, in the order of ``leading`` and then of a hash; a hash that
    several share only leaves their rows apart."""
    key = np.zeros(rows.shape[1], np.uint64)
    for r in rows:
        key = key * _GOLD + r.astype(np.uint64)
    key = mixed(key)
    if leading is not None:
        key = leading | (key >> np.uint64(48))
    order = np.argsort(key)
    at = _runs([*rows] if leading is None else [leading, *rows], order)
    return rows[:, order[at]], np.add.reduceat(weights[order], at) if len(at) else weights, None if leading is None else leading[order[at]]


def mined(documents: DataFrame, vocabulary: Vocabulary, hot: list[int], hot_words: int, parts: int, min_count: int, most_words: int,
          held_grams: int = HELD_GRAMS) -> DataFrame:
    """(w1, w2, ..., n): the frequent n-grams of two and more words as numbers, 0 where shorter.

    ``hot`` has the numbers of occurrences of the words 1, 2, ... that are dealt over several partitions.
    """
    spread = np.array([ceil(n / hot_words) for n in hot], np.int64)
    width = 2 * most_words - 1
    dtype = np.dtype(vocabulary.map.columns["id"])
    names = [f"w{k}" for k in range(1, most_words + 1)]

    def sent(held: list[np.ndarray]):
        rows = np.concatenate(held, axis=1)
        pivot = rows[0].astype(np.uint64)
        place = pivot.copy()
        many = np.flatnonzero(pivot <= len(spread))
        if len(many):
            key = np.zeros(len(many), np.uint64)
            for r in rows[:, many]:
                key = key * _GOLD + r.astype(np.uint64)
            place[many] += ((mixed(key) >> np.uint64(32)) % spread[pivot[many].astype(np.int64) - 1].astype(np.uint64)) << np.uint64(36)
        part = ((mixed(place * _GOLD) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        leading = part << np.uint64(48) | (pivot & np.uint64(0xFFFFFFFF)) << np.uint64(16)
        rows, weights, leading = _summed(rows, np.ones(rows.shape[1], np.int64), leading)
        part = (leading >> np.uint64(48)).astype(np.int64)
        pack = zstandard.ZstdCompressor(level=1)
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        blobs = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            block = np.ascontiguousarray(np.concatenate([rows[:, lo:hi].astype(np.int64), weights[None, lo:hi]]))
            block[0] = np.diff(block[0], prepend=0)
            blobs.append(pack.compress(np.ascontiguousarray(block.view(np.uint8).reshape(width + 1, hi - lo, 8).transpose(0, 2, 1)).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def routed(batches):
        held, size = [], 0
        for batch in bounded(batches, "text", SLICE):
            words = Words(batch["text"], WORD)
            if len(words) < 2:
                continue
            code, known = words.coded()
            lang, (langs,) = numbered(batch["lang"])
            of = lang[words.owner]
            ids = np.zeros(len(code), dtype)
            for k, name in enumerate(langs.to_pylist()):
                here = np.flatnonzero(of == k)
                used, at = np.unique(code[here], return_inverse=True)
                ids[here] = vocabulary.ids(name, known.take(pa.array(used)))[at]
            ends = np.zeros(len(words.buffer) + 1, np.int32)
            ends[1:] = np.isin(words.buffer, np.frombuffer(BREAKS, np.uint8))
            np.cumsum(ends, out=ends)
            pieces = words.owner + ends[words.starts].astype(np.int64)  # both only grow
            found = fragments(ids, pieces, most_words)
            held.append(found)
            size += found.shape[1]
            if size >= HELD_FRAGMENTS:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)
        tidy()

    def counted(batches):
        unpack = zstandard.ZstdDecompressor()
        held, times, size, now, whole = [], [], 0, None, True

        def summed():
            rows, n, _ = _summed(np.concatenate(held, axis=1), np.concatenate(times))
            return rows, n

        def out(rows, n):
            for lo in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[lo : lo + 100_000].astype(np.int64)) for r in rows] + [pa.array(n[lo : lo + 100_000])], names=[*names, "n"])

        def end():
            rows, n = summed()
            keep = (n >= min_count) | (rows.max(axis=0) <= len(spread))
            yield from out(rows[:, keep], n[keep]) if whole else out(rows, n)

        for batch in batches:
            for part, blob in zip(batch["part"].to_pylist(), batch["blob"].to_pylist()):
                if part != now and held:
                    yield from end()
                    held, times, size, whole = [], [], 0, True
                now = part
                planes = np.frombuffer(unpack.decompress(blob), np.uint8)
                block = planes.reshape(width + 1, 8, -1).transpose(0, 2, 1).copy().view(np.int64)[..., 0]
                np.cumsum(block[0], out=block[0])
                rows, n = grams(block[:-1], block[-1], most_words)
                held.append(rows.astype(dtype))
                times.append(n)
                size += len(n)
                if size >= held_grams:
                    rows, n = summed()
                    held, times, size = [rows], [n], len(n)
                    if size >= held_grams // 2:  # too many to hold: their sums go on, and are added below
                        yield from out(rows, n)
                        held, times, size, whole = [], [], 0, False
        if held:
            yield from end()
        tidy()

    spark = documents.sparkSession
    tasks = min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(parts / 16)))
    blobs = documents.mapInArrow(routed, "part int, blob binary").repartition(tasks, "part").sortWithinPartitions("part")
    found = blobs.mapInArrow(counted, ", ".join(f"{c} long" for c in [*names, "n"]))
    return found.groupBy(names).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def collocations(
    documents: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 10, most_words: int = 3,
    cover: int = 50, top: int = 2000,
) -> DataFrame:
    """The best phrases of 2 to ``most_words`` words per language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z in lower case) are cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. A phrase is a candidate with a >= ``min_count`` occurrences. Its score is the
    least floor(1000000 * a * a / (l * r)) over all cuts into two parts with l and r occurrences,
    ties to the first cut. A candidate goes if a longer one that contains it has at least
    ``cover`` per cent of its occurrences. Ranks go from 1 to ``top``, by falling score, falling a,
    then the phrase in UTF-8 order. n is the number of the language's words.

    Edge cases: a null language is ``und``; null and empty texts have no words; repeated rows count
    each; languages without candidates, and an empty table, give no rows. Overlapping occurrences
    count. Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = written(word_counts(docs), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("n")).first()[0] or 0
    table, vocabulary = numbered_words(words, min_count)
    parts = max(1, min(ceil(total / PART_WORDS), MOST_PARTS))
    hot_words = max(PART_WORDS, ceil(total / MOST_PARTS)) // 2
    # at most 2 * parts words are that frequent, and they have the first numbers
    hot = [r.n for r in table.filter(F.col("n") > hot_words).orderBy("id").select("n").collect()]
    names = [f"w{k}" for k in range(1, most_words + 1)]
    found = written(mined(docs, vocabulary, hot, hot_words, parts, min_count, most_words), "phrases")

    size = sum((F.col(c) > 0).cast("int") for c in names)
    found = found.withColumn("size", size)
    # counts of parts: words and shorter candidates, both by their numbers
    counts = found.select(*names, F.col("n").alias("part_n")).unionByName(
        table.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(c) for c in names[1:]), F.col("n").alias("part_n")))

    def part(lo: int, hi: int):
        return [F.col(names[i]) for i in range(lo, hi)] + [F.lit(0).cast("long")] * (most_words - hi + lo)

    scored = None
    for length in range(2, most_words + 1):
        own = found.filter(F.col("size") == length).withColumnRenamed("n", "a")
        for k in range(1, length):
            for side, lo, hi in (("l", 0, k), ("r", k, length)):
                keys = part(lo, hi)
                other = counts.toDF(*(f"{c}_" for c in names), f"{side}{k}")
                own = own.withColumns({f"k{i}": c for i, c in enumerate(keys)})
                own = own.join(other, [own[f"k{i}"] == other[f"{c}_"] for i, c in enumerate(names)]).drop(*(f"k{i}" for i in range(most_words)), *(f"{c}_" for c in names))
        wide = lambda c: F.col(c).cast("decimal(15,0)")
        cuts = [
            F.struct(
                F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide(f"l{k}") * wide(f"r{k}")).alias("score"),
                F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            for k in range(1, length)
        ]
        least = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        own = own.withColumn("cut", least).select(*names, "size", "a", "cut.score", "cut.l", "cut.r")
        scored = own if scored is None else scored.unionByName(own)

    inner = None
    for length in range(3, most_words + 1):
        longer = found.filter(F.col("size") == length)
        for short in range(2, length):
            for lo in range(length - short + 1):
                one = longer.select(*(c.alias(n) for c, n in zip(part(lo, lo + short), names)), "n")
                inner = one if inner is None else inner.unionByName(one)
    if inner is not None:
        most = inner.groupBy(names).agg(F.max("n").alias("longer"))
        scored = scored.join(most, names, "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)).drop("longer")

    text = table.select("id", "word")
    out = scored.join(table.select(F.col("id").alias("w1"), F.col("word").alias("word1"), "lang"), "w1")
    for k, name in enumerate(names[1:], 2):
        out = out.join(text.toDF(name, f"word{k}"), name, "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(1, most_words + 1))))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within shares of a language, so that no task sorts all its candidates
    shares = min(512, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares)).alias("share")
    out = out.select("lang", "phrase", "a", "l", "r", "score", share)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).filter(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


#: The same over the table ``documents``, for its parameters' defaults.
COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
g1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g1 GROUP BY lang),
g2 AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM w WHERE len(w) > 1) GROUP BY ALL HAVING f >= 10),
g3 AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM w WHERE len(w) > 2) GROUP BY ALL HAVING f >= 10),
s2 AS (SELECT g2.lang, g2.x, g2.y, g2.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * g2.f * g2.f) // (l.f::HUGEINT * r.f) AS score
  FROM g2 JOIN g1 l ON l.lang = g2.lang AND l.x = g2.x JOIN g1 r ON r.lang = g2.lang AND r.x = g2.y),
c3 AS (
  SELECT g3.lang, g3.x, g3.y, g3.z, 1 AS k, g3.f AS a, l.f AS l, r.f AS r FROM g3
    JOIN g1 l ON l.lang = g3.lang AND l.x = g3.x JOIN g2 r ON r.lang = g3.lang AND r.x = g3.y AND r.y = g3.z
  UNION ALL
  SELECT g3.lang, g3.x, g3.y, g3.z, 2, g3.f, l.f, r.f FROM g3
    JOIN g2 l ON l.lang = g3.lang AND l.x = g3.x AND l.y = g3.y JOIN g1 r ON r.lang = g3.lang AND r.x = g3.z),
s3 AS (SELECT * FROM (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c3)
  QUALIFY row_number() OVER (PARTITION BY lang, x, y, z ORDER BY score, k) = 1),
inside AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM g3 UNION ALL SELECT lang, y, z, f FROM g3) GROUP BY ALL),
c AS (
  SELECT s2.lang, s2.x || ' ' || s2.y AS phrase, a, l, r, score FROM s2 LEFT JOIN inside USING (lang, x, y) WHERE longer IS NULL OR 100 * longer < 50 * a
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, l, r, score FROM s3)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM c JOIN n USING (lang) QUALIFY rank <= 2000
"""
