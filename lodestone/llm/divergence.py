"""Source divergence audit: sketch-prefiltered term counts, then sparse joins of source pairs.

Texts are turned into terms once. Every task sums its rows by (lang, source, term) with
occurrences and documents; these partial counts are written. From them each task fills a
count-min sketch of document frequencies by (lang, term); the tasks' sketches are added block
by block into one, which lies in the shared folder and is mapped by workers. Its estimate is
never below the true number, so a term whose estimate misses ``min_docs`` can't be kept: its
partial counts go before they are shuffled. What is left is counted exactly.

A pair of sources compares all kept terms of its language, though most stand in few sources.
With p0 and q0 for terms that a source lacks, the sum over all terms is

    sum over the one's terms of f(p, q0) + sum over the other's of f(p0, q)
    + (V - terms of either) * f(p0, q0) + sum over common terms of f(p, q) - f(p, q0) - f(p0, q)

The first two sums need only how many terms have each p, and the last is a join of the terms
that both have, summed before it is shuffled. Divisions are of whole numbers.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, map_array, put_array, scratch, small, written
from .terms import LETTERS, SLICE, Words, combined, numbered, summed

#: Rows of counters, and counters of a row: a power of two of at least the partial counts' number,
#: up to MOST_WIDTH (beyond it the sketch discards less; results stay the same).
DEPTH, FEWEST_WIDTH, MOST_WIDTH = 2, 1 << 16, 1 << 27
#: Counters that tasks exchange as one blob.
BLOCK = 1 << 20
#: Sources that may be broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000
SCALE = 1_000_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def partial_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents, summed within tasks."""

    def tables(batches):
        for batch in bounded(batches, "text", SLICE):
            words = Words(batch["text"], LETTERS)
            if not len(words):
                continue
            code, terms = words.coded()
            group, (langs, sources) = numbered(batch["lang"], batch["source"])
            width = len(terms)
            own, times = np.unique(words.owner * width + code, return_counts=True)
            keys, n, df = summed(group[own // width] * width + own % width, times, np.ones(len(own), np.int64))
            at = pa.array(keys // width)
            yield pa.table({
                "lang": langs.take(at), "source": sources.take(at), "term": terms.take(pa.array(keys % width)),
                "n": pa.array(n, pa.int64()), "df": pa.array(df, pa.int64())})

    return documents.select("lang", "source", "text").mapInArrow(
        lambda batches: combined(tables(batches), ["lang", "source", "term"], ["n", "df"]),
        "lang string, source string, term string, n long, df long")


class CountMin:
    """Counters of ``DEPTH`` hash functions that stop at ``most``, in blocks in the shared folder."""

    def __init__(self, uri: str, width: int, most: int):
        self.uri, self.bits, self.most = uri, int(log2(width)), min(most, 255)

    @property
    def block(self) -> int:
        return min(BLOCK, 1 << self.bits)

    def places(self, hashes: np.ndarray, row: int) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD[row]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def filled(self, batches):
        """A task's (block, counters) of columns key and df; blocks of all rows are numbered through."""
        counters = np.zeros((DEPTH, 1 << self.bits), np.uint8)
        for batch in batches:
            hashes = batch["key"].to_numpy().view(np.uint64)
            df = np.minimum(batch["df"].to_numpy(), self.most)
            for row in range(DEPTH):
                at, more = summed(self.places(hashes, row), df)
                counters[row, at] = np.minimum(counters[row, at] + more, self.most)
        pack = zstandard.ZstdCompressor(level=1)
        for number, block in enumerate(counters.reshape(-1, self.block)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pack.compress(block)], pa.binary())], names=["block", "counters"])

    def merged(self, batches):
        """Adds blobs that come sorted by block, one after another, and writes each block."""
        unpack, total, number = zstandard.ZstdDecompressor(), None, None
        done = []

        def end():
            put_array(self.uri, f"{number:07d}", total.astype(np.uint8))
            done.append(number)

        for batch in batches:
            for k, blob in zip(batch["block"].to_pylist(), batch["counters"].to_pylist()):
                one = np.frombuffer(unpack.decompress(blob), np.uint8)
                if k != number:
                    if number is not None:
                        end()
                    total, number = one.astype(np.uint16), k
                else:
                    total = np.minimum(total + one, self.most)
        if number is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["block"])

    def fill(self, rows: DataFrame) -> CountMin:
        """Count ``rows`` of key and df in."""
        spark = rows.sparkSession
        tasks = rows.coalesce(max(64, 64 * ceil(rows.count() / (1 << self.bits))))
        sketches = tasks.mapInArrow(self.filled, "block int, counters binary")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = sketches.repartition(parts, "block").sortWithinPartitions("block")
        done = [r.block for r in dealt.mapInArrow(self.merged, "block int").collect()]  # a number per BLOCK counters
        there = np.zeros(DEPTH * (1 << self.bits) // self.block, np.uint8)
        there[done] = 1
        put_array(self.uri, "sealed", there)
        return self

    def at_least(self, hashes: np.ndarray, bound: int) -> np.ndarray:
        """False only where the true sum is certainly below ``bound``."""
        out = np.ones(len(hashes), bool)
        there = map_array(self.uri, "sealed", "|u1")
        for row in range(DEPTH):
            places = self.places(hashes, row) + (row << self.bits)
            for number in np.unique(places // self.block).tolist():
                here = np.flatnonzero(places // self.block == number)
                if there[number]:
                    counters = map_array(self.uri, f"{number:07d}", "|u1")
                    out[here] &= counters[places[here] % self.block] >= min(bound, self.most)
                else:
                    out[here] = False
        return out


def exact_counts(partial: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, df) of terms that the sketch can't rule out, summed exactly."""
    spark = partial.sparkSession
    width = 1 << max(int(log2(FEWEST_WIDTH)), min(int(log2(MOST_WIDTH)), ceil(log2(max(1, partial.count())))))
    keyed = partial.withColumn("key", F.xxhash64("lang", "term"))
    sketch = CountMin(scratch(spark, "df-sketch"), width, min_docs).fill(keyed.select("key", "df"))

    @F.pandas_udf("boolean")
    def possible(keys: pd.Series) -> pd.Series:
        return pd.Series(sketch.at_least(keys.to_numpy().view(np.uint64), min_docs))

    left = keyed.filter(possible("key"))  # only keys go to Python
    return left.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total); in decimals where a product may pass 64 bits."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    narrow = F.lit(SCALE).cast("long") * (n + 1)
    return F.when(n < 9_000_000_000, 1 + F.call_function("div", narrow, total)).otherwise(
        1 + F.call_function("div", wide, total.cast("decimal(19,0)")))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(
    documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200
) -> DataFrame:
    """How far each source's terms are from those of the other sources, and of all, of its language.

    Returns lang, source, part, item, value, rank. Terms are runs of ASCII letters and non-ASCII
    characters, A-Z in lower case; a language keeps those of at least ``min_docs`` of its documents.
    Part ``pair`` has a row per other source of the language with the summed distance, part
    ``term`` the ``top`` terms that the source has more often than its language, by distance.
    Ranks go from 1, by falling value, then by item in UTF-8 order.

    Edge cases: null texts, languages and sources count as ''. A group without terms takes part
    with zero counts; a language without kept terms gives pairs of value 0. A language of one
    source has no pairs. Repeated rows and ids are documents of their own. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = documents.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    partial = written(partial_counts(docs), "partial-counts")
    counts = written(exact_counts(partial, min_docs), "term-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs).drop("df")
    kept = written(counts.drop("df").join(by_lang, ["lang", "term"]), "kept-terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("of_lang")).groupBy("lang").agg(F.count("*").alias("V"), F.sum("of_lang").alias("lang_total"))
    none = F.lit(0).cast("long")
    groups = (
        docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "terms", "V", "lang_total")))
    )
    groups = written(groups.withColumn("p0", F.when(F.col("V") > 0, _share(none, F.col("total") + F.col("V")))), "groups")
    known = small(groups.select("lang", "source", "total", "V", "lang_total", "p0"), BROADCAST_SOURCES)
    rows = written(
        kept.join(known, ["lang", "source"]).select(
            "lang", "source", "term", "p0", _share(F.col("n"), F.col("total") + F.col("V")).alias("p"),
            _share(F.col("of_lang"), F.col("lang_total") + F.col("V")).alias("q")), "shares")

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    pairs = _pairs(rows, groups).withColumn("rank", F.row_number().over(place))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    ends = ["lang", "source", "item"]
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    left = rows.select("lang", "term", "source", "p", "p0")
    right = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = (
        left.join(right, ["lang", "term"]).filter("source <> item").groupBy(ends)
        .agg(F.sum(_distance(p, q) - _distance(p, q0) - _distance(p0, q)).alias("change"), F.count("*").alias("common"))
    )
    times = written(rows.groupBy("lang", "source", "p").agg(F.count("*").alias("times")), "times")
    others = small(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0")), BROADCAST_SOURCES)
    met = times.join(others, "lang").filter("source <> other")
    own = met.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(F.col("times") * _distance(p, F.col("other_p0"))).alias("own"))
    theirs = met.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("times") * _distance(F.col("other_p0"), p)).alias("theirs"))
    other = small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms")), BROADCAST_SOURCES)
    whole = groups.select("lang", "source", "V", "terms", "p0").join(other, "lang").filter("source <> item")
    whole = whole.join(both, ends, "left").join(own, ends, "left").join(theirs, ends, "left")
    zero = F.lit(0).cast("long")
    change, common, mine, its = (F.coalesce(c, zero) for c in ("change", "common", "own", "theirs"))
    without = F.col("V") - F.col("terms") - F.col("item_terms") + common
    value = F.when(F.col("V") > 0, mine + its + change + without * _distance(p0, q0)).otherwise(zero)
    return whole.select(*ends, value.alias("value"))


#: The same over the table ``documents``, for its parameters' defaults.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
vs AS (SELECT lang, count(*) AS V, sum(n) AS N FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS N FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.N + vs.V) AS p,
    1 + (1000000000::HUGEINT * (v.n + 1)) // (vs.N + vs.V) AS q
  FROM g JOIN v USING (lang) JOIN vs USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
