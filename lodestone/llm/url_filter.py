"""URL rules and lists: a blocked Bloom filter, then an exact hash join.

Listed entries are canonical URLs or URL prefixes ``host/path``. All of them are set in a
blocked Bloom filter: a hash picks one 64-bit block, others pick bits within it, so that one
look at one word answers. Its size follows the list, which is counted first. The words are
array segments in the shared folder, each written by one task and memory-mapped by the
workers, so that a list of any length is built in linear time and broadcast nowhere. A URL
gives one key per (suffix of its host, listed length of path); keys that the filter passes go
to the hash join with the list, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .shared import map_array, mixed, put_array, scratch, small

#: (host, path, verdict). A rule fits its host and all subdomains if the path starts with its path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed entries per 64-bit block, bits set per entry, and blocks per array segment (2 MB).
PER_BLOCK, BITS, SEGMENT_BLOCKS = 5, 4, 1 << 18
#: Listed entries that may be broadcast in the exact join.
BROADCAST_ENTRIES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """A filter of 64-bit hashes in ``blocks`` words, in segments of files."""

    def __init__(self, uri: str, blocks: int, segment: int = SEGMENT_BLOCKS):
        self.uri, self.blocks, self.segment = uri, blocks, segment

    @property
    def parts(self) -> int:
        return -(-self.blocks // self.segment)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash, and the bits that it sets there."""
        second = mixed(hashes)
        bits = np.zeros(len(hashes), np.uint64)
        for i in range(BITS):
            bits |= np.uint64(1) << (second >> np.uint64(6 * i) & np.uint64(63))
        return (hashes % np.uint64(self.blocks)).astype(np.int64), bits

    def put(self, part: int, at: np.ndarray, bits: np.ndarray) -> None:
        words = np.zeros(min(self.segment, self.blocks - part * self.segment), np.uint64)
        words[at - part * self.segment] = bits
        put_array(self.uri, f"{part:07d}.words", words)

    def seal(self, present: Iterable[int]) -> None:
        there = np.zeros(self.parts, np.uint8)
        there[list(present)] = 1
        put_array(self.uri, "sealed", there)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """False only for hashes that were never set."""
        at, bits = self.place(hashes)
        part = at // self.segment
        out = np.zeros(len(hashes), bool)
        there = map_array(self.uri, "sealed", "|u1")
        for p in np.unique(part).tolist():
            if there[p]:
                own = np.flatnonzero(part == p)
                words = map_array(self.uri, f"{p:07d}.words", "<u8")[at[own] - p * self.segment]
                out[own] = words & bits[own] == bits[own]
        return out


def blocked_bloom(entries: DataFrame, key_col: str = "key", segment: int = SEGMENT_BLOCKS) -> BlockedBloom:
    """The filter of all keys of ``entries``; two shuffles of at most one row per entry."""
    made = BlockedBloom(scratch(entries.sparkSession, "bloom"), entries.count() // PER_BLOCK + 1, segment)

    def placed(batches):
        for batch in batches:
            at, bits = made.place(batch["h"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // segment).astype(np.int32)), pa.array(at), pa.array(bits.view(np.int64))], names=["part", "at", "bits"])

    def put(table: pa.Table) -> pa.Table:
        made.put(table["part"][0].as_py(), table["at"].to_numpy(), table["bits"].to_numpy().view(np.uint64))
        return pa.table({"part": table["part"][:1]})

    words = entries.select(F.xxhash64(key_col).alias("h")).mapInArrow(placed, "part int, at long, bits long").groupBy("part", "at").agg(F.bit_or("bits").alias("bits"))
    made.seal(r.part for r in words.groupBy("part").applyInArrow(put, "part int").collect())  # a row per segment
    return made


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    unlisted: str = "allow",
) -> DataFrame:
    """Judge every URL by the longest listed rule (rule_host, rule_path, verdict) that fits it.

    Returns one row per input row: id, host, path, rule (host and path of the rule; null where
    none is listed), verdict (the rule's, else ``unlisted``). A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest (host and path together,
    then the longer host) wins. Equal rules with different verdicts: block wins. A listed canonical
    URL is a rule with its whole path.

    Edge cases: a null URL or one without ``://`` has empty host and path and fits no rule; hosts
    keep ports and user names; rules with a null part are ignored; an empty list gives every row
    ``unlisted``; repeated rows are judged each; an empty table gives an empty result. Other
    columns are ignored.
    """
    listed = (
        rules.dropna(subset=["rule_host", "rule_path", "verdict"]).groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("rule_host", "rule_path").alias("rule"), F.concat_ws("\n", "rule_host", "rule_path").alias("key"),
                F.length("rule_host").alias("host_len"), F.length("rule_path").alias("path_len"), "verdict")
    )
    bloom = blocked_bloom(listed)
    lengths = F.broadcast(listed.agg(F.sort_array(F.collect_set("path_len")).alias("lengths")))  # one row, no more numbers than the longest path
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.", -1)
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))

    def key(first_label: Column, length: Column) -> Column:
        return F.concat_ws("\n", F.array_join(F.slice(labels, first_label, F.size(labels)), "."), F.col("path").substr(F.lit(1), length))

    hashes = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.transform(fitting, lambda n: F.xxhash64(key(i, n)))))
    asked = seen.crossJoin(lengths).select("id", "host", "path", hashes.alias("hashes"))

    def tested(batches):
        for batch in batches:
            counts = pc.list_value_length(batch["hashes"]).to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            passed = bloom.passes(batch["hashes"].flatten().to_numpy().view(np.uint64))
            before = np.r_[0, np.cumsum(passed)]
            place = np.arange(len(passed)) - np.repeat(ends - counts, counts)
            hits = pa.ListArray.from_arrays(pa.array(before[np.r_[0, ends]].astype(np.int32)), pa.array(place[passed].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], hits], names=["id", "host", "path", "hits"])

    schema = StructType([*seen.schema.fields, StructField("hits", ArrayType(IntegerType()))])
    at, n = F.col("hit"), F.size(fitting)  # the hashes stand label by label, then length by length
    possible = (
        asked.mapInArrow(tested, schema).withColumn("row", F.monotonically_increasing_id())
        .select("id", "host", "path", "row", F.explode_outer("hits").alias("hit")).crossJoin(lengths)
        .select("id", "host", "path", "row", F.when(at.isNotNull(), key(F.floor(at / n).cast("int") + 1, F.try_element_at(fitting, (at % n) + 1))).alias("key"))
    )
    hit = possible.join(small(listed, BROADCAST_ENTRIES), "key", "left")
    best = Window.partitionBy("row").orderBy(F.desc_nulls_last(F.col("host_len") + F.col("path_len")), F.desc_nulls_last("host_len"))
    return hit.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(unlisted)).alias("verdict")
    )


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same over the table ``pages`` in another engine's SQL, without the filter."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(h, p, v) AS (VALUES {values}),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fit AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (n)
"""
