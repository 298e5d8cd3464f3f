"""Exact deduplication by distributed MSD radix partitioning.

Texts are split level by level: by their length and first bytes, then by the next bytes of
each group, in digits that grow from level to level, until a group has one member or its texts
have ended. Groups are formed on the bytes themselves; no digest decides equality. A row
leaves as soon as it is alone, so that after the first level only texts with a partner of
the same length and beginning are moved. Every level counts its groups with map-side sums;
rows then find their group in a join, whose row side Spark splits where a group is hot.
Texts are read twice: once for all rows' lengths, first digits and output digests, which are
written, and once for the texts of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import at_most, small, written

#: Bytes of the first digit and of the next one; each further digit is GROWTH times longer.
FIRST, SECOND, GROWTH = 48, 4096, 16
#: Groups of the first level that may be broadcast (about 100 bytes each).
BROADCAST_GROUPS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def _after(rest: Column, n: int) -> Column:
    return F.substring(rest, n + 1, (1 << 31) - 1 - n)


def _bytes(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rest, len, digit): the normalised text's bytes, their number and the first of them."""
    rows = documents.select(
        F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("t")
    ).select("id", F.col("t").cast("binary").alias("rest"))
    return rows.select("id", "rest", F.octet_length("rest").alias("len"), F.substring("rest", 1, FIRST).alias("digit"))


def _sha(rest: Column) -> Column:
    return F.unhex(F.sha2(rest, 256))


def radix_classes(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: one row (id, sha, keep_id, n) per distinct member id.

    ``rows`` has id, rest, len and digit of each text, ``narrow`` the same rows without rest.
    """
    groups = written(
        narrow.groupBy("len", "digit").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
        .filter("n > 1").withColumn("gid", F.monotonically_increasing_id()), "radix-groups",
    )
    done = []
    live = rows.join(small(groups, BROADCAST_GROUPS), ["len", "digit"])
    seen, width = FIRST, SECOND
    sha = _sha(F.col("rest"))
    keep = ["id", "gid", "n", "keep_id", "len", "sha", "rest"]
    live = written(live.withColumn("sha", sha).withColumn("rest", _after(F.col("rest"), FIRST)).select(*keep), "radix-0")
    level = 1
    while True:
        done.append(live.filter(F.col("len") <= seen).select("id", "sha", "keep_id", "n"))
        open_ = live.filter(F.col("len") > seen)
        if at_most(open_, 0):
            break
        open_ = open_.drop("n", "keep_id").withColumn("digit", F.substring("rest", 1, width))
        groups = written(
            open_.groupBy("gid", "digit").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
            .filter("n > 1").withColumn("next", F.monotonically_increasing_id()), f"radix-groups-{level}",
        )
        live = written(
            open_.join(groups, ["gid", "digit"]).drop("gid", "digit").withColumnRenamed("next", "gid")
            .withColumn("rest", _after(F.col("rest"), width)).select(*keep), f"radix-{level}",
        )
        seen, width, level = seen + width, width * GROWTH, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.distinct()


def radix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest id stays. text_sha256 is the lowercase hex digest of the
    normalised UTF-8 text, an output only.

    Edge cases: rows that repeat both id and text are members each (group_size counts them);
    exactly one of them is kept. Null ids are smaller than all others; where a whole group has
    null ids, keep_id is null and one row is kept. Empty texts form one group. An empty table
    gives an empty result. Other columns are ignored.
    """
    rows = _bytes(documents, id_col, text_col)
    narrow = written(rows.select("id", "len", "digit", _sha(F.col("rest")).alias("sha")), "radix-rows")
    digests = narrow.select("id", "sha")
    found = radix_classes(rows, narrow).select(F.col("id").alias("m"), F.col("sha").alias("s"), "keep_id", "n")
    joined = digests.join(found, F.col("id").eqNullSafe(F.col("m")) & (F.col("sha") == F.col("s")), "left")
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(0)))
    return joined.withColumn("nth", nth).select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("nth") == 1) & (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


#: The same over the table ``documents``; texts are compared as such.
DEDUP_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""
