"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. A source of weight w owns block number i (from 0) a
window of slots: released at floor(i / w), due at ceil((i + 1) / w). Earliest deadline first
fills one slot after another (ties: the source's place), which keeps every prefix less than
one block from each source's weight. With whole-number shares the schedule repeats after the sum of the
shares, so one period is made on the driver and every block's slot follows from its number.
When a source ends, the others go on with their shares in a new phase; there are no more
phases than sources, and every row is kept.

``mix`` gives each row its place; ``in_mix_order`` gives the rows in that order. It ranks narrow
rows first, learns from them at which row each source goes over to the next file, and so
shuffles whole rows once, straight to their file, where they are ranked.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Mapping
from functools import reduce
from math import ceil, gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, written

#: Rows per block; the most sources, and the most slots that the driver makes for all phases.
BLOCK_ROWS, MOST_SOURCES, MOST_SLOTS = 64, 2_000, 4_000_000
#: Rows of a source that are ranked in one task, about.
BUCKET_ROWS = 20_000
#: (source, bucket) counts, and rows of the schedule, that may be broadcast.
BROADCAST_BUCKETS, BROADCAST_SLOTS = 200_000, 500_000
#: Bytes of text that a file is planned for at most and at least, and the most files.
FILE_BYTES, LEAST_BYTES, MOST_FILES = 1 << 25, 1 << 20, 20_000


def window_of(i: int, share: int, total: int) -> tuple[int, int]:
    """Release and deadline of block i of a source with weight share / total."""
    return i * total // share, -((-(i + 1) * total) // share)


def period(shares: list[int]) -> list[int]:
    """The source at each slot of one period of length sum(shares), earliest deadline first."""
    total = sum(shares)
    waiting = [(0, s, 0) for s in range(len(shares))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window_of(i, shares[s], total)[1], s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < shares[s]:
            heapq.heappush(waiting, (max(window_of(i + 1, shares[s], total)[0], slot + 1), s, i + 1))
    return out


def phases(blocks: list[int], shares: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Schedule all blocks: (runs, slots).

    A run (source, phase, from_block, to_block, first_slot, period, share) says which blocks of
    a source fall into a phase; a slot (source, phase, k, t) that its k-th block of each period
    stands at slot t of the period. A phase ends at the first slot whose source has no block left.
    """
    done, runs, slots, first, phase = [0] * len(blocks), [], [], 0, 0
    while any(d < b for d, b in zip(done, blocks)):
        live = [s for s in range(len(blocks)) if done[s] < blocks[s]]
        cut = reduce(gcd, (shares[s] for s in live))
        own = {s: shares[s] // cut for s in live}
        where: dict[int, list[int]] = {s: [] for s in live}
        for t, k in enumerate(period(list(own.values()))):
            slots.append((live[k], phase, len(where[live[k]]), t))
            where[live[k]].append(t)
        total = sum(own.values())
        left = {s: blocks[s] - done[s] for s in live}
        end = min(left[s] // own[s] * total + where[s][left[s] % own[s]] for s in live)
        for s in live:
            n = end // total * own[s] + bisect_left(where[s], end % total)
            runs.append((s, phase, done[s], done[s] + n, first, total, own[s]))
            done[s] += n
        first += end
        phase += 1
    return runs, slots


def _keyed(documents: DataFrame, id_col: str, source_col: str, *more: Column) -> DataFrame:
    """Rows with source, id, the md5 of the id and its bucket: the key's first hex digits, so that buckets follow the order."""
    digits = len(f"{documents.count() // BUCKET_ROWS:x}")
    rows = documents.select(
        F.col(source_col).alias("mix_source"), F.col(id_col).alias("mix_id"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("mix_key"), *more)
    return rows.withColumn("mix_bucket", F.substring("mix_key", 1, digits))


def _starts(sums: DataFrame) -> DataFrame:
    """mix_before: rows of the source in the buckets before each (mix_s, mix_b)."""
    before = Window.partitionBy("mix_s").orderBy("mix_b").rowsBetween(Window.unboundedPreceding, -1)
    return small(sums.select("mix_s", "mix_b", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_before")), BROADCAST_BUCKETS)


def _bucket_of(rows: DataFrame, table: DataFrame) -> Column:
    return rows["mix_source"].eqNullSafe(table["mix_s"]) & (rows["mix_bucket"] == table["mix_b"])


def _schedule(
    sums: DataFrame, shares: Mapping[str | None, int] | None, block_rows: int, default_share: int
) -> tuple[Callable[[DataFrame], DataFrame], int, bool]:
    """Schedule sources of which ``sums`` counts the rows (mix_s, mix_b, mix_n).

    Returns a function that places rows with mix_source and mix_rank (from 0 in the source), the
    number of slots, and whether the function shuffles nothing.
    """
    counts = sums.groupBy("mix_s").agg(F.sum("mix_n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = sorted(((r["mix_s"], r["n"]) for r in counts), key=lambda x: (x[0] is not None, str(x[0])))
    names = [s for s, _ in counts]
    own = [int((shares or {}).get(s, default_share)) for s in names]
    if any(s <= 0 for s in own) or sum(own) * len(own) > MOST_SLOTS:
        raise ValueError(f"shares are positive whole numbers, and their sum times the number of sources is at most {MOST_SLOTS}")
    blocks = [ceil(n / block_rows) for _, n in counts]
    runs, slots = phases(blocks, own)
    spark = sums.sparkSession
    # these three are bounded by MOST_SOURCES, its square and MOST_SLOTS
    hinted = lambda df, n: F.broadcast(df) if n <= BROADCAST_SLOTS else df
    n_runs, n_slots = len(runs), len(slots)
    ids = spark.createDataFrame(list(enumerate(names)), "mix_i int, mix_name string")
    runs = spark.createDataFrame(runs, "mix_i int, mix_phase int, mix_lo long, mix_hi long, mix_first long, mix_period int, mix_share int")
    table = spark.createDataFrame(slots, "mix_i int, mix_phase int, mix_k int, mix_t int")

    def place(ranked: DataFrame) -> DataFrame:
        placed = ranked.withColumn("mix_block", F.expr(f"mix_rank div {block_rows}"))
        placed = placed.join(F.broadcast(ids), placed["mix_source"].eqNullSafe(ids["mix_name"]))
        placed = placed.join(hinted(runs, n_runs), "mix_i").filter("mix_block >= mix_lo and mix_block < mix_hi")
        placed = placed.withColumn("mix_k", F.expr("cast((mix_block - mix_lo) % mix_share as int)")).join(hinted(table, n_slots), ["mix_i", "mix_phase", "mix_k"])
        placed = placed.withColumn("mix_slot", F.expr("mix_first + (mix_block - mix_lo) div mix_share * mix_period + mix_t"))
        return placed.withColumn("mix_position", F.expr(f"mix_slot * {block_rows} + mix_rank % {block_rows}"))

    return place, sum(blocks), max(n_runs, n_slots) <= BROADCAST_SLOTS


def mix(
    documents: DataFrame,
    shares: Mapping[str | None, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    default_share: int = 1,
) -> DataFrame:
    """Each input row with its place in the mix: columns mix_block, mix_slot, mix_phase, mix_position.

    ``shares`` gives whole-number shares per source (sources not named: ``default_share``); a
    source's target weight is its share of the sum over sources that still have blocks. In
    every prefix of slots of a phase each source is less than one block from its weight.
    Within a source, rows are taken in the order of md5(id). mix_position is unique and grows
    with (mix_slot, order in the block); the last block of a source may be shorter.

    Edge cases: a null source is a source of its own; null ids come first in their source;
    rows that repeat are placed each; an empty table gives an empty result. All columns are
    kept, but input columns of the four results' names give way to them. More than MOST_SOURCES
    sources, or shares whose sum times the number of sources is over MOST_SLOTS, are an error.
    """
    kept = [c for c in documents.columns if c.lower() not in ("mix_block", "mix_slot", "mix_phase", "mix_position")]
    rows = _keyed(documents, id_col, source_col, F.struct(*(F.col(f"`{c}`") for c in kept)).alias("mix_row"))
    sums = rows.groupBy(F.col("mix_source").alias("mix_s"), F.col("mix_bucket").alias("mix_b")).agg(F.count("*").alias("mix_n"))
    place = _schedule(sums, shares, block_rows, default_share)[0]
    order = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "mix_id")
    ranked = rows.withColumn("mix_nth", F.row_number().over(order))
    starts = _starts(sums)
    ranked = ranked.join(starts, _bucket_of(ranked, starts)).withColumn("mix_rank", F.col("mix_before") + F.col("mix_nth") - 1)
    return place(ranked).select("mix_row.*", "mix_block", "mix_slot", "mix_phase", "mix_position")


def in_mix_order(
    documents: DataFrame,
    shares: Mapping[str | None, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
    default_share: int = 1,
) -> DataFrame:
    """All rows and columns of ``documents`` in the order of the mix.

    Partition k holds the k-th range of positions, sorted, so that the files written from it
    can be read one after another. Places are those of ``mix``; rows that repeat an id stand in the
    order of their texts' hashes. A file has about FILE_BYTES of text, or more beyond MOST_FILES.

    Edge cases as for ``mix``; null texts count as empty; rows that are equal in id and text go to
    one file.
    """
    spark = documents.sparkSession
    place_of = F.struct("mix_key", F.col("mix_id").isNotNull().alias("known"), "mix_tie").alias("mix_place")
    whole = _keyed(documents, id_col, source_col, F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("mix_row"),
                   F.xxhash64(F.col(text_col)).alias("mix_tie"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("mix_bytes"))
    keys = written(whole.select("mix_source", "mix_bucket", place_of, "mix_bytes"), "mix-keys")
    sums = written(keys.groupBy(F.col("mix_source").alias("mix_s"), F.col("mix_bucket").alias("mix_b")).agg(
        F.count("*").alias("mix_n"), F.sum("mix_bytes").alias("mix_bytes")), "mix-sums")
    size = sums.agg(F.sum("mix_bytes")).first()[0] or 0
    place, slots, still = _schedule(sums, shares, block_rows, default_share)
    files = max(ceil(size / FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / LEAST_BYTES)))
    files = min(max(files, 1), MOST_FILES)
    span = max(1, ceil(slots * block_rows / files))
    # equal rows have one rank here, and so one file
    order = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_place")
    ranked, starts = keys.withColumn("mix_nth", F.rank().over(order)), _starts(sums)
    ranked = ranked.join(starts, _bucket_of(ranked, starts)).withColumn("mix_rank", F.col("mix_before") + F.col("mix_nth") - 1)
    cuts = place(ranked).groupBy("mix_source", "mix_bucket", F.expr(f"cast(mix_position div {span} as int)").alias("mix_file")).agg(
        F.min("mix_place").alias("mix_from"), F.min("mix_rank").alias("mix_start"))
    cuts = cuts.withColumn("mix_start", F.min("mix_start").over(Window.partitionBy("mix_source", "mix_file")))
    cuts = written(cuts.groupBy(F.col("mix_source").alias("mix_s"), F.col("mix_bucket").alias("mix_b")).agg(
        F.sort_array(F.collect_list(F.struct("mix_from", "mix_file", "mix_start"))).alias("mix_cuts")), "mix-cuts")
    cuts = small(cuts, BROADCAST_BUCKETS)
    rows = whole.select("mix_row", "mix_source", "mix_bucket", place_of)
    rows = rows.join(cuts, _bucket_of(rows, cuts)).withColumn("mix_cut", F.expr("element_at(filter(mix_cuts, c -> c.mix_from <= mix_place), -1)"))
    rows = rows.select("mix_row", "mix_source", "mix_place", "mix_cut.mix_file", "mix_cut.mix_start").repartitionById(files, F.col("mix_file"))
    nth = F.row_number().over(Window.partitionBy("mix_file", "mix_source").orderBy("mix_place"))
    placed = place(rows.withColumn("mix_rank", F.col("mix_start") + nth - 1))
    if not still:
        placed = placed.repartitionByRange(files, "mix_position")
    return placed.sortWithinPartitions("mix_position").select("mix_row.*")
