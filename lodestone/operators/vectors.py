"""Exact vector search, fusion of rankings and pairings, in double arithmetic."""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Dampening of reciprocal ranks, candidates per list, over-fetch factor.
RRF_K, CANDIDATES, OVERFETCH = 60, 20, 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def check_vector(vector: list[float], dimension: int) -> None:
    if len(vector) != dimension or not all(map(math.isfinite, vector)):
        raise ValueError("the query vector has another dimension or a value that isn't finite")


def valid_vector(v: Column, dimension: int) -> Column:
    return (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


#: Query vectors that a plan may hold; more are searched in several plans. Scores of one batch.
MOST_QUERIES, MOST_SCORES = 10_000, 4_000_000
#: Decimals that a rank depends on: engines differ beyond them.
DECIMALS = 9


def _in_blocks(queries: DataFrame, search, *more: str) -> DataFrame:
    """The union of ``search`` over blocks of at most MOST_QUERIES query vectors (query_id, q, more)."""
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *more).orderBy("query_id").toLocalIterator()
    out = None
    while (block := list(islice(asked, MOST_QUERIES))) or out is None:
        part = search(block)
        out = part if out is None else out.unionByName(part)
    return out


def _score_matrices(batches, vector: str, asked: list, product: bool):
    """(batch, rows, scores) with the scores of some rows of the batch to all queries: cosine
    distances, or inner products. Null, odd and (for distances) zero vectors are left out."""
    if not asked:
        return
    matrix = np.array([r.q for r in asked], float)
    lengths, dimension = np.linalg.norm(matrix, axis=1), matrix.shape[1]
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch[vector]), dimension), False))
        if not batch.num_rows:
            continue
        rows = batch[vector].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
        norms = np.linalg.norm(rows, axis=1)
        fine = np.flatnonzero(np.isfinite(norms) & (product | (norms > 0)))
        step = max(1, MOST_SCORES // len(asked))
        for some in (fine[lo : lo + step] for lo in range(0, len(fine), step)):
            scores = rows[some] @ matrix.T
            yield batch, some, scores if product else 1.0 - scores / (norms[some, None] * lengths)


def scored(vectors: DataFrame, queries: DataFrame, vector: str = "v", best: int | None = None, cutoff: float | None = None, product: bool = False,
           within: str | None = None) -> DataFrame:
    """Exact scores of every row to each of a stated set of query vectors.

    The score is the cosine ``distance``, or with ``product`` the inner product ``similarity``.
    ``queries`` has query_id and q and is read in blocks of MOST_QUERIES; each block's matrix goes
    to the tasks, which multiply Arrow batches with it. All columns but the vector are kept.
    Vectors that are null, of another length, not finite or (for distances) of norm 0 are not
    scored. With ``best``, a task sends only rows that can be among the best of a query, ties
    included, judged to DECIMALS: some ``best`` rows per query and task in place of all. With
    ``cutoff``, it sends only rows of at most that distance. With ``within``, a column of both
    sides, rows are only scored for queries of the same value.
    """
    kept = [f for f in vectors.schema.fields if f.name != vector]
    names = [f.name for f in kept]
    column = "similarity" if product else "distance"
    schema = StructType([*kept, StructField("query_id", LongType()), StructField(column, DoubleType())])

    def search(asked: list) -> DataFrame:
        ids = np.array([r.query_id for r in asked], np.int64)

        def score(batches):
            worst = np.full(len(ids), np.inf)  # the best-th least score that the task has seen per query
            for batch, rows, scores in _score_matrices(batches, vector, asked, product):
                take = np.ones(scores.shape, bool) if cutoff is None else scores <= cutoff
                if within:
                    own = np.array(batch[within].take(pa.array(rows)).to_pylist(), object)
                    take &= own[:, None] == np.array([r[within] for r in asked], object)
                if best is not None:
                    order = np.where(take, np.round(-scores if product else scores, DECIMALS), np.inf)
                    if len(rows) >= best:
                        worst = np.minimum(worst, np.partition(order, best - 1, axis=0)[best - 1])
                    take &= order <= worst
                r, q = np.nonzero(take)
                at = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays([*(batch[n].take(at) for n in names), pa.array(ids[q]), pa.array(scores[r, q])], names=[*names, "query_id", column])

        return vectors.mapInArrow(score, schema)

    return _in_blocks(queries, search, *([within] if within else []))


def owner_distances(vectors: DataFrame, queries: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(query_id, keys, distance, chunks, overlap): the least distance of an owner's vectors, their
    number and the largest ``overlap``; summed per Arrow batch before anything moves."""
    fields = {f.name: f for f in vectors.schema.fields}
    schema = StructType([*(fields[k] for k in keys), *(StructField(n, t) for n, t in (("query_id", LongType()), ("distance", DoubleType()), ("chunks", LongType()), ("overlap", LongType())))])

    def search(asked: list) -> DataFrame:
        ids = np.array([r.query_id for r in asked], np.int64)

        def partial(batches):
            for batch, rows, scores in _score_matrices(batches, vector, asked, False):
                own = batch.take(pa.array(rows))
                code = np.zeros(len(rows), np.int64)
                for k in keys:
                    each = own[k].dictionary_encode()
                    each = pc.fill_null(each.indices, len(each.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                    code = np.unique(code * (each.max() + 1) + each, return_inverse=True)[1]
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                least = np.minimum.reduceat(scores[order], at, axis=0)
                count = np.diff(np.r_[at, len(order)])
                overlap = np.maximum.reduceat(own["overlap"].to_numpy(zero_copy_only=False)[order], at)
                first = pa.array(np.repeat(order[at], len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [*(own[k].take(first) for k in keys), pa.array(np.tile(ids, len(at))), pa.array(least.ravel()), pa.array(np.repeat(count, len(ids))), pa.array(np.repeat(overlap, len(ids)))],
                    schema=pa.schema([*((k, own[k].type) for k in keys), ("query_id", pa.int64()), ("distance", pa.float64()), ("chunks", pa.int64()), ("overlap", pa.int64())]))

        return vectors.mapInArrow(partial, schema)

    return _in_blocks(queries, search).groupBy("query_id", *keys).agg(F.min("distance").alias("distance"), F.sum("chunks").alias("chunks"), F.max("overlap").alias("overlap"))


def candidates(vectors: DataFrame, queries: DataFrame, keys: list[str], overlap: Column | None = None, limit: int = CANDIDATES) -> DataFrame:
    """Owners by the least distance of their vectors, over-fetched, then by overlap, distance, key.

    ``vectors`` has the keys and v. Chunks are merged before any limit. Returns query_id, keys,
    distance, chunks, overlap, rank.
    """
    rows = vectors.select(*keys, "v", (F.lit(0) if overlap is None else F.coalesce(overlap, F.lit(0))).cast("long").alias("overlap"))
    merged = owner_distances(rows, queries, keys)
    near = Window.partitionBy("query_id").orderBy("distance", *keys)
    final = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "distance", *keys)
    return (
        merged.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= OVERFETCH * limit)
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= limit).drop("nth")
    )


def row_candidates(vectors: DataFrame, queries: DataFrame, key: str, overlap: Column, limit: int = CANDIDATES) -> DataFrame:
    """``candidates`` where each row is its own owner: tasks send only what can be over-fetched."""
    found = scored(vectors.select(key, "v", overlap.cast("long").alias("overlap")), queries, best=OVERFETCH * limit)
    found = found.withColumn("distance", F.round("distance", DECIMALS))
    near = Window.partitionBy("query_id").orderBy("distance", key)
    final = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "distance", key)
    return (
        found.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= OVERFETCH * limit)
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= limit).drop("nth")
    )


def rrf(lists: list[DataFrame], keys: list[str], limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists with query_id, keys and rank; ties by key."""
    union = None
    for one in lists:
        one = one.select("query_id", *keys, "rank")
        union = one if union is None else union.unionByName(one)
    fused = union.groupBy("query_id", *keys).agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("rrf"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), *keys)
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def neighbours(vectors: DataFrame, seeds: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest products per seed, the seed itself left out; ties by key. Vectors have unit length."""
    if not 1 <= k <= 20:
        raise ValueError("k is 1 to 20")
    # one more than k, as the seed is among its own best
    near = scored(vectors.select(key, "v"), seeds.select(F.col(key).alias("query_id"), F.col("v").alias("q")), best=k + 1, product=True).withColumnRenamed("query_id", "seed")
    near = near.filter(F.col(key) != F.col("seed")).withColumn("similarity", F.round("similarity", DECIMALS))
    order = Window.partitionBy("seed").orderBy(F.desc("similarity"), key)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("seed", key, "similarity", "rank")
