"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Candidates are dealt by the nearest of a few pivot vectors, so that shards are compact, and a
pivot's rows are cut into shards of about ``shard_rows`` by a hash, so that a vector that very
many rows repeat spreads evenly. Each shard becomes one ball tree, an array file in the shared
folder; root balls are listed in directories of ``DIRECTORY`` shards. Trees never travel:
queries are packed into blocks, a block first searches its most promising shard, which gives
every query a k-th score to start from, and then goes to one task per group of directories.
That task skips all shards whose root ball can't hold a better row for any query of the block,
visits the others from the largest bound down, memory-mapped, and carries the best k rows from
tree to tree, so that the k-th score is shared. A node is skipped when no query of the block
can still find a better row in it, judged by the upper bound ``q . centre + |q| * radius``.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_array, put_array, scratch, written

LOW = np.iinfo(np.int64).min
HIGH = np.iinfo(np.int64).max
EXACT = 2.0**52
#: Shards per directory of root balls, and vectors that are sampled as pivots (they decide only
#: where a row lies, never whether it is found).
DIRECTORY, PIVOTS = 256, 64
#: Partitions that the searches are spread over at most.
MOST_PARTITIONS = 8192


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, computed in double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """False for null vectors and for those with a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dim)


def build_tree(ids: np.ndarray, rows_: np.ndarray, vectors: np.ndarray, leaf: int = 64) -> dict:
    """Ball tree as arrays; rows are reordered so that each node is one slice."""
    points = vectors.astype(np.float64)
    order = np.argsort(ids, kind="stable")
    nodes, todo = [], [(0, len(ids), -1)]
    while todo:
        lo, hi, parent = todo.pop()
        rows = order[lo:hi]
        own = points[rows]
        centre = own.mean(axis=0) if hi > lo else np.zeros(points.shape[1])
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())) if hi > lo else 0.0
        me = len(nodes)
        nodes.append([centre, radius, lo, hi, int(ids[rows].min()), -1, -1])
        if parent >= 0:
            nodes[parent][5 if nodes[parent][5] < 0 else 6] = me
        if hi - lo > leaf and radius > 0:
            far = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            order[lo:hi] = rows[np.argsort(side, kind="stable")]
            mid = (lo + hi) // 2
            todo += [(mid, hi, me), (lo, mid, me)]
    return {
        "ids": ids[order],
        "rows": rows_[order],
        "vectors": vectors[order],
        "norm": np.sqrt((points**2).sum(axis=1).max(keepdims=True)),
        "centre": np.array([n[0] for n in nodes]),
        "radius": np.array([n[1] for n in nodes]),
        "span": np.array([n[2:5] for n in nodes], dtype=np.int64),
        "child": np.array([n[5:] for n in nodes], dtype=np.int64),
    }


_ORDER = ("ids", "rows", "vectors", "span", "child", "norm", "centre", "radius")


def as_array(tree: dict) -> np.ndarray:
    """The tree as one array of 64-bit words, the sizes first."""
    n, dim = tree["vectors"].shape
    words = [np.array([n, dim, len(tree["radius"])], np.int64)]
    for name in _ORDER:
        words.append(np.ascontiguousarray(tree[name]).view(np.int64).ravel())
    return np.concatenate(words)


def from_array(words: np.ndarray) -> dict:
    n, dim, nodes = words[:3].tolist()
    shapes = {"ids": (n,), "rows": (n,), "vectors": (n, dim), "span": (nodes, 3), "child": (nodes, 2), "norm": (1,), "centre": (nodes, dim), "radius": (nodes,)}
    tree, at = {}, 3
    for name in _ORDER:
        size = int(np.prod(shapes[name]))
        part = words[at : at + size]
        tree[name] = (part.view(np.float64) if name in ("norm", "centre", "radius") else part).reshape(shapes[name])
        at += size
    return tree


def _merge(state: dict, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Merge a leaf's scores into the best k of the given queries; ties go to the smaller id."""
    useful = (scores >= state["score"][rows, k - 1][:, None]).any(axis=1)
    rows, scores = rows[useful], scores[useful]
    if not len(rows):
        return
    all_scores = np.concatenate([state["score"][rows], scores], axis=1)
    all_ids = np.concatenate([state["id"][rows], np.broadcast_to(ids, scores.shape)], axis=1)
    best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
    state["score"][rows] = np.take_along_axis(all_scores, best, axis=1)
    state["id"][rows] = np.take_along_axis(all_ids, best, axis=1)


def bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest score that each query can reach in each ball, rounded up."""
    q = queries.astype(np.float64)
    top = q @ centre.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius
    return top + 1e-9 * (np.abs(top) + 1)


def still_open(state: dict, top: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Whether a ball of the given bound and least id can still change a query's best k rows."""
    kth, at = state["score"][:, k - 1], state["id"][:, k - 1]
    if top.ndim > 1:
        kth, at = kth[:, None], at[:, None]
    # at an equal score only a smaller id can still enter
    return (top > kth) | ((np.floor(top) >= kth) & (least < at))


def search_tree(tree: dict, query_rows: np.ndarray, queries: np.ndarray, state: dict, k: int) -> None:
    """Branch and bound of one tree for a block of queries, best first; updates ``state``."""
    exact = tree["norm"][0] * float(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) < EXACT
    bound = bounds(queries, tree["centre"], tree["radius"])
    kind = np.float64 if exact else np.int64
    q = queries.astype(kind)
    heap = [(0.0, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        rows = np.flatnonzero(still_open(state, bound[:, node], tree["span"][node, 2], k))
        if not len(rows):
            continue
        left, right = tree["child"][node]
        if left < 0:
            lo, hi = tree["span"][node, :2]
            ids = tree["ids"][lo:hi]
            scores = (q[rows] @ tree["vectors"][lo:hi].astype(kind).T).astype(np.int64)
            scores[query_rows[rows][:, None] == tree["rows"][lo:hi][None, :]] = LOW
            _merge(state, rows, ids, scores, k)
            continue
        for child in (int(left), int(right)):
            heapq.heappush(heap, (-float(bound[rows, child].mean()), child))


class Index:
    """Trees and root balls in the shared folder."""

    def __init__(self, uri: str, leaf: int):
        self.uri, self.leaf = uri, leaf

    def put_tree(self, shard: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float, int]:
        tree = build_tree(ids, rows, vectors, self.leaf)
        put_array(self.uri, f"{shard:07d}.tree", as_array(tree))
        return tree["centre"][0], float(tree["radius"][0]), int(tree["span"][0, 2])

    def tree(self, shard: int) -> dict:
        return from_array(map_array(self.uri, f"{shard:07d}.tree", "<i8"))

    def put_directory(self, number: int, shards: np.ndarray, least: np.ndarray, radius: np.ndarray, centre: np.ndarray) -> None:
        n, dim = centre.shape
        put_array(self.uri, f"{number:07d}.roots", np.concatenate(
            [[n, dim], shards, least, radius.view(np.int64), np.ascontiguousarray(centre).view(np.int64).ravel()]).astype(np.int64))

    def directory(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = map_array(self.uri, f"{number:07d}.roots", "<i8")
        n, dim = words[:2].tolist()
        shards, least, radius = words[2 : 2 + 3 * n].reshape(3, n)
        return shards, least, radius.view(np.float64), words[2 + 3 * n :].view(np.float64).reshape(n, dim)

    def search(self, directories: range, query_rows: np.ndarray, queries: np.ndarray, state: dict, k: int, most: int | None = None) -> None:
        """Search all shards (or the ``most`` most promising ones) of some directories, the largest bound first."""
        found = []
        for number in directories:
            shards, least, radius, centre = self.directory(number)
            top = bounds(queries, centre, radius)
            may = still_open(state, top, least, k)
            for j in np.flatnonzero(may.any(axis=0)).tolist():
                found.append((float(top[may[:, j], j].mean()), int(shards[j]), top[:, j], int(least[j])))
        found.sort(key=lambda f: (-f[0], f[1]))
        for _, shard, top, least in found[:most]:
            if still_open(state, top, least, k).any():
                search_tree(self.tree(shard), query_rows, queries, state, k)


def exact_top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    query_every: int = 50,
    scale: int = 256,
    shard_rows: int = 4096,
    block_rows: int = 512,
    leaf: int = 64,
    tasks: int = 64,
) -> DataFrame:
    """The k candidates of largest integer inner product for each query row.

    Components are ``floor(scale * x)``. Queries are the rows whose id is divisible by
    ``query_every``; candidates are all other rows. Returns (query_id, rank, vec_id, score),
    ranks from 1, ties to the smaller id; fewer than k rows where there are fewer candidates.
    ``tasks`` is the number of searches that few query blocks are split into, by groups of
    directories.

    Edge cases: rows with a null id, a null vector, or a null or non-finite component take no
    part. Only vectors of the query's own length are compared; vectors of length 0 score 0.
    Rows that repeat an id are separate candidates, also of each other, and separate queries
    (each gives its own ranks). An empty table gives an empty result. Scores must fit a 64-bit
    integer; beyond 2**52 the products are computed in integers. Other columns are ignored.
    """
    spark = vectors.sparkSession
    clean = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    clean = clean.select("id", quantised(F.col("v"), scale).alias("v"), F.size("v").alias("dim"))
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = {d: np.unique([r.v for r in sample if r.dim == d], axis=0).astype(np.float64) for d in {r.dim for r in sample}}

    def nearest(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            out = np.zeros(len(dims), np.int32)  # lengths without a pivot are one part
            for d in np.unique(dims).tolist():
                own, p = np.flatnonzero(dims == d), pivots.get(d)
                if p is not None and len(p) > 1:
                    points = _matrix(batch["v"].take(pa.array(own)), d).astype(np.float64)
                    out[own] = ((p**2).sum(axis=1) - 2 * (points @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], batch["dim"], pa.array(out)], names=["id", "v", "dim", "pivot"])

    # the row number is written once, so that it stays; it salts what one id or vector repeats
    rows = written(clean.mapInArrow(nearest, "id long, v array<long>, dim int, pivot int").withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    parts = rows.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_every == 0).alias("asked")).orderBy("dim", "pivot").collect()
    table, spans, asked, at = [], {}, {}, 0  # at most PIVOTS parts per length of vectors
    for r in parts:
        if r.dim not in spans:
            at = ceil(at / DIRECTORY) * DIRECTORY  # a directory has vectors of one length
            spans[r.dim] = [at, at]
        shards = max(1, ceil(r.n / shard_rows))
        table.append((r.dim, r.pivot, at, shards))
        at += shards
        spans[r.dim][1] = at
        asked[r.dim] = asked.get(r.dim, 0) + r.asked
    directories = {d: range(lo // DIRECTORY, ceil(hi / DIRECTORY)) for d, (lo, hi) in spans.items()}
    blocks = {d: max(1, ceil(n / block_rows)) for d, n in asked.items()}
    index = Index(scratch(spark, "topk-index"), leaf)
    layout = spark.createDataFrame(table, "dim int, pivot int, first int, shards int")
    hinted = F.broadcast if len(table) <= 100_000 else lambda x: x

    def shard_tree(t: pa.Table) -> pa.Table:
        dim, shard = t["dim"][0].as_py(), t["shard"][0].as_py()
        centre, radius, least = index.put_tree(shard, t["id"].to_numpy().astype(np.int64), t["row"].to_numpy().astype(np.int64), _matrix(t["v"], dim))
        return pa.table({"directory": [shard // DIRECTORY], "shard": [shard], "least": [least], "radius": [radius], "centre": [centre.tolist()]}, schema=pa.schema(
            [("directory", pa.int32()), ("shard", pa.int32()), ("least", pa.int64()), ("radius", pa.float64()), ("centre", pa.list_(pa.float64()))]))

    def listed(t: pa.Table) -> pa.Table:
        centre = t["centre"].combine_chunks()
        centre = centre.flatten().to_numpy(zero_copy_only=False).reshape(len(centre), -1 if len(centre.flatten()) else 0)
        index.put_directory(t["directory"][0].as_py(), t["shard"].to_numpy().astype(np.int64), t["least"].to_numpy(), t["radius"].to_numpy(), centre)
        return pa.table({"directory": t["directory"][:1]})

    dealt = rows.join(hinted(layout), ["dim", "pivot"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("shards"))).cast("int"))
    roots = dealt.select("dim", "shard", "id", "row", "v").groupBy("dim", "shard").applyInArrow(
        shard_tree, "directory int, shard int, least long, radius double, centre array<double>")
    present = {r.directory for r in roots.groupBy("directory").applyInArrow(listed, "directory int").collect()}  # a row per DIRECTORY shards
    directories = {d: [x for x in span if x in present] for d, span in directories.items()}

    packed = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("v", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))])

    def query_block(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        queries, own = _matrix(t["v"], dim), t["row"].to_numpy().astype(np.int64)
        state = {"score": np.full((len(own), k), LOW), "id": np.full((len(own), k), HIGH)}
        index.search(directories[dim], own, queries, state, k, 1)
        return pa.table({"dim": t["dim"][:1], "block": t["block"][:1], "ids": [t["id"].to_pylist()], "rows": [own.tolist()], "v": [queries.ravel().tolist()],
                         "least": [state["score"][:, k - 1].tolist()]}, schema=packed)

    names = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def searched(batches):
        for batch in batches:
            for dim, part, ids, own, v, least in zip(*(batch[c].to_pylist() for c in ("dim", "part", "ids", "rows", "v", "least"))):
                ids, own, least = (np.array(x, np.int64) for x in (ids, own, least))
                queries = np.array(v, np.int64).reshape(len(ids), dim)
                # k placeholders at the known k-th score: rows must reach it, ties may
                state = {"score": np.repeat(least[:, None], k, axis=1), "id": np.full((len(ids), k), HIGH)}
                index.search(directories[dim][part :: groups[dim]], own, queries, state, k)
                q, at = np.nonzero((state["id"] != HIGH) & (state["score"] != LOW))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[q], ids[q], state["id"][q, at], state["score"][q, at])], schema=names)

    groups = {d: max(1, min(len(directories[d]), ceil(tasks / blocks[d]))) for d in blocks}
    plan = spark.createDataFrame([(d, blocks[d], groups[d]) for d in blocks], "dim int, blocks int, groups int")
    queries = rows.filter(F.col("id") % query_every == 0).join(hinted(plan), "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    seeded = written(
        queries.select("dim", "block", "id", "row", "v").groupBy("dim", "block")
        .applyInArrow(query_block, "dim int, block int, ids array<long>, rows array<long>, v array<long>, least array<long>"), "topk-blocks")
    spread = seeded.join(hinted(plan.drop("blocks")), "dim").withColumn("part", F.explode(F.expr("sequence(0, groups - 1)"))).drop("groups")
    spread = spread.repartition(max(1, min(MOST_PARTITIONS, sum(blocks[d] * groups[d] for d in blocks))), "dim", "block", "part")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        spread.mapInArrow(searched, "query_row long, query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
