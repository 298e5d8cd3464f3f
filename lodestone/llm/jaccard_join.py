"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (64-bit hashes). Equal sets are one node from the start.
Nodes get 128 MinHash values; 32 bands of 4 values give candidates. The values are compared
32 at a time, and a pair goes as soon as the posterior probability that its similarity
reaches the threshold, given the matches so far, is below the tolerance. What is left is
verified on the whole shingle sets, exactly.

Layout: signatures and the shingle sets of candidate nodes are sorted arrays in the shared
folder, mapped into memory by the workers. Buckets of a band are cut into blocks of at most
``BLOCK`` nodes; a block meets each later one of its bucket by (bucket, block), so
that a hot bucket's work spreads; a task gets two blocks' node ids, makes their pairs in memory in bounded
chunks, and keeps a pair only in the first band that both share. It returns one row per node
and chunk: the number of its links, and its representative among the nodes it is connected
with there. So a group of many near copies gives rows in proportion to its size and blocks,
though each of its pairs is examined. Representatives are merged to classes by repeated
minimum and pointer jumping over written tables.

At similarity 0.8, a pair is in no common band with probability (1 - 0.8**4)**32 < 5e-8; the
tolerance of the pruning is 1e-9. Those are the only ways to lose a link.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SortedMap, bounded, hashed_words, map_array, mixed, part_of, put_array, rolling, scratch, segment_of, split_by, tidy, written

VALUES, BANDS, STEP = 128, 32, 32
ROWS = VALUES // BANDS
TOLERANCE = 1e-9
#: Nodes of a block, pairs examined and shingles verified together.
BLOCK, CHUNK, TOGETHER = 256, 40_000, 500_000
#: Nodes per segment: a 64th of them all, within these bounds.
FEWEST_NODES, MOST_NODES = 1_024, 16_384
_ODD = 0xA0761D6478BD642F
_GOLD = 0x9E3779B97F4A7C15


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all ``width`` consecutive words; of all words, if there are fewer."""
    return np.unique(rolling(words, max(1, min(width, len(words))), _ODD)) if len(words) else words


def set_key(hashes: np.ndarray) -> np.uint64:
    """One number for a set: equal sets have equal keys."""
    return mixed(np.array([mixed(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0]


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(_GOLD)
    k = mixed(k)
    return k[:VALUES] | np.uint64(1), k[VALUES:]


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values: the upper half of the least of a * h + b for each of the VALUES functions."""
    a, b = _multipliers()
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[lo : lo + 2048, None] * a + b).min(axis=0), out)
    return (out >> np.uint64(32)).astype(np.uint32)


@lru_cache(64)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches of n for which P(similarity >= threshold | matches) is not below the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is the
    probability that Binomial(n + 1, t) is at most m.
    """
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


class Store:
    """Signatures by node key, and shingle sets of candidates, in the shared folder."""

    def __init__(self, uri: str, parts: int, set_parts: int):
        self.uri, self.parts, self.set_parts = uri, parts, set_parts
        self.nodes = SortedMap(f"{uri}/nodes", parts, {"size": "<i8", "row": "<i8"})
        self.wanted = SortedMap(f"{uri}/wanted", parts, {})
        self.sets = SortedMap(f"{uri}/sets", set_parts, {"at": "<i8", "n": "<i8"})

    def put_nodes(self, part: int, keys: np.ndarray, sizes: np.ndarray, signatures: np.ndarray) -> None:
        put_array(f"{self.uri}/nodes", f"{part:07d}.sig", signatures.astype("<u4"))
        self.nodes.put(part, keys, size=sizes, row=np.arange(len(keys)))

    def signatures(self, keys: np.ndarray) -> np.ndarray:
        """Signatures of sorted keys that are all known."""
        at = segment_of(keys, self.parts)
        rows = self.nodes.find(keys)[1]["row"]
        out = np.empty((len(keys), VALUES), np.uint32)
        for part in np.unique(at):
            which = at == part
            out[which] = map_array(f"{self.uri}/nodes", f"{int(part):07d}.sig", "<u4").reshape(-1, VALUES)[rows[which]]
        return out

    def put_sets(self, part: int, keys: np.ndarray, sets: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sets], np.int64)
        put_array(f"{self.uri}/sets", f"{part:07d}.all", np.concatenate(sets) if sets else np.empty(0, np.uint64))
        self.sets.put(part, keys, at=np.r_[0, np.cumsum(lengths)[:-1]] if sets else lengths, n=lengths)

    def sets_of(self, keys: np.ndarray) -> list[np.ndarray]:
        """Shingle sets of sorted keys."""
        at = segment_of(keys, self.set_parts)
        hit, got = self.sets.find(keys)
        if not hit.all():
            raise RuntimeError("a candidate has no shingle set")
        return [
            map_array(f"{self.uri}/sets", f"{int(p):07d}.all", "<u8")[lo : lo + n]
            for p, lo, n in zip(at, got["at"].tolist(), got["n"].tolist())
        ]


def _shared_counts(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]; pairs among few nodes by a dense product."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    own = [sets[i] for i in nodes]
    owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
    _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    several = times > 1
    width, count = int(several.sum()), len(own)
    if 2.0 * count * count * width / 2e10 > len(a) * 2e-5:
        out = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(ia.tolist(), ib.tolist())):
            s, t = own[x], own[y]
            if len(s) > len(t):
                s, t = t, s
            pos = np.searchsorted(t, s)
            pos[pos == len(t)] = 0
            out[i] = np.count_nonzero(t[pos] == s)
        return out
    number = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], number[column[keep]]
    product = np.zeros((count, count), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((count, min(4096, width - lo)), np.float32)
        dense[owner[i:j], column[i:j] - lo] = 1
        product += dense @ dense.T
    return product[ia, ib].astype(np.int64)


def verified(store: Store, left: np.ndarray, right: np.ndarray, band: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of node keys, given with the band that they met in, that are similar enough."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    ia, ib = at[: len(left)], at[len(left) :]
    signs = store.signatures(nodes)
    matches = np.zeros(len(ia), np.int64)
    first = np.full(len(ia), BANDS)
    for lo in range(0, VALUES, STEP):
        same = signs[ia, lo : lo + STEP] == signs[ib, lo : lo + STEP]
        matches += same.sum(axis=1)
        whole = same.reshape(len(ia), -1, ROWS).all(axis=2)
        met = np.where(whole.any(axis=1), whole.argmax(axis=1) + lo // ROWS, BANDS)
        first = np.minimum(first, met)
        # a pair that met in an earlier band is examined there
        live = (matches >= least_matches(lo + STEP, threshold, TOLERANCE)) & (first >= np.minimum(band, (lo + STEP) // ROWS))
        ia, ib, band, matches, first = ia[live], ib[live], band[live], matches[live], first[live]
    live = first == band
    ia, ib = ia[live], ib[live]
    if not len(ia):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    used, at = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    a, b = at[: len(ia)], at[len(ia) :]
    sets = store.sets_of(nodes[used])
    sizes = np.array([len(s) for s in sets], np.int64)
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    fits = low >= threshold * high - 1e-9
    a, b = a[fits], b[fits]
    both = np.empty(len(a), np.int64)
    for lo, hi in _slices(a, b, sizes):
        both[lo:hi] = _shared_counts(a[lo:hi], b[lo:hi], sets)
    ok = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    return nodes[used][a[ok]], nodes[used][b[ok]]


def _slices(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of pairs whose sets have about ``TOGETHER`` shingles; each node counts where it comes first."""
    flat = np.stack([a, b], axis=1).ravel()
    new = np.zeros(len(flat), np.int64)
    at = np.unique(flat, return_index=True)[1]
    new[at] = sizes[flat[at]]
    run = np.cumsum(new.reshape(-1, 2).sum(axis=1)) // TOGETHER
    cuts = np.flatnonzero(np.diff(run)) + 1
    return [(int(lo), int(hi)) for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(a)]) if hi > lo]


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, by minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _linked(store: Store, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Verified pairs as one row per node: links (rows that repeat a set count each) and a root."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    size = store.nodes.find(nodes)[1]["size"]
    links = np.bincount(a, size[b], len(nodes)) + np.bincount(b, size[a], len(nodes))
    root = nodes[_roots(a, b, len(nodes))] if len(nodes) else nodes
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes.view(np.int64)), pa.array(root.view(np.int64)), pa.array(links.astype(np.int64))], names=["node", "root", "links"])


def _classes(edges: DataFrame) -> DataFrame:
    """(node, class): the least node of each connected component of (node, root) edges."""
    both = written(
        edges.select("node", F.col("root").alias("other")).union(edges.select("root", "node")).filter("node <> other").distinct(), "links")
    label = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("class")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("class").alias("c"))
        moved = label.join(near, "node").select("node", F.least("class", "c").alias("next"), F.col("class").alias("old"))
        jump = label.select(F.col("node").alias("next"), F.col("class").alias("further"))
        step = written(
            moved.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("class"), "old"), "labels")
        changed = step.filter("class <> old").limit(1).count()
        label = step.select("node", "class")
        if not changed:
            return label


def text_digest(text: Column) -> Column:
    """SHA-256 of the unchanged text in lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def jaccard_classes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """One row per input row: id, class_id, n_links, is_first, n_shingles, text_sha256.

    Two rows are linked if the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``threshold``; words are what stands between ASCII white space, unchanged. n_links
    is the number of rows that the row is linked with. class_id is the least id of the connected
    component; is_first marks one row that has it, of several the one with the least digest. text_sha256 tells rows that repeat an id apart.

    Edge cases: a text of fewer than ``width`` words has one shingle, all its words; null and
    empty texts have none and are linked with nothing; rows that repeat an id are rows of their
    own, and one row of a class is is_first; null ids count as larger than all others
    and give the class id null only where all ids of a class are null; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    parts = max(1, ceil(total / min(max(total // 64, FEWEST_NODES), MOST_NODES)))
    store = Store(scratch(spark, "jaccard"), parts, parts)

    def described(batches):
        made = set()
        for batch in bounded(batches):
            member, keys, counts, signs = [], [], [], []
            for i, words in zip(batch["id"].to_pylist(), split_by(*hashed_words(batch["text"].to_pylist()))):
                s = shingles(words, width)
                key = int(set_key(s)) if len(s) else 0
                member.append(i)
                keys.append(key)
                counts.append(len(s))
                # a task sends a set's signature once, so that very many equal texts stay small
                new = bool(len(s)) and key not in made
                signs.append(signature(s).tobytes() if new else None)
                if new and len(made) < 2_000_000:
                    made.add(key)
            node = np.array(keys, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(member, pa.int64()), pa.array(node.view(np.int64)), pa.array(counts, pa.int64()),
                 pa.array(segment_of(node, parts).astype(np.int32)), pa.array(signs, pa.binary()), batch["digest"]],
                names=["id", "node", "n_shingles", "part", "sig", "digest"])

    # the number tells apart what has the same id and text; it is written once, so that it stays
    rows = written(
        docs.withColumn("digest", F.unhex(text_digest(F.col("text"))))
        .mapInArrow(described, "id long, node long, n_shingles long, part int, sig binary, digest binary")
        .withColumn("row", F.monotonically_increasing_id()), "signatures")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "row")
    sizes = written(rows.filter("n_shingles > 0").groupBy("node").agg(F.count("*").alias("size"), F.min(place).alias("least")), "nodes")
    joined = rows.filter("sig is not null").select("part", "node", "sig").join(sizes.select("node", "size"), "node")

    def nodes(table: pa.Table) -> pa.Table:
        keys = table["node"].to_numpy().view(np.uint64)
        keys, at = np.unique(keys, return_index=True)
        signs = np.frombuffer(b"".join(table["sig"].take(pa.array(at)).to_pylist()), "<u4").reshape(-1, VALUES)
        store.put_nodes(table["part"][0].as_py(), keys, table["size"].to_numpy()[at], signs)
        band = np.zeros((len(keys), BANDS), np.uint64)
        for r in range(ROWS):
            band = band * np.uint64(_GOLD) + signs[:, r::ROWS]
        band = mixed(band * np.uint64(_ODD) + np.arange(BANDS, dtype=np.uint64))
        return pa.table({
            "bucket": pa.array(band.ravel().view(np.int64)), "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
            "node": pa.array(np.repeat(keys, BANDS).view(np.int64))})

    bands = written(joined.groupBy("part").applyInArrow(nodes, "bucket long, band int, node long"), "bands")
    store.nodes.seal(r[0] for r in sizes.select(part_of(F.col("node"), parts)).distinct().collect())
    full = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(
        bands.join(full, "bucket").withColumn("last", F.expr(f"ceil(n / {BLOCK}) - 1")).withColumn("block", F.expr("pmod(xxhash64(node), last + 1)")).drop("n"), "members")

    def want(table: pa.Table) -> pa.Table:
        store.wanted.put(table["part"][0].as_py(), np.sort(table["node"].to_numpy().view(np.uint64)))
        return pa.table({"part": table["part"][:1]})

    wanted = members.select("node").distinct().withColumn("part", part_of(F.col("node"), parts))
    store.wanted.seal(r.part for r in wanted.groupBy("part").applyInArrow(want, "part int").collect())

    def sets(batches):
        made = set()
        for batch in bounded(batches):
            found = [(int(set_key(s)), s) for s in (shingles(w, width) for w in split_by(*hashed_words(batch["text"].to_pylist()))) if len(s)]
            keys = np.array([k for k, _ in found], np.uint64)
            order = np.argsort(keys)
            hit = store.wanted.find(keys[order])[0]
            out = {}
            for i in order[hit].tolist():
                if found[i][0] not in made:
                    out[found[i][0]] = found[i][1]
                    if len(made) < 2_000_000:
                        made.add(found[i][0])
            if out:
                node = np.array(list(out), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment_of(node, parts).astype(np.int32)), pa.array(node.view(np.int64)), pa.array([s.tobytes() for s in out.values()], pa.binary())],
                    names=["part", "node", "hashes"])

    def keep(table: pa.Table) -> pa.Table:
        keys, at = np.unique(table["node"].to_numpy().view(np.uint64), return_index=True)
        store.put_sets(table["part"][0].as_py(), keys, [np.frombuffer(x, "<u8") for x in table["hashes"].take(pa.array(at)).to_pylist()])
        return pa.table({"part": table["part"][:1]})

    kept = docs.mapInArrow(sets, "part int, node long, hashes binary").groupBy("part").applyInArrow(keep, "part int")
    store.sets.seal(r.part for r in kept.collect())

    blocks = written(members.groupBy("bucket", "band", "block").agg(F.collect_list("node").alias("nodes"), F.first("last").alias("last")), "blocks")
    alone = blocks.select("band", F.col("nodes").alias("left"), F.lit(None).cast("array<long>").alias("right")).filter("size(left) > 1")
    # each block asks for those after it by (bucket, block), so that no task makes all pairs of a bucket
    asked = blocks.filter("block < last").select("bucket", "band", F.col("nodes").alias("left"), F.explode(F.expr("sequence(block + 1, last)")).alias("block"))
    crossed = asked.join(blocks.select("bucket", "block", F.col("nodes").alias("right")), ["bucket", "block"]).select("band", "left", "right")
    tasks = alone.unionByName(crossed)

    def examined(batches):
        held, n = [], 0
        for batch in batches:
            for band, left, right in zip(batch["band"].to_pylist(), batch["left"], batch["right"]):
                x = left.values.to_numpy().view(np.uint64)
                if right.is_valid:
                    y = right.values.to_numpy().view(np.uint64)
                    a, b = np.repeat(x, len(y)), np.tile(y, len(x))
                else:
                    i, j = np.triu_indices(len(x), 1)
                    a, b = x[i], x[j]
                held.append((a, b, np.full(len(a), band, np.int64)))
                n += len(a)
                if n >= CHUNK:
                    yield _linked(store, *verified(store, *map(np.concatenate, zip(*held)), threshold))
                    held, n = [], 0
        if held:
            yield _linked(store, *verified(store, *map(np.concatenate, zip(*held)), threshold))
        tidy()

    spread = tasks.repartition(max(1, ceil(total / 2048)), F.xxhash64("left", "right", "band"))
    links = written(spread.mapInArrow(examined, "node long, root long, links long"), "verified")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    label = _classes(links.select("node", "root"))
    info = sizes.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = info.groupBy("class").agg(F.min("least").alias("least")).select("class", F.col("least.id").alias("class_id"), F.col("least.row").alias("first"))
    info = written(
        info.join(least, "class").join(counted, "node", "left")
        .select("node", "class_id", "first", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")), "classes")
    out = rows.select("id", "node", "n_shingles", "digest", "row").join(info, "node", "left")
    lone = F.col("n_shingles") == 0
    class_id = F.when(lone, F.col("id")).otherwise(F.col("class_id"))
    return out.select(
        F.col("id").alias(id_col), class_id.alias("class_id"), F.when(lone, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
        (lone | (F.col("row") == F.col("first"))).alias("is_first"), "n_shingles", F.lower(F.hex("digest")).alias("text_sha256"),
    )
