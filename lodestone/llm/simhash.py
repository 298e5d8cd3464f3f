"""SimHash near duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, of the hashes of all word shingles of a whole text. Two of them with
at most ``radius`` differing bits have a variant in common that differs from either in at
most half as many. So every distinct fingerprint emits all its variants within half the
radius (2081 for radius 4), the variants are shuffled, and where fingerprints collide their
distance is verified.

Variants travel packed: a task takes some thousand fingerprints, hashes all their variants to
numbers of a few more bits than it takes to count all variants, sorts them together with the
place of their fingerprint, and sends each range of numbers as differences, with the
fingerprints it needs. The receiver of a range merges the blobs and finds equal numbers. All
fingerprints of one variant are within the radius of each other, so that a star of links from
the first connects them, whatever their number; where one is too far, so that different
variants share a number, a small set is compared pairwise and the variants of a larger one are
computed again. A range gives one link per fingerprint, to the first of its connected ones
there. Components are joined over written tables of links.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import bounded, mixed, small, tidy, written

#: Fingerprints whose variants a task sorts together, at least one; variants in a range, and
#: members of a set of equal numbers that are compared pairwise.
TOGETHER, VARIANTS_TOGETHER, RANGE, PAIRWISE = 4096, 8_000_000, 4_000_000, 48
#: Bits of a number beyond those that count all variants: a 32nd of all variants then meets a stranger.
MORE_BITS = 5
#: Leading bits of a number that tell its range.
SLICED = 30
#: Shingles whose bits are summed together (what a byte can count), and texts' bytes at a time.
SUMMED, SLICE = 255, 3_000_000
#: Linked fingerprints that may be broadcast (16 bytes each).
BROADCAST_LINKED = 500_000

#: For each byte, its bits as eight bytes of a number, the lowest bit in the lowest byte.
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of all ``width`` words in a row, joined by one space; of all, if fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = (ends - 1)[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    first = [0, *ends.tolist()]
    return [xxh64_intdigest(joined[lo:hi], 42) for lo, hi in zip(first, last)]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, whose number of hashes stands in ``counts``: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    firsts = (np.cumsum(counts) - counts)[some]
    pieces = -(-counts[some] // SUMMED)
    text = np.repeat(np.arange(len(some)), pieces)
    within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = firsts[text] + within * SUMMED
    owners = np.flatnonzero(np.diff(text, prepend=-1))
    half = counts[some, None] // 2
    planes = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[planes[:, k]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), owners, axis=0)
        bits = np.packbits(sums > half, axis=1, bitorder="little")[:, 0]
        out[some] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprinted(documents: DataFrame, width: int) -> DataFrame:
    """(id, fp) for every row of (id, text); fp as a signed number."""

    def described(batches):
        for batch in bounded(batches, "text", SLICE):
            texts = batch["text"].cast(pa.binary()).to_pylist()
            hashes = [shingle_hashes(t or b"", width) for t in texts]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for one in hashes for h in one), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fingerprints(flat, counts).view(np.int64))], names=["id", "fp"])

    return documents.mapInArrow(described, "id long, fp long")


@lru_cache(4)
def flips(reach: int) -> np.ndarray:
    """All 64-bit numbers with at most ``reach`` bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(64), n)], np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def numbers(variants: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of a mix of each variant."""
    return mixed(variants) >> np.uint64(64 - bits)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, by minimum and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def collisions(values: np.ndarray, owners: np.ndarray, fps: np.ndarray, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) among ``fps`` that connect all that share a variant; no two further than ``radius``.

    ``values`` are the numbers of variants in order, ``owners`` the places of their fingerprints.
    """
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(values)])
    several = sizes > 1
    first, sizes = first[several], sizes[several]
    group = np.repeat(np.arange(len(first)), sizes)
    at = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    member, star = owners[at], np.repeat(owners[first], sizes)
    near = distance(fps[member], fps[star]) <= radius
    links = [(star[near & (member != star)], member[near & (member != star)])]
    mixed_up = np.zeros(len(first), bool)
    mixed_up[group[~near]] = True
    rest = mixed_up & (sizes > 2)
    for few, which in ((True, rest & (sizes <= PAIRWISE)), (False, rest & (sizes > PAIRWISE))):
        for lo, n in zip(first[which].tolist(), sizes[which].tolist()):
            own = owners[lo : lo + n]
            if few:
                i, j = np.triu_indices(n, 1)
                i, j = own[i], own[j]
                ok = distance(fps[i], fps[j]) <= radius
                links.append((i[ok], j[ok]))
                continue
            # whose variant is it? computed again, some members at a time
            balls = flips(radius // 2)
            sets: dict[int, int] = {}
            for k in range(0, n, 256):
                block = own[k : k + 256]
                variants = fps[block, None] ^ balls
                hit, which_ball = np.nonzero(numbers(variants, bits) == values[lo])
                pairs = [(sets.setdefault(int(variants[h, v]), int(block[h])), int(block[h])) for h, v in zip(hit, which_ball)]
                links.append((np.array([p for p, _ in pairs], np.int64), np.array([q for _, q in pairs], np.int64)))
    a, b = (np.concatenate(x) for x in zip(*links))
    return a, b


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as the byte planes of their differences, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, other): links that connect all distinct fingerprints within ``radius`` bits of each other."""
    if radius % 2:
        raise ValueError("the radius must be even: members of one ball are then within it")
    reach = radius // 2
    balls = sum(comb(64, k) for k in range(reach + 1))
    total = distinct.count()
    bits = max(SLICED, min(48, ceil(log2(max(2, total * balls))) + MORE_BITS))
    ranges = max(1, ceil(total * balls / RANGE))
    # a set's place has as many bits as are left beside the number
    together = max(1, min(TOGETHER, VARIANTS_TOGETHER // balls, 1 << (64 - bits)))
    place_bits = max(1, ceil(log2(max(2, together))))

    def emitted(batches):
        spare: list[np.ndarray] = []

        def sent(fps: np.ndarray):
            values = numbers((fps[:, None] ^ flips(reach)).ravel(), bits) << np.uint64(place_bits)
            values |= np.repeat(np.arange(len(fps), dtype=np.uint64), balls)
            values.sort()
            # equal slices of the numbers, in their order
            part = ((values >> np.uint64(place_bits + bits - SLICED)).astype(np.int64) * ranges) >> SLICED
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                block = values[lo:hi]
                if hi - lo < 4 * len(fps):  # only the fingerprints that it needs
                    used, place = np.unique((block & np.uint64((1 << place_bits) - 1)).astype(np.int64), return_inverse=True)
                    own = fps[used]
                    block = np.sort((block >> np.uint64(place_bits) << np.uint64(place_bits)) | place.astype(np.uint64))
                else:
                    own = fps
                yield int(part[lo]), own.tobytes(), _packed(block)

        def out(fps):
            rows = list(sent(fps))
            for lo in range(0, len(rows), 64):
                cut = rows[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in cut], pa.int32()), pa.array([r[1] for r in cut], pa.binary()), pa.array([r[2] for r in cut], pa.binary())],
                    names=["part", "fps", "variants"])

        for batch in batches:
            spare.append(batch["fp"].to_numpy().view(np.uint64))
            while sum(map(len, spare)) >= together:
                fps = np.concatenate(spare)
                yield from out(fps[:together])
                spare = [fps[together:]]
        if sum(map(len, spare)):
            yield from out(np.concatenate(spare))
        tidy()

    def met(batches):
        held: list[tuple[bytes, bytes]] = []
        now = None
        left: list[np.ndarray] = []

        def joined():
            fps, values, owners, before = [], [], [], 0
            for own, blob in held:
                one = np.frombuffer(own, np.uint64)
                packed = _unpacked(blob)
                fps.append(one)
                values.append(packed >> np.uint64(place_bits))
                owners.append((packed & np.uint64((1 << place_bits) - 1)).astype(np.int64) + before)
                before += len(one)
            fps, values, owners = np.concatenate(fps), np.concatenate(values), np.concatenate(owners)
            known, place = np.unique(fps, return_inverse=True)
            order = np.argsort(values, kind="stable")
            a, b = collisions(values[order], place[owners[order]], known, radius, bits)
            root = roots(a, b, len(known))
            moved = np.flatnonzero(root != np.arange(len(root)))
            return np.stack([known[moved], known[root[moved]]])

        def sent():
            pairs = np.concatenate(left, axis=1)
            known, at = np.unique(pairs, return_inverse=True)
            at = at.reshape(pairs.shape)
            root = roots(at[0], at[1], len(known))
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(known[moved].view(np.int64)), pa.array(known[root[moved]].view(np.int64))], names=["fp", "other"])

        for batch in batches:
            for part, fps, variants in zip(batch["part"].to_pylist(), batch["fps"].to_pylist(), batch["variants"].to_pylist()):
                if part != now and held:
                    left.append(joined())
                    held = []
                    if sum(x.shape[1] for x in left) > 1_000_000:
                        yield sent()
                        left = []
                now = part
                held.append((fps, variants))
        if held:
            left.append(joined())
        if left:
            yield sent()
        tidy()

    spark = distinct.sparkSession
    tasks = min(ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(ranges / 16)))
    blobs = distinct.mapInArrow(emitted, "part int, fps binary, variants binary")
    dealt = blobs.repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(met, "fp long, other long")


def components(links: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint in ``links``: the least one that it is connected with.

    Each round every root takes the least root that one of its members' links reaches, and roots of
    roots are followed to their ends, so that the links between different roots fall fast.
    """
    links = written(links.distinct(), "near-links")
    label = written(links.select("fp").union(links.select("other")).distinct().withColumn("root", F.col("fp")), "roots")
    while True:
        ends = links.join(label.withColumnRenamed("root", "a"), "fp").join(label.select(F.col("fp").alias("other"), F.col("root").alias("b")), "other")
        ends = ends.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        hooks = written(ends.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        if not hooks.limit(1).count():
            return label
        while True:  # a root's hook may be hooked itself; halving the way each time
            further = hooks.select(F.col("high").alias("low"), F.col("low").alias("further"))
            step = written(hooks.join(further, "low", "left").select("high", F.coalesce("further", "low").alias("low"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = step.select("high", "low")
            if not step.filter("moved").limit(1).count():
                break
        label = written(
            label.join(hooks.select(F.col("high").alias("root"), "low"), "root", "left").select("fp", F.coalesce("low", "root").alias("root")), "roots")


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Words stand between ASCII white space, A-Z in lower case; a text's shingles are all ``width``
    words in a row, with repeats, or all its words, if there are fewer. A bit of the fingerprint
    is 1 if it is set in over half of the shingles' hashes. Rows are linked if their
    fingerprints differ in at most ``radius`` bits; component_id is the least id that can be
    reached, the row's own included.

    Edge cases: null and empty texts have fingerprint zero, linked like any other; rows that
    repeat an id or a text are rows of their own; null ids count as larger than all others, so
    that component_id is null only where all ids of the component are; an empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(fingerprinted(docs, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    label = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(label, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = written(rooted.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(small(class_of, BROADCAST_LINKED), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
