"""Exact repeated passages by fixed-block anchors.

Any 13 consecutive words contain a whole aligned block of 7 words, wherever the passage
starts. So the non-overlapping 7-word blocks of every document are indexed, and all rolling
7-word windows are probed against that index. Steps, each over all whole texts:

1. index: block hash -> smallest document id that holds it as an aligned block, in sorted
   arrays that the workers map into memory;
2. probe: every rolling window of a document that hits a block of a smaller document is a
   hit; per hit block the largest such document id is kept (few rows: repeats only);
3. extend: around each hit, on both sides of it, every 13-word window that contains the
   block gives its hash; the smallest document id per window is kept, and windows that only
   one document holds go;
4. mark: words covered by a window that also starts in a smaller document are removed. Runs
   of such windows are the maximal exact repeats.

Texts are never shuffled. Hashes have 64 bits, made of 64-bit word hashes.
"""

from __future__ import annotations

from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SortedMap, bounded, hashed_words, rolling, scratch, segment_of, split_by

_ODD7, _ODD13 = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93
TOGETHER = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _lists(batches):
    """(ids, texts) of bounded size, without rows of null id or text."""
    for batch in bounded(batches, "text", TOGETHER):
        rows = [(i, t) for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()) if i is not None and t]
        if rows:
            yield tuple(map(list, zip(*rows)))


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and the least and the largest id of each."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    if not len(keys):
        return keys, ids, ids
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)


MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _windows(words: np.ndarray, counts: np.ndarray, width: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one text, and their number per text."""
    every = rolling(words, width, factor)
    own = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return every[at], own


def covered(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words covered by the windows that start at the given positions."""
    diff = np.zeros(n + 1, np.int32)
    diff[windows] += 1
    diff[np.minimum(windows + width, n)] -= 1
    return np.cumsum(diff[:-1]) > 0


def _keyed(keys: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(segment_of(keys, parts).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))],
        names=["part", "key", "low", "high"])


_SCHEMA = "part int, key long, low long, high long"


def _stored(rows: DataFrame, table: SortedMap, column: str, only_shared: bool) -> int:
    """Sum (part, key, low, high) rows into a sorted map of low or high; returns its size."""
    merged = rows.groupBy("part", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    if only_shared:
        merged = merged.filter("low < high")

    def put(found: pa.Table) -> pa.Table:
        keys = found["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        table.put(found["part"][0].as_py(), keys[order], **{column: found[column].to_numpy()[order]})
        return pa.table({"part": found["part"][:1], "n": pa.array([len(keys)], pa.int64())})

    made = merged.groupBy("part").applyInArrow(put, "part int, n long").collect()  # a row per segment
    table.seal(r.part for r in made)
    return sum(r.n for r in made)


def mark_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, segment_keys: int = 1_000_000
) -> DataFrame:
    """Remove passages that a document with a smaller id holds, too.

    Returns one row per input row: the id, n_words, n_removed, kept_text (kept words joined by
    one space), kept_sha256 of it, and spans: the removed maximal runs as [start, end) in words.

    A word goes if a window of ``width`` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. Edge cases: null and empty texts and texts
    shorter than ``width`` lose nothing; rows with a null id neither lose nor cause anything;
    rows that repeat an id are the same document (none is smaller than the other); an empty
    table gives an empty result. Other columns are ignored.
    """
    if width < 3:
        raise ValueError("width is at least 3")
    block = (width + 1) // 2  # each window holds a whole aligned block
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, ceil(size / 6 / block / segment_keys))
    uri = scratch(spark, "repeats")
    index = SortedMap(f"{uri}/index", parts, {"low": "<i8"})
    hits = SortedMap(f"{uri}/hits", parts, {"high": "<i8"})
    shared = SortedMap(f"{uri}/shared", parts, {"low": "<i8"})

    def blocks(batches):
        for ids, texts in _lists(batches):
            keys, own = _windows(*hashed_words(texts), block, _ODD7)
            first = np.repeat(np.cumsum(own) - own, own)
            aligned = (np.arange(len(keys)) - first) % block == 0
            yield _keyed(*_least(keys[aligned], np.repeat(np.array(ids, np.int64), own)[aligned]), parts)

    def probes(batches):
        for ids, texts in _lists(batches):
            keys, own = _windows(*hashed_words(texts), block, _ODD7)
            owners = np.repeat(np.array(ids, np.int64), own)
            ok = index.lookup(keys, "low", MOST) < owners
            yield _keyed(*_least(keys[ok], owners[ok]), parts)

    indexed = _stored(docs.mapInArrow(blocks, _SCHEMA), index, "low", False)
    hit = _stored(docs.mapInArrow(probes, _SCHEMA), hits, "high", False)

    def windows(batches):
        for ids, texts in _lists(batches):
            words, counts = hashed_words(texts)
            keys, own = _windows(words, counts, block, _ODD7)
            high = hits.lookup(keys, "high", LEAST, hit)
            # a block that nothing hit can't be one of this document's own hits either
            maybe = np.flatnonzero(high > LEAST)
            owners = np.repeat(np.array(ids, np.int64), own)[maybe]
            place = maybe - np.repeat(np.cumsum(own) - own, own)[maybe]
            anchor = (index.lookup(keys[maybe], "low", MOST, indexed) < owners) | ((place % block == 0) & (high[maybe] > owners))
            # window starts p with an anchor in [p, p + width - block], text by text
            texts_of = np.repeat(np.arange(len(ids)), own)[maybe][anchor]
            room = np.maximum(counts - width + 1, 0)
            start = np.cumsum(room) - room
            lo = np.maximum(place[anchor] - (width - block), 0)
            hi = np.minimum(place[anchor] + 1, room[texts_of])
            fits = lo < hi
            diff = np.zeros(int(room.sum()) + 1, np.int32)
            np.add.at(diff, start[texts_of[fits]] + lo[fits], 1)
            np.add.at(diff, start[texts_of[fits]] + hi[fits], -1)
            chosen = np.cumsum(diff[:-1]) > 0
            if chosen.any():
                whole, room = _windows(words, counts, width, _ODD13)
                yield _keyed(*_least(whole[chosen], np.repeat(np.array(ids, np.int64), room)[chosen]), parts)

    known = _stored(docs.mapInArrow(windows, _SCHEMA), shared, "low", True)

    schema = pa.schema([
        (id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cut(batches):
        for batch in bounded(batches, "text", TOGETHER):
            rows = []
            ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            words, counts = hashed_words(texts)
            keys, own = _windows(words, counts, width, _ODD13)
            # a null id is smaller than all others: nothing is removed from it
            owners = np.repeat(np.array([LEAST if i is None else i for i in ids], np.int64), own)
            gone = shared.lookup(keys, "low", MOST, known) < owners
            for i, text, n, starts in zip(ids, texts, counts.tolist(), split_by(gone, own)):
                split = words_of(text)
                if starts.any():
                    removed = covered(np.flatnonzero(starts), width, n)
                    split = [x for x, r in zip(split, removed.tolist()) if not r]
                    edges = np.flatnonzero(np.diff(np.r_[False, removed, False])).reshape(-1, 2).tolist()
                else:
                    edges = []
                kept = b" ".join(split)
                rows.append((i, n, n - len(split), kept.decode("utf-8", "replace"), sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in edges]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(
        cut, f"{id_col} long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start: long, end: long>>"
    )
