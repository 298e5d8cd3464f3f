"""Interpolated modified Kneser-Ney word n-gram model, counted in Spark and memory-mapped.

Numbering: words are counted first and numbered by falling count, so that frequent words have
small numbers and an n-gram takes a few bytes in a shuffle; their 56-bit hashes move once.

Counting: every task turns its texts into numbers and sums equal n-grams, which are dealt to
segments by the last word of their context. So all n-grams of a context meet in one segment,
and so do most that end in the same n - 1 words. (A word that occurs more often than a segment
holds is split by the rest of its contexts.) A segment adds up its n-grams and writes two
tables of sorted keys to the shared folder: its n-grams' counts, and per context the sum of
the followers' counts and how many have counts 1, 2, 3 or more. Segments stand side by side on
shelves: a task works on a shelf's segments one by one and sends their sums on together, and
they share a set of files, so that files and lookups are few. (A task of the first count still
sends a message to each segment whenever it has held enough n-grams.) To the last n - 1 words of each
n-gram it sends one more different predecessor; those are added up by segments of the next
lower order, written likewise and sent further down, to the single words. Only the counts of
counts of each order, the sums after start marks, the words that are split and three totals
come to the driver. Scoring maps the arrays into memory and looks up the sorted keys of a few
texts at a time; no text is shuffled.

A model of all texts serves any text. Where the texts to score are known beforehand, as in
``score_documents``, n-grams with count 1 and contexts with one follower of count 1 aren't
stored, unless a held-out text asks for them: what a learned text has and no table holds has
that count, so that the scores stay the same.

    P_k(w | h) = max(a(h,w) - D_k(a(h,w)), 0) / a(h) + g(h) * P_(k-1)(w | h without its first word)
    P_1(w)     = max(a(w) - D_1(a(w)), 0) / A + g / (V + 1)

where a(.) is the count for the highest order and the number of different predecessors below
it, a(h) sums a(h,w) over w, A sums a(w), D_k are the modified discounts for counts 1, 2 and 3
or more, and g is the mass that the discounts free. After an unseen h, P_k = P_(k-1). A text
starts after order - 1 start marks and closes with an end token.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Grown, SortedMap, bounded, hashed_words, map_array, mixed, put_array, scratch, segment_of

#: Word hashes have 56 bits: two of 10**9 words then share one in fewer than 10 cases.
BITS = np.uint64((1 << 56) - 1)
START, END = np.uint64(1), np.uint64(2)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Rows with a count from here on stand apart, in 64 bits.
BIG = 255
#: Tokens times (order - 1) that one segment is planned for, tokens that are counted and that are
#: looked up together, and n-grams that a task holds before it sends them.
SEGMENT_TOKENS, COUNTED, TOGETHER, HELD = 3_000_000, 500_000, 400_000, 1_500_000
#: Shelves of segments; where they would hold more than so many segments each, there are more of them.
SHELVES, SEGMENTS = 64, 16


def tokens(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after another, which of them are tokens, and each text's number of tokens.

    Words have A-Z in lower case and stand between ASCII white space; each text is opened by
    order - 1 start marks, which aren't tokens, and closed by the end token.
    """
    words, counts = hashed_words(texts, lower=True)
    stop = np.cumsum(counts + order)
    x = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    token, inside = np.ones(len(x), bool), np.ones(len(x), bool)
    token[((stop - counts - order)[:, None] + np.arange(order - 1)).ravel()] = False
    inside[stop - 1] = False
    x[inside & token] = np.maximum(words & BITS, np.uint64(3))
    x[~token] = START
    x[stop - 1] = END
    return x, token, counts + 1


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams given by their words' columns, spread over 64 bits; each is made of its context's."""
    key = words[0]
    if len(words) == 1:
        return mixed(key)
    for w in words[1:]:
        key = mixed(key * _FACTOR + w)
    return key


def _turned(words: list[np.ndarray]) -> list[np.ndarray]:
    """Columns in the order of a segment's rows: the context from its last word to its first, then the word."""
    return [*words[-2::-1], words[-1]]


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns, the first one first; columns are joined as far as 64 bits hold them."""
    keys: list[np.ndarray] = []
    room = 0
    for c in columns:
        bits = int(c.max()).bit_length()
        if not bits:
            continue
        if bits <= room:
            keys[-1] = (keys[-1] << np.uint64(bits)) | c
        else:
            keys.append(c.astype(np.uint64))
            room = 64
        room -= bits
    if not keys:
        return np.arange(len(columns[0]))
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _sums(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``columns`` in order, the first column first, and each count summed per row."""
    if not len(columns[0]):
        return columns, counts
    order = _order(columns)
    columns = [c[order] for c in columns]
    at = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return [c[at] for c in columns], [np.add.reduceat(c[order], at) for c in counts]


def _packed(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Rows in the columns' order: columns as steps from the row before (where those before it are equal),
    each in the narrowest type, as byte planes, compressed."""
    same, out = np.ones(len(columns[0]), bool), []
    same[0] = False
    for c in columns:
        before = np.zeros_like(c)
        before[1:] = c[:-1]
        out.append(np.where(same, c - before, c))
        same &= c == before
    out = [c.astype(np.min_scalar_type(int(c.max()))) for c in (*out, *counts)]
    body = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in out)
    return np.array([len(out[0]), *(c.itemsize for c in out)], "<u4").tobytes() + pa.Codec("zstd", 3).compress(body, asbytes=True)


def _unpacked(blob: bytes, k: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ``k`` columns and ``width`` counts of one ``_packed``."""
    n, *each = np.frombuffer(blob, "<u4", 1 + k + width).tolist()
    body = pa.Codec("zstd").decompress(blob[4 * (1 + k + width) :], n * sum(each), asbytes=True)
    at, out = 0, []
    for size in each:
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(f"<u{size}").ravel())
        at += n * size
    same, columns = np.ones(n, bool), []
    same[0] = False
    for c in out[:k]:
        sums, first = np.cumsum(c, dtype=np.uint64), np.flatnonzero(~same)
        times = np.full(len(first), n)
        times[:-1] = first[1:]
        columns.append(sums - np.repeat(sums[first] - c[first], times - first))
        same[1:] &= columns[-1][1:] == columns[-1][:-1]
    return columns, [c.astype(np.int64) for c in out[k:]]


def _merged(blobs: list[bytes], k: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over several ``_packed``, a few at a time: memory follows the distinct rows."""
    held = [([np.empty(0, np.uint64)] * k, [np.empty(0, np.int64)] * width)]
    size = 0

    def summed():
        columns, counts = zip(*held)
        return _sums([np.concatenate(c) for c in zip(*columns)], [np.concatenate(c) for c in zip(*counts)])

    for blob in filter(None, blobs):
        held.append(_unpacked(blob, k, width))
        size += len(held[-1][0][0])
        if size > max(HELD, len(held[0][0][0])):
            held[:] = [summed()]
            size = 0
    return summed()


def _dealt(part: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(segment, packed sums) for each segment of the rows."""
    (part, *columns), counts = _sums([part.astype(np.uint64), *columns], counts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [
        (int(part[lo]), _packed([x[lo:hi] for x in columns], [x[lo:hi] for x in counts]))
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(part)])
        if hi > lo
    ]


_SCHEMA = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("note", pa.string())])
_DDL = "part int, blob binary, note string"


def _rows(rows: list[tuple[int, bytes]], note: str | None = None) -> pa.RecordBatch:
    notes = pa.array([note] + [None] * (len(rows) - 1), pa.string()) if rows else pa.nulls(0, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary()), notes], schema=_SCHEMA)


class Shelf:
    """A shelf of ``Values``, or of ``Keyed``, while its segments are written, the lowest first."""

    def __init__(self, table: Values, shelf: int, keyed: bool = False):
        self.per, self.at = table.per, []
        names = ("small", "large", "high", "low", "index") if keyed else ("small", "large")
        self.files = {n: Grown(table.uri, f"{shelf:07d}.{n}") for n in (*names, "at")}

    def _upto(self, own: int) -> None:
        """Where the segments up to ``own``, counted within the shelf, begin; those not written are empty."""
        while len(self.at) <= own:
            self.at.append((self.files["small"].size, self.files["index"].size if "index" in self.files else 0, 0))

    def add(self, own: int, counts: list[np.ndarray], keys: np.ndarray | None = None) -> None:
        self._upto(own)
        if keys is not None:
            order = np.argsort(keys)
            keys, counts = keys[order], [c[order] for c in counts]
            start, at, bits = self.files["small"].size, self.files["index"].size, (len(keys) // 3).bit_length()
            self.at[own] = start, at, bits
            self.files["high"].add((keys >> np.uint64(32)).astype("<u4"))
            self.files["low"].add((keys >> np.uint64(16)).astype("<u2"))
            each = np.bincount(_bucket(keys, np.uint64(bits)), minlength=1 << bits)
            self.files["index"].add((start + np.r_[0, np.cumsum(each)]).astype("<u4"))
        rows = np.stack(counts, 1).astype(np.int64)
        big = np.flatnonzero((rows >= BIG).any(1))
        self.files["large"].add(np.column_stack([big + self.files["small"].size, rows[big]]).astype("<i8"))
        self.files["small"].add(np.minimum(rows, BIG).astype(np.uint8))

    def close(self) -> None:
        self._upto(self.per)
        self.files["at"].add(np.array(self.at, "<i8"))
        for file in self.files.values():
            file.close()


def _bucket(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(1)) >> (np.uint64(63) - bits)).astype(np.int64)


class Values:
    """Rows of counts by segment and place: a byte each; rows with larger ones again in full.

    ``per`` segments, one after another, are a shelf, in one set of files: a reader opens few of
    them and looks up all that it asks of a shelf at once, however many segments there are.
    """

    def __init__(self, uri: str, parts: int, width: int, per: int = 1):
        self.uri, self.parts, self.width, self.per = uri, parts, width, per

    def seal(self, present: list[int]) -> None:
        """State which shelves exist; on the driver, when all of them are written."""
        there = np.zeros(-(-self.parts // self.per), np.uint8)
        there[present] = 1
        put_array(self.uri, "sealed", there)

    def there(self, shelf: int) -> bool:
        return bool(map_array(self.uri, "sealed", "|u1")[shelf])

    def at(self, shelf: int) -> np.ndarray:
        """Per segment of the shelf and for its end: rows and index entries before it, bits of its index."""
        return map_array(self.uri, f"{shelf:07d}.at", "<i8").reshape(-1, 3)

    def rows(self, shelf: int, at: np.ndarray) -> np.ndarray:
        """The counts of rows of a shelf."""
        out = map_array(self.uri, f"{shelf:07d}.small", "|u1").reshape(-1, self.width)[at].astype(np.int64)
        big = np.flatnonzero((out >= BIG).any(1))
        if len(big):
            large = map_array(self.uri, f"{shelf:07d}.large", "<i8").reshape(-1, self.width + 1)
            out[big] = large[np.searchsorted(large[:, 0], at[big]), 1:]
        return out

    def get(self, parts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A row of counts for each segment and place, zeros beyond the segment's last; segments are in order."""
        out = np.zeros((len(parts), self.width), np.int64)
        for shelf, own in _by_shelf(parts, self.per):
            if self.there(shelf):
                at, local = self.at(shelf)[:, 0], parts[own] - shelf * self.per
                row = at[local] + place[own]
                inside = np.flatnonzero(row < at[local + 1])
                out[own][inside] = self.rows(shelf, row[inside])
        return out


def _by_shelf(segments: np.ndarray, per: int):
    """(shelf, slice) for segments in order."""
    shelf = segments // per
    cuts = np.flatnonzero(np.diff(shelf)) + 1
    for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(shelf)].tolist()):
        if hi > lo:
            yield int(shelf[lo]), slice(lo, hi)


class Keyed:
    """Rows of counts by key in segments, which the caller names. Keys have 48 bits within a segment.

    A segment's keys are in order; an index tells where those with the same upper bits begin, three of them
    at most on average.
    """

    def __init__(self, uri: str, parts: int, width: int, per: int = 1):
        self.uri, self.parts, self.values = uri, parts, Values(uri, parts, width, per)

    def shelf(self, shelf: int) -> Shelf:
        return Shelf(self.values, shelf, keyed=True)

    def put(self, part: int, keys: np.ndarray, counts: list[np.ndarray]) -> None:
        """A shelf of one segment."""
        shelf = self.shelf(part)
        shelf.add(0, counts, keys)
        shelf.close()

    def seal(self, present: list[int]) -> None:
        self.values.seal(present)

    def find(self, parts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in its segment, and its row of counts (zeros where absent)."""
        hit, out = np.zeros(len(keys), bool), np.zeros((len(keys), self.values.width), np.int64)
        if not len(keys):
            return hit, out
        order = _order([parts.astype(np.uint64), keys >> np.uint64(16)])
        segment, key = parts[order], keys[order] >> np.uint64(16)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])])  # equal ones are asked once
        times = np.diff(np.r_[first, len(order)])
        segment, key = segment[first], key[first]
        found, rows = np.zeros(len(key), bool), np.zeros((len(key), self.values.width), np.int64)
        for shelf, own in _by_shelf(segment, self.values.per):
            if self.values.there(shelf):
                at = self._places(shelf, segment[own] - shelf * self.values.per, key[own])
                there = np.flatnonzero(at >= 0)
                found[own][there] = True
                rows[own][there] = self.values.rows(shelf, at[there])
        hit[order], out[order] = np.repeat(found, times), np.repeat(rows, times, axis=0)
        return hit, out

    def _places(self, shelf: int, own: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The row of each key of 48 bits in the shelf, -1 where absent; ``own`` is its segment within the shelf."""
        high, low, index = (map_array(self.uri, f"{shelf:07d}.{n}", t) for n, t in (("high", "<u4"), ("low", "<u2"), ("index", "<u4")))
        out = np.full(len(key), -1)
        if not len(high):
            return out
        at = self.values.at(shelf)
        bits, entry = at[own, 2].astype(np.uint64), at[own, 1]
        entry = np.where(at[own + 1, 1] > entry, entry + _bucket(key << np.uint64(16), bits), -1)  # some segments aren't written
        here, end = index[entry].astype(np.int64), index[entry + 1].astype(np.int64)
        h, l = (key >> np.uint64(16)).astype("<u4"), key.astype("<u2")
        left = np.flatnonzero((here < end) & (entry >= 0))
        here, end, h, l = here[left], end[left], h[left], l[left]
        while len(left):
            ok = (high[here] == h) & (low[here] == l)
            out[left[ok]] = here[ok]
            here += 1
            more = np.flatnonzero(~ok & (here < end))
            left, here, end, h, l = left[more], here[more], end[more], h[more], l[more]
        return out


class KneserNey:
    """A counted model: its folder, its number of segments, its order, and its totals and discounts.

    A word's number is its rank in its segment, from 2 on, times the number of segments, plus its
    segment; the start mark is 0, a word that isn't known has rank 1 in segment 0. ``split`` are the
    frequent words' numbers, in order, and in how many their n-grams are dealt. ``lean``: see ``train``.
    """

    def __init__(self, uri: str, parts: int, order: int, lean: bool = False):
        shelves = min(parts, max(SHELVES, ceil(parts / SEGMENTS)))
        self.per = ceil(parts / shelves)
        parts = shelves * self.per  # so that a shelf has a range of words' keys, as a segment has
        self.uri, self.parts, self.order, self.lean, self.totals = uri, parts, order, lean, {}
        self.split = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.words, self.raw = SortedMap(f"{uri}/words", shelves, {"rank": "<u4"}), Values(f"{uri}/raw", parts, 1, self.per)
        #: different predecessors, and of the followers the sum of their counts and the numbers of those with counts 1, 2, 3 or more
        self.single = Values(f"{uri}/1", parts, 5, self.per)

    def counts(self, k: int) -> Keyed:
        """Counts of the n-grams of ``k`` words: occurrences in the highest order, else different predecessors."""
        return Keyed(f"{self.uri}/{k}", self.parts, 1, self.per)

    def contexts(self, k: int) -> Keyed:
        """Of the followers of ``k`` words, 2 or more: the sum of their counts and the numbers of those with counts 1, 2, 3 or more."""
        return Keyed(f"{self.uri}/{k}-contexts", self.parts, 4, self.per)

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """The number of each word hash."""
        keys, at = np.unique(mixed(x), return_inverse=True)
        hit, got = self.words.find(keys)
        n = np.where(hit, got["rank"].astype(np.uint64) * np.uint64(self.parts) + segment_of(keys, self.parts).astype(np.uint64), np.uint64(self.parts))
        n[keys == mixed(np.array([START]))[0]] = 0
        return n[at]

    def segments(self, words: list[np.ndarray]) -> np.ndarray:
        """The segment of each n-gram, the same for all of a context of two or more words, unless these are start marks."""
        v, rest = words[-2], words[:-2] or words[-1:]
        frequent, times = self.split
        sub = np.zeros(len(v), np.uint64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)
            own = np.flatnonzero(frequent[at] == v)
            sub[own] = np.where(v[own] == 0, mixed(words[-1][own]), _keys([x[own] for x in rest])) % times[at[own]]
        return segment_of(mixed(v * _FACTOR + sub), self.parts)

    def _by_word(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw count and the row of ``single`` for each word."""
        part, rank = (numbers % np.uint64(self.parts)).astype(np.int64), (numbers // np.uint64(self.parts)).astype(np.int64)
        order = _order([part.astype(np.uint64), rank.astype(np.uint64)]) if len(part) else np.empty(0, np.int64)
        raw, rows = np.empty(len(part), np.int64), np.empty((len(part), 5), np.int64)
        raw[order], rows[order] = self.raw.get(part[order], rank[order])[:, 0], self.single.get(part[order], rank[order])
        return raw, rows

    def log_probs(self, x: np.ndarray, token: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each token after its context, and its raw count in training; ``learned`` is asked of a lean model only."""
        t, at = self.totals, np.flatnonzero(token)
        distinct, back = np.unique(x, return_inverse=True)
        distinct, known = self.numbers(distinct), learned[at] & self.lean
        raw, single = self._by_word(distinct)
        numbers, word = distinct[back], back[at]
        a = single[:, 0]
        p = (np.maximum(a - np.array([0, *t["discounts"][0]])[np.minimum(a, 3)], 0) / max(t["A"], 1) + t["mass"] / (t["V"] + 1))[word]
        # of a word as the context
        safe, rest = (c[back[at - 1]] for c in _shares(single[:, 1:], t["discounts"][1]))
        for k in range(2, self.order + 1):
            words = [numbers[at - j] for j in range(k - 1, -1, -1)]
            part = self.segments(words)
            hit, got = self.counts(k).find(part, _keys(words))
            a = np.where(~hit & known, 1, got[:, 0])
            if k > 2:
                hit, follow = self.contexts(k - 1).find(part, _keys(words[:-1]))
                follow[~hit & known] = 1, 1, 0, 0
                follow[words[-2] == 0] = t["starts"][k - 1]
                safe, rest = _shares(follow, t["discounts"][k - 1])
            d = np.array([0, *t["discounts"][k - 1]])
            p = np.maximum(a - d[np.minimum(a, 3)], 0) / safe + rest * p
        return np.log10(p), raw[word]


def _shares(follow: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts' followers, the sum of their counts (1 at least) and the share that the discounts free; 1 without followers."""
    total, *n = follow.T
    safe = np.maximum(total, 1)
    return safe, np.where(total > 0, (n[0] * d[0] + n[1] * d[1] + n[2] * d[2]) / safe, 1.0)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with counts 1 to 4.

    Where a number is 0, so that the estimate isn't defined, 0.5 * count is taken; results are
    kept within (0, count).
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y and n[k] and n[k - 1] else 0.5 * k
        out.append(min(max(d, 0.01), k - 0.01))
    return out


def _note(notes: list[str], k: int, shelf: int, sums: Iterable[int]) -> str:
    """What the driver gets to know, by order: shelves written, and sums over them."""
    out: dict[str, dict] = {str(k): {"own": [shelf], "sums": [int(x) for x in sums]}}
    for note in map(json.loads, notes):
        for order, add in note.items():
            held = out.setdefault(order, {"own": [], "sums": [0] * len(add["sums"])})
            held["own"] += add["own"]
            held["sums"] = [a + b for a, b in zip(held["sums"], add["sums"])]
    return json.dumps(out)


def _number_words(texts: DataFrame, model: KneserNey, starts: int, most: int) -> None:
    """Count the words of learned rows and store their numbers; words with more than ``most`` tokens, and the
    start mark of more than so many texts, are to be split."""
    parts = model.parts

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent():
            keys, n = map(np.concatenate, zip(*held))
            return _rows(_dealt(segment_of(keys, parts), [keys], [n]))

        for batch in bounded(batches, "text", 6 * COUNTED):
            x, token, _ = tokens(batch["text"].to_pylist(), 1)
            keys, n = np.unique(mixed(x[token]), return_counts=True)
            held.append((keys, n.astype(np.int64)))
            size += len(keys)
            if size > HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    def number(table: pa.Table) -> pa.Table:
        shelf, note = table["part"][0].as_py() // model.per, {"N": 0, "V": 0, "split": []}
        stored, counts = {n: Grown(model.words.uri, f"{shelf:07d}.{n}") for n in ("key", "rank")}, Shelf(model.raw, shelf)
        for part, blobs in _segments(table):
            (keys,), (n,) = _merged(blobs, 1, 1)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(2, len(n) + 2)
            stored["key"].add(keys.astype("<u8"))
            stored["rank"].add(rank.astype("<u4"))
            counts.add(part - shelf * model.per, [np.r_[0, 0, n[order]]])
            often = np.flatnonzero(n > most)
            note["N"] += int(n.sum())
            note["V"] += len(n)
            note["split"] += [(int(r) * parts + part, 1 + int(c) // most) for r, c in zip(rank[often], n[often])]
        for file in (*stored.values(), counts):
            file.close()
        return pa.Table.from_batches([_rows([(shelf, b"")], json.dumps(note))])

    made = _shelved(texts.filter("learned").select("text").mapInArrow(count, _DDL), model.per).applyInArrow(number, _DDL)
    found = [(row.part, json.loads(row.note)) for row in made.select("part", "note").collect()]  # a row per shelf
    for table in (model.words, model.raw):
        table.seal([shelf for shelf, _ in found])
    split = [(0, 1 + starts // most)] * (starts > most) + sorted(tuple(x) for _, note in found for x in note["split"])
    model.split = tuple(np.array(split, np.uint64).reshape(-1, 2).T.copy())
    model.totals = {"N": sum(note["N"] for _, note in found), "V": sum(note["V"] for _, note in found)}


def _shelved(sent: DataFrame, per: int):
    return sent.groupBy(F.floor(F.col("part") / per))


def _segments(table: pa.Table):
    """(segment, blobs) of a shelf, the lowest first."""
    parts, blobs = table["part"].to_numpy(), table["blob"]
    order = np.argsort(parts, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
        yield int(parts[own[0]]), blobs.take(pa.array(own)).to_pylist()


def train(texts: DataFrame, text_col: str = "text", order: int = 3, learned: Column | None = None) -> KneserNey:
    """Count the model of ``order`` (2 or more) over every row of ``texts``; null text is an empty one.

    With ``learned`` the model is lean: it learns from the rows where that holds, and scores these
    rows and the others of ``texts``, no further texts.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark, lean = texts.sparkSession, learned is not None
    texts = texts.select(F.col(text_col).cast("string").alias("text"), F.coalesce(learned if lean else F.lit(True), F.lit(False)).alias("learned"))
    # a token of prose takes about six bytes
    size, rows = texts.agg(F.sum(F.octet_length("text") + 1), F.count("*")).first()
    parts = max(1, ceil((size or 0) / 6 * (order - 1) / SEGMENT_TOKENS))
    model = KneserNey(scratch(spark, "kneser-ney"), parts, order, lean)
    _number_words(texts, model, rows, max(1, SEGMENT_TOKENS // (2 * order - 2)))

    def count(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def sent():
            columns = [np.concatenate(c) for c in zip(*held)]
            words = columns[:order]
            return _rows(_dealt(model.segments(words), _turned(words), columns[order:]))

        for batch in bounded(batches, "text", 6 * COUNTED):
            x, token, counts = tokens(batch["text"].to_pylist(), order)
            last, numbers = np.flatnonzero(token), model.numbers(x)
            own = np.repeat(batch["learned"].to_numpy(zero_copy_only=False), counts)
            held.append([*(numbers[last - k] for k in range(order - 1, -1, -1)), own.astype(np.int64), (~own).astype(np.int64)])
            size += len(last)
            if size > HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    def segment(k: int):
        """Add up a shelf's segments of the n-grams of ``k`` words, store them, send their sums to those of ``k`` - 1."""

        def add(table: pa.Table) -> pa.Table:
            shelf = table["part"][0].as_py() // model.per
            stored, contexts = model.counts(k).shelf(shelf), model.contexts(k - 1).shelf(shelf) if k > 2 else None
            sums, rows, held = np.zeros(10 if k > 2 else 6, np.int64), [], []

            def sent():
                part, *columns = (np.concatenate(c) for c in zip(*(c for c, _ in held)))
                rows.extend(_dealt(part, columns, [np.concatenate(c) for c in zip(*(n for _, n in held))]))
                held.clear()

            for part, blobs in _segments(table):
                columns, (a, asked) = _merged(blobs, k, 2)
                words = _turned(columns)
                kept = np.flatnonzero((a > 1) | (a > 0) & (asked > 0) if lean else a > 0)
                stored.add(part - shelf * model.per, [a[kept]], _keys([x[kept] for x in words]))
                sums[:6] += [*((a == j).sum() for j in (1, 2, 3, 4)), (a >= 3).sum(), a.sum()]
                # columns are ordered by context
                first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)]) if len(a) else np.empty(0, np.int64)
                context = [x[first] for x in words[:-1]]
                follow = [np.add.reduceat(c.astype(np.int64), first) if len(a) else a for c in (a, a == 1, a == 2, a >= 3, asked)]
                if k > 2:
                    total, wanted = follow[0], follow.pop()
                    # start marks alone are one context, which may lie in several segments: its sums go to the driver
                    start = context[-1] == 0
                    sums[6:] += [c[start].sum() for c in follow]
                    kept = np.flatnonzero(~start & ((total > 1) | (total > 0) & (wanted > 0) if lean else total > 0))
                    contexts.add(part - shelf * model.per, [c[kept] for c in follow], _keys([x[kept] for x in context]))
                    held.append(([model.segments(words[1:]), *_turned(words[1:])], [(a > 0).astype(np.int64), (asked > 0).astype(np.int64)]))
                else:
                    ends, none = np.concatenate([words[1], context[0]]), np.zeros(len(a), np.int64)
                    counts = [np.r_[(a > 0).astype(np.int64), np.zeros(len(first), np.int64)], *(np.r_[none, c] for c in follow[:4])]
                    some = np.flatnonzero(np.any([c > 0 for c in counts], axis=0))
                    ends, each = ends[some], np.uint64(model.parts)
                    held.append(([ends % each, ends // each], [c[some] for c in counts]))
                if sum(len(c[0]) for c, _ in held) > HELD // 2:
                    sent()
            if held:
                sent()
            for shelves in filter(None, (stored, contexts)):
                shelves.close()
            return pa.Table.from_batches([_rows(rows or [(shelf * model.per, b"")], _note(table["note"].drop_null().to_pylist(), k, shelf, sums))])

        return add

    def single(table: pa.Table) -> pa.Table:
        shelf = table["part"][0].as_py() // model.per
        stored, sums = Shelf(model.single, shelf), np.zeros(6, np.int64)
        for part, blobs in _segments(table):
            (rank,), counts = _merged(blobs, 1, 5)
            dense = np.zeros((5, int(rank[-1]) + 1 if len(rank) else 0), np.int64)
            dense[:, rank.astype(np.int64)] = counts
            stored.add(part - shelf * model.per, list(dense))
            a = counts[0]
            sums += [*((a == j).sum() for j in (1, 2, 3, 4)), (a >= 3).sum(), a.sum()]
        stored.close()
        return pa.Table.from_batches([_rows([(shelf * model.per, b"")], _note(table["note"].drop_null().to_pylist(), 1, shelf, sums))])

    made = texts.mapInArrow(count, _DDL)
    for k in range(order, 1, -1):
        made = _shelved(made, model.per).applyInArrow(segment(k), _DDL)
    made = _shelved(made, model.per).applyInArrow(single, _DDL)
    found: dict[str, dict] = {}
    for row in made.select("note").collect():  # a row per shelf
        for k, add in json.loads(row.note).items():
            held = found.setdefault(k, {"own": [], "sums": [0] * len(add["sums"])})
            held["own"] += add["own"]
            held["sums"] = [a + b for a, b in zip(held["sums"], add["sums"])]
    for k in range(1, order + 1):
        own = found.get(str(k), {"own": []})["own"]
        for table in (model.single,) if k == 1 else (model.counts(k), model.contexts(k - 1)) if k > 2 else (model.counts(k),):
            table.seal(own)
    sums = [found.get(str(k), {"sums": [0] * 10})["sums"] for k in range(1, order + 1)]
    of_order = [discounts(x[:4]) for x in sums]
    n1, n2, _, _, more, a = sums[0][:6]
    low = of_order[0]
    model.totals |= {"A": a, "discounts": of_order, "starts": [x[6:] for x in sums], "mass": (low[0] * n1 + low[1] * n2 + low[2] * more) / a if a else 1.0}
    return model


def save_totals(model: KneserNey) -> str:
    """Write the totals beside the arrays; returns their JSON."""
    text = json.dumps({"parts": model.parts, "order": model.order, **model.totals})
    put_array(model.uri, "totals.json", np.frombuffer(text.encode(), np.uint8))
    return text


def score(texts: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", learned: Column | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score and score (log10 probabilities of the text).

    base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens. perplexity is
    10 ** (-score / n_tokens). Null text is empty: its only token is the end. Repeated rows
    are scored each; other columns are not returned. A lean model takes the rows and the
    ``learned`` that it was trained with.
    """
    if model.lean != (learned is not None):
        raise ValueError("a lean model, and no other, is to be told which rows it learned from")
    t = model.totals
    lower = np.log10(t["N"] + 0.1 * (t["V"] + 1))

    def scored(batches):
        for batch in bounded(batches, "text", 6 * TOGETHER):
            x, token, counts = tokens(batch["text"].to_pylist(), model.order)
            first = np.cumsum(counts) - counts
            own = np.repeat(batch["learned"].to_numpy(zero_copy_only=False), counts + model.order - 1)
            logs, raw = model.log_probs(x, token, own)
            base = np.log10(raw + 0.1) - lower
            total, simple, known = (np.add.reduceat(x, first) for x in (logs, base, (raw > 0).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(counts.astype(np.int64)), pa.array(known), pa.array(simple), pa.array(total)],
                names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    own = F.coalesce(learned if learned is not None else F.lit(False), F.lit(False))
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), own.alias("learned")).mapInArrow(
        scored, f"{id_col} long, n_tokens long, n_known long, base_score double, score double"
    )


def held_out(id_col: str, folds: int) -> Column:
    """crc32(id as text) mod folds = 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 3) -> DataFrame:
    """Train a model of ``order`` on the rows outside the held-out fold, score every row.

    Adds held_out, train_tokens and perplexity. An empty table gives an empty result; where no
    row is left for training, every word is unknown and has probability 1 / (V + 1) = 1.
    """
    learned = ~held_out(id_col, folds)
    model = train(documents, text_col, order, learned)
    save_totals(model)
    out = score(documents, model, id_col, text_col, learned)
    return out.withColumn("held_out", held_out(id_col, folds)).withColumn("train_tokens", F.lit(model.totals["N"]).cast("long")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )
