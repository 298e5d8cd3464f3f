"""Shared-folder tables, size-checked broadcasts and memory-mapped sorted arrays.

Every intermediate that is read more than once is written below the folder named by
``spark.checkpoint.dir`` so that it survives lost executors. Tasks write array segments
under a temporary name and rename them, so a task that runs twice leaves one copy. A table
of segments is sealed with the list of those that exist; a reader that misses one of them,
or the list itself, raises instead of taking it for empty.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def base_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is configured, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder, removed when this Python process ends."""
    uri = f"{base_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(uri)
    return uri


@atexit.register
def _remove() -> None:
    for uri in _made:
        if local_path(uri):
            shutil.rmtree(local_path(uri), ignore_errors=True)
            continue
        with contextlib.suppress(Exception):  # the store may be gone before this process ends
            store, at = _store(uri)
            store.delete_dir(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    uri = scratch(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; stops counting just beyond."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it, else unchanged (shuffle join)."""
    return F.broadcast(df) if at_most(df, rows) else df


def local_path(uri: str) -> str | None:
    """The mounted path of a URI, or None if only a Hadoop file system reads it."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_array(uri: str, name: str, values: np.ndarray) -> None:
    """Write one array segment atomically; repeating the write is harmless."""
    path = local_path(uri)
    if path:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        np.ascontiguousarray(values).tofile(part)
        os.replace(part, f"{path}/{name}")
        return
    store, at = _store(uri)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(part, f"{at}/{name}")


class Grown:
    """An array segment written piece by piece, under a temporary name until it is closed."""

    def __init__(self, uri: str, name: str):
        self.path, self.size = local_path(uri), 0
        at = self.path
        if self.path:
            os.makedirs(at, exist_ok=True)
        else:
            self.store, at = _store(uri)
            self.store.create_dir(at, recursive=True)
        self.part, self.final = f"{at}/.{name}.{uuid.uuid4().hex}", f"{at}/{name}"
        self.out = open(self.part, "wb") if self.path else self.store.open_output_stream(self.part)

    def add(self, values: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(values).tobytes())
        self.size += len(values)

    def close(self) -> None:
        self.out.close()
        if self.path:
            os.replace(self.part, self.final)
        else:
            self.store.move(self.part, self.final)


_mapped: dict[tuple[str, str], np.ndarray] = {}


def map_array(uri: str, name: str, dtype) -> np.ndarray:
    """Memory-map a segment; an absent one is an error. Remote segments are fetched once per worker."""
    key = (uri, name)
    if key not in _mapped:
        if len(_mapped) > 8192:
            _mapped.clear()
        path = local_path(uri)
        file = f"{path}/{name}" if path else _fetched(uri, name)
        if file is None or not os.path.exists(file):
            raise FileNotFoundError(f"no segment {name} in {uri}: is spark.checkpoint.dir shared by all machines?")
        _mapped[key] = np.memmap(file, dtype, "r").view(np.ndarray) if os.path.getsize(file) else np.empty(0, dtype)
    return _mapped[key]


def _fetched(uri: str, name: str) -> str | None:
    from pyarrow import fs

    store, at = _store(uri)
    if store.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
        return None
    folder = tempfile.mkdtemp(prefix="segment-")
    atexit.register(shutil.rmtree, folder, True)
    with store.open_input_stream(f"{at}/{name}") as src, open(f"{folder}/{name}", "wb") as out:
        shutil.copyfileobj(src, out, 1 << 22)
    return f"{folder}/{name}"


def segment_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range segment of each unsigned 64-bit key: equal slices of the key space, in key order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class SortedMap:
    """Sorted unsigned 64-bit keys with one value column each, in ``parts`` range segments of files.

    ``put`` writes a segment, ``seal`` the list of the segments that have keys; both are needed
    before a lookup.
    """

    def __init__(self, uri: str, parts: int, columns: dict[str, str]):
        self.uri, self.parts, self.columns = uri, parts, columns

    def seal(self, present: Iterable[int]) -> None:
        """State which segments exist; on the driver, when all of them are written."""
        there = np.zeros(self.parts, np.uint8)
        there[list(present)] = 1
        put_array(self.uri, "sealed", there)

    def _keys(self, part: int) -> np.ndarray:
        if not map_array(self.uri, "sealed", "|u1")[part]:
            return np.empty(0, "<u8")
        return map_array(self.uri, f"{part:07d}.key", "<u8")

    def put(self, part: int, keys: np.ndarray, **values: np.ndarray) -> None:
        put_array(self.uri, f"{part:07d}.key", keys.astype("<u8"))
        for name, dtype in self.columns.items():
            put_array(self.uri, f"{part:07d}.{name}", values[name].astype(dtype))

    #: Tables of at most so many keys are looked up through a bitmap of 2**27 bits (16 MB) first.
    FILTERED = 1 << 24

    def lookup(self, keys: np.ndarray, column: str, absent: int, total: int | None = None) -> np.ndarray:
        """One column's values for keys in any order; ``total`` is the table's size, if known."""
        out = np.full(len(keys), absent, np.dtype(self.columns[column]))
        some = None
        if total is not None and total <= self.FILTERED:
            bits = self._bitmap()
            at = (keys >> np.uint64(37)).astype(np.int64)
            some = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            keys = keys[some]
        order = np.argsort(keys)
        hit, got = self.find(keys[order])
        place = order if some is None else some[order]
        out[place[hit]] = got[column][hit]
        return out

    def _bitmap(self) -> np.ndarray:
        key = (self.uri, "bitmap")
        if key not in _mapped:
            bits = np.zeros(1 << 24, np.uint8)
            for part in range(self.parts):
                at = (np.asarray(self._keys(part)) >> np.uint64(37)).astype(np.int64)
                if len(at):
                    first = int(at[0]) & ~7
                    own = np.zeros((int(at[-1]) | 7) + 1 - first, bool)
                    own[at - first] = True
                    bits[first >> 3 : (first + len(own)) >> 3] |= np.packbits(own, bitorder="little")
            _mapped[key] = bits
        return _mapped[key]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For sorted ``keys``: whether each is present, and its values (0 where absent)."""
        hit = np.zeros(len(keys), bool)
        out = {n: np.zeros(len(keys), np.dtype(d)) for n, d in self.columns.items()}
        if not len(keys):
            return hit, out
        at = segment_of(keys, self.parts)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            part = int(at[lo])
            known = self._keys(part)
            if not len(known):
                continue
            pos = np.searchsorted(known, keys[lo:hi])
            pos[pos == len(known)] = 0
            ok = known[pos] == keys[lo:hi]
            hit[lo:hi] = ok
            for name, dtype in self.columns.items():
                got = map_array(self.uri, f"{part:07d}.{name}", dtype)[pos]
                out[name][lo:hi] = np.where(ok, got, 0)
        return hit, out


def part_of(key: Column, parts: int) -> Column:
    """``segment_of`` as a column of signed keys."""
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(parts).cast("long"), 32).cast("int")


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads 64-bit values over the key space."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


#: Bytes of the longest word that the polynomial hashes.
LONG = 40
_CHUNK = 1 << 20
_tables: list[np.ndarray] = []


def _hash_tables() -> list[np.ndarray]:
    """A number for each byte, white-space flags, and powers of an odd base and of its inverse."""
    if not _tables:
        size = _CHUNK + 1
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        powers = []
        for b in (base, inverse):
            each = np.full(size + 1, b, np.uint64)
            each[0] = 1
            powers.append(np.multiply.accumulate(each))
        _tables[:] = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)), space, *powers]
    return _tables


def hashed_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words between ASCII white space, and each text's number of words.

    Words of up to ``LONG`` bytes: polynomial in the bytes' numbers, from running sums, so that
    none becomes an object. Modulo 2**64 that is sound for short words only (some words of 1024
    bytes would share one whatever the numbers are), so longer words, of which there are few,
    take BLAKE2b. ``lower`` takes A-Z in lower case.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raw) + b" "
    if lower:
        joined = joined.lower()
    buffer = np.frombuffer(joined, np.uint8)
    numbers, spaces, powers, inverses = _hash_tables()
    space = spaces[buffer]
    flips = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = flips[0::2], flips[1::2]
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # some words at a time, so that the powers stay few
        origin = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, origin + _CHUNK, "right")))
        size = int(ends[hi - 1] - origin)
        if size > _CHUNK:  # one long word
            lo = hi
            continue
        sums = numbers[buffer[origin : origin + size]]
        sums *= powers[:size]
        np.cumsum(sums, out=sums)
        s, e = starts[lo:hi] - origin, ends[lo:hi] - origin
        value = sums[e - 1]
        value[1:] -= sums[s[1:] - 1]
        out[lo:hi] = mixed(value * inverses[s] + (e - s).astype(np.uint64))
        lo = hi
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return out, np.diff(np.searchsorted(starts, bounds), prepend=0)


def split_by(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def rolling(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= np.uint64(factor)
        out += hashes[i : i + n]
    return mixed(out)


def tidy() -> None:
    """Give freed memory back to the system: workers are kept, and idle ones count, too."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def bounded(batches, text_col: str = "text", limit: int = 2_000_000):
    """Slices of Arrow batches with about ``limit`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text_col]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch
    tidy()
