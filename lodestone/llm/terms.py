"""Words of Arrow texts as numpy arrays: found by byte classes, numbered by a dictionary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into arrays at a time, and rows that it sums before sending.
SLICE, HELD_ROWS, SENT_ROWS = 6_000_000, 1_000_000, 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*, without: bytes) -> np.ndarray:
    """Flags of all bytes but those in ``without``."""
    flags = np.ones(256, bool)
    flags[list(without)] = False
    return flags


#: ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``: ASCII letters and every byte of other characters.
LETTERS = byte_class(without=bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Words:
    """Words of a string array, A-Z in lower case: bytes ``buffer[start:end]`` of text ``owner``."""

    def __init__(self, texts: pa.Array, kind: np.ndarray):
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        data = texts.buffers()[2]
        size = int(offsets[-1] - offsets[0])
        raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.empty(0, np.uint8)
        self.buffer = _LOWER[raw]
        self.bounds = (offsets - offsets[0]).astype(np.int64)
        self.inside = kind[self.buffer]
        first = self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        last = self.inside.copy()
        last[:-1] &= ~self.inside[1:]
        cut = self.bounds[(self.bounds > 0) & (self.bounds < size)]
        first[cut] = self.inside[cut]
        last[cut - 1] = self.inside[cut - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.owner = np.searchsorted(self.bounds, self.starts, "right") - 1

    def __len__(self) -> int:
        return len(self.starts)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number in the array of distinct words."""
        offsets = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        words = pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(self.buffer[self.inside]))
        found = words.dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary


def numbered(*columns: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """One number per row for equal rows, and the columns of the distinct rows in number order."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        found = column.dictionary_encode()
        code = code * max(1, len(found.dictionary)) + found.indices.to_numpy()
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    at = pa.array(first)
    return number.astype(np.int64), [c.take(at) for c in columns]


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each column summed per key."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], *(np.add.reduceat(c[order], at) for c in columns)


def combined(tables, keys: list[str], sums: list[str]):
    """Batches of the tables' rows, equal ``keys`` summed within runs of about ``HELD_ROWS`` rows."""
    held, size = [], 0

    def sent():
        whole = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(s, "sum") for s in sums])
        whole = whole.rename_columns([c.removesuffix("_sum") for c in whole.column_names]).select([*keys, *sums])
        return whole.to_batches(SENT_ROWS)

    for table in tables:
        held.append(table)
        size += table.num_rows
        if size >= HELD_ROWS:
            yield from sent()
            held, size = [], 0
    if held:
        yield from sent()
