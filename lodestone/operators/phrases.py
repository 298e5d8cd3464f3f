"""Very many phrases found in texts at once.

Phrases are sequences of tokens: runs of word characters, or single other characters. They
are compiled into tries whose nodes are numbers, stored as sorted arrays (token, and
(node, token) -> node) in the shared folder; workers map them. A scan turns a slice of texts into
token numbers and walks the tries from every position at once, one numpy step per token of the
longest phrase. The plan doesn't depend on the number of phrases, nor the time on more than
its logarithm. Any number of phrases is dealt over tries of a bounded size, built by tasks.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_folder, mapped, put_array

#: Phrases that a trie is planned for, and characters of texts that are scanned together.
TRIE_PHRASES, TOGETHER = 500_000, 1_000_000
_TOKEN = {"exact": re.compile(r"\w+|\W"), "any": re.compile(r"\w+|\s+|\W")}

_WORD = re.compile(r"\w").match


def token_list(text: str, spaces: str) -> list[str]:
    """Tokens of a lower-cased text; with ``spaces`` = ``any`` a run of white space is one blank."""
    found = _TOKEN[spaces].findall(text)
    return [" " if t.isspace() else t for t in found] if spaces == "any" else found


class _Strings:
    """Sorted distinct strings, as their bytes and ends."""

    @staticmethod
    def put(uri: str, name: str, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        put_array(uri, f"{name}.bytes", np.frombuffer(b"".join(raw), np.uint8))
        put_array(uri, f"{name}.ends", np.cumsum([0, *map(len, raw)]).astype("<i4"))

    @staticmethod
    def get(uri: str, name: str) -> pa.Array:
        ends = mapped(uri, f"{name}.ends", "<i4")
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(mapped(uri, f"{name}.bytes", np.uint8)))


def _trie(uri: str, part: int, phrases: list[tuple[int, list[str]]]) -> None:
    """Write the trie of token lists with their phrases' numbers; several phrases may share a list."""
    words = sorted({t for _, tokens in phrases for t in tokens})
    number = {w: k for k, w in enumerate(words)}
    lists = sorted((tuple(map(number.__getitem__, tokens)), k) for k, tokens in phrases)
    edges: dict[tuple[int, int], int] = {}
    accepted: list[tuple[int, int]] = []
    for tokens, k in lists:
        node = 0
        for t in tokens:
            node = edges.setdefault((node, t), len(edges) + 1)
        accepted.append((node, k))
    keys = np.array([a * len(words) + t for a, t in edges], np.int64)
    order = np.argsort(keys)
    accepted.sort()
    nodes = np.array([a for a, _ in accepted], np.int64)
    name = f"{part:06d}"
    _Strings.put(uri, name, words)
    put_array(uri, f"{name}.keys", keys[order].astype("<i8"))
    put_array(uri, f"{name}.next", np.fromiter(edges.values(), np.int64, len(edges))[order].astype("<i8"))
    # phrases that end in a node stand together from ``first[node]`` on
    put_array(uri, f"{name}.first", np.searchsorted(nodes, np.arange(len(edges) + 2)).astype("<i8"))
    put_array(uri, f"{name}.phrase", np.array([k for _, k in accepted], "<i8"))
    put_array(uri, f"{name}.depth", np.array([max((len(t) for t, _ in lists), default=0)], "<i8"))


class PhraseIndex:
    """Compiled phrases below ``uri``; ``parts`` are the numbers of its tries."""

    def __init__(self, uri: str, parts: list[int], spaces: str):
        self.uri, self.parts, self.spaces = uri, parts, spaces

    @classmethod
    def build(cls, phrases: DataFrame, spaces: str = "exact", trie_phrases: int = TRIE_PHRASES) -> PhraseIndex:
        """Compile (phrase_id long, phrase string[, plural boolean]).

        A phrase is found as whole words in any case. ``plural`` also finds it with s or es at its end. ``spaces`` = ``any``
        lets every white space in it stand for any run of white space, else it stands for itself. Phrases
        that are null, or don't begin and end with a word character, find nothing.
        """
        if spaces not in _TOKEN:
            raise ValueError("spaces is exact or any")
        spark = phrases.sparkSession
        plural = F.col("plural") if "plural" in phrases.columns else F.lit(False)
        rows = phrases.select("phrase_id", "phrase", F.coalesce(plural, F.lit(False)).alias("plural")).filter("phrase is not null")
        tries = max(1, ceil(rows.count() / trie_phrases))
        part = F.pmod(F.xxhash64("phrase"), F.lit(tries)).cast("int")
        uri = fresh_folder(spark, "phrases")

        def build(table: pa.Table) -> pa.Table:
            lists = []
            for k, phrase, more in zip(*(table[c].to_pylist() for c in ("phrase_id", "phrase", "plural"))):
                tokens = token_list(phrase.strip().lower(), spaces)
                if not tokens or not (_WORD(tokens[0]) and _WORD(tokens[-1])):
                    continue
                lists += [(k, [*tokens[:-1], tokens[-1] + end]) for end in (("", "s", "es") if more else ("",))]
            _trie(uri, table["part"][0].as_py(), lists)
            return table.select(["part"]).slice(0, 1)

        made = rows.withColumn("part", part).repartition(tries, "part").groupBy("part").applyInArrow(build, "part int").collect()
        return cls(uri, sorted(r.part for r in made), spaces)

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, start, end) of all occurrences, by text and start; places are characters from 0."""
        lists = [token_list((t or "").lower(), self.spaces) for t in texts]
        flat = pa.array([t for one in lists for t in (*one, "")], pa.string())  # "" parts the texts
        counts = np.array([len(one) + 1 for one in lists], np.int64)
        owner = np.repeat(np.arange(len(lists)), counts)
        starts = np.concatenate([np.array([m.start() for m in _TOKEN[self.spaces].finditer((t or "").lower())] + [len((t or "").lower())], np.int64) for t in texts]) if texts else np.empty(0, np.int64)
        codes = flat.dictionary_encode()
        number, known = codes.indices.to_numpy().astype(np.int64), codes.dictionary
        found = []
        for part in self.parts:
            name = f"{part:06d}"
            keys, follow, first, phrase = (mapped(self.uri, f"{name}.{c}", "<i8") for c in ("keys", "next", "first", "phrase"))
            words = _Strings.get(self.uri, name)
            if not len(keys):
                continue
            place = pc.fill_null(pc.index_in(known, value_set=words), -1).to_numpy().astype(np.int64)
            token = place[number]
            at = np.flatnonzero(token >= 0)
            node, here = np.zeros(len(at), np.int64), at
            for step in range(int(mapped(self.uri, f"{name}.depth", "<i8")[0])):
                inside = at + step < len(token)
                at, node = at[inside], node[inside]
                here = token[at + step]
                at, node, here = at[here >= 0], node[here >= 0], here[here >= 0]
                if not len(at):
                    break
                key = node * len(words) + here
                pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[pos] == key
                at, node = at[hit], follow[pos[hit]]
                times = first[node + 1] - first[node]
                if times.any():
                    some = np.flatnonzero(times)
                    entry = np.repeat(first[node[some]], times[some]) + _counted(times[some])
                    one = np.repeat(at[some], times[some])
                    found.append((owner[one], phrase[entry], starts[one], starts[one + step + 1]))
        if not found:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        rows = [np.concatenate(c) for c in zip(*found)]
        order = np.lexsort((rows[3], rows[1], rows[2], rows[0]))
        return tuple(c[order] for c in rows)


def _counted(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each number in turn."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _slices(batches, text: str):
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def mentions(texts: DataFrame, index: PhraseIndex, keys: list[str], text_col: str) -> DataFrame:
    """(keys, phrase_id, start, length): every occurrence of every phrase, those inside longer ones, too.

    ``start`` counts characters from 1 in the lower-cased text. Null texts have none.
    """
    rows = texts.select(*keys, F.col(text_col).cast("string").alias("text_"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches):
        for batch in _slices(batches, "text_"):
            owner, phrase, start, end = index.find(batch["text_"].to_pylist())
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [*(batch[k].take(at) for k in keys), pa.array(phrase), pa.array(start + 1), pa.array(end - start)], names=[*keys, "phrase_id", "start", "length"])

    return rows.mapInArrow(scan, f"{kinds}, phrase_id long, start long, length long")


def longest_first(phrase: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Phrases of one text when longer ones are looked for first and blank the place they are found at.

    The first occurrence that touches no blanked place counts; phrases of one length go by number.
    """
    spans: dict[int, list[tuple[int, int]]] = {}
    for p, a, b in zip(phrase.tolist(), start.tolist(), end.tolist()):
        spans.setdefault(p, []).append((a, b))
    taken: list[tuple[int, int]] = []
    out = []
    for p in sorted(spans, key=lambda p: (-max(b - a for a, b in spans[p]), p)):
        free = next(((a, b) for a, b in spans[p] if all(b <= x or y <= a for x, y in taken)), None)
        if free:
            taken.append(free)
            out.append(p)
    return out


def longest_mentions(texts: DataFrame, index: PhraseIndex, keys: list[str], text_col: str) -> DataFrame:
    """(keys, phrase_ids): one row per text with the sorted numbers of the phrases that it names, the
    longest looked for first, so that a part of a longer one counts only where it stands alone."""
    rows = texts.select(*keys, F.col(text_col).cast("string").alias("text_"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches):
        for batch in _slices(batches, "text_"):
            owner, phrase, start, end = index.find(batch["text_"].to_pylist())
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            said = [sorted(longest_first(phrase[lo:hi], start[lo:hi], end[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(said, pa.list_(pa.int64()))], names=[*keys, "phrase_ids"])

    return rows.mapInArrow(scan, f"{kinds}, phrase_ids array<long>")
