"""Packing of documents into training sequences by column generation for cutting stock.

Every document is cut into full pieces of ``capacity`` tokens and one remainder. Remainders
fall into length classes of ``grain`` tokens; their histogram (at most capacity / grain
numbers, whatever the input) goes to the driver. There a linear program over patterns is
solved: a revised simplex keeps one pattern per class in its basis, and a knapsack dynamic
program prices new patterns by the dual values, until none would improve. Patterns are
rounded down; ranks of the remainders within their class, made of per-bucket counts and
positions in a bucket, tell each its sequence. What rounding leaves over (fewer pieces than
one full pattern of each single class holds, some 3,500 at most) is laid end to end and cut at
sequence borders; its tail is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, written

CAPACITY, GRAIN, END_ID = 2048, 4, 1
#: Words whose ids a worker keeps, about (200 bytes each), and bytes of text per kept word that it
#: takes at once. Fewer words take less memory and more time; the rows are the same.
KEPT_WORDS, BYTES_A_WORD = 400_000, 10
#: New words that are tokenized at once.
TOGETHER = 16_384
#: Parts of the sequences that follow a given order.
SLICES = 64
#: Rows of a class that are ranked together.
BUCKET_ROWS = 20_000


def word_wise(path: str) -> bool:
    """Whether the tokenizer lower-cases, splits at white space and marks each word's end, so that
    words can be tokenized one by one."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)

    def parts(part: dict | None) -> list[dict]:
        return [] if not part else [part, *(q for k in ("normalizers", "pretokenizers") for p in part.get(k) or () for q in parts(p))]

    lowers = any(p["type"] == "Lowercase" or p.get("lowercase") is True for p in parts(made.get("normalizer")))
    # a removing split keeps only what its pattern matches
    splits = any(
        p["type"] in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit") or (p["type"], p.get("behavior"), p.get("invert")) == ("Split", "Removed", True)
        for p in parts(made.get("pre_tokenizer")))
    if not (lowers and splits and (made.get("model") or {}).get("end_of_word_suffix") == "</w>"):
        return False
    from tokenizers import Tokenizer

    ids_of = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    words = ["Aa", "bB.", "c's", "1,5", "(d)"]
    return ids_of("  ".join(words) + "\n\t" + words[0]) == [i for w in [*words, words[0]] for i in ids_of(w.lower())]


class WordIds:
    """Token ids of texts, word by word where ``word_wise`` allows it, else of whole texts.

    White space never joins tokens then, so words can be kept. Words of letters are looked up without the ``.,;:!?`` at their end, which the tokenizer
    splits off; new ones are tokenized together, and the marks of word ends tell them apart.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.plain_letters: set[str] = set()
        self.odd: set[str] = set()
        self.kept = kept
        self.word_wise = word_wise(path)

    def each(self, words: list[bytes]) -> dict[bytes, bytes]:
        got = self.encode([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, got)}

    def together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are one run of letters each."""
        if not words:
            return {}
        ids = np.array(self.encode([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):
            return self.each(words)
        raw, cuts = ids.tobytes(), cuts.tolist()
        return {w: raw[lo:hi] for w, lo, hi in zip(words, [0, *cuts], cuts)}

    def odd_letters(self, words: list[bytes]) -> set[str]:
        """Letters among the words that the tokenizer's normalising makes into more than letters: their
        lower case or composition ends in a mark, which it joins with punctuation."""
        normalizer = self.tokenizer.normalizer
        for c in set(b"".join(words).decode("utf-8", "replace")) - self.plain_letters - self.odd:
            kept = c.isascii() or not c.isalpha() or normalizer is None or normalizer.normalize_str(c).isalpha()
            (self.plain_letters if kept else self.odd).add(c)
        return self.odd

    def learnt(self, new: list[bytes]) -> dict[bytes, bytes]:
        known, plain, odd, parts = self.known, {}, [], []
        marked = self.odd_letters(new)
        for w in new:
            stem = w.rstrip(b".,;:!?")
            if stem.isalpha() if stem.isascii() else (text := stem.decode("utf-8", "replace")).isalpha() and marked.isdisjoint(text):
                parts.append((w, stem, w[len(stem) :]))
                if stem not in known:
                    plain[stem] = True
                if len(stem) < len(w) and parts[-1][2] not in known:
                    odd.append(parts[-1][2])
            else:
                odd.append(w)
        found: dict[bytes, bytes] = {}
        for words, ids_of in ((list(plain), self.together), (list(dict.fromkeys(odd)), self.each)):
            for lo in range(0, len(words), TOGETHER):  # the tokenizer needs some 500 bytes a word while it works
                found |= ids_of(words[lo : lo + TOGETHER])
        get = lambda x: found[x] if x in found else known[x]
        for w, stem, tail in parts:
            if tail:
                found[w] = get(stem) + get(tail)
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Per text, its ids and the end id as little-endian 32-bit numbers."""
        if not self.word_wise:
            whole = (self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts)
            return [np.array([*ids, END_ID], "<u4").tobytes() for ids in whole]
        raw = ((t or "").encode("utf-8", "surrogatepass") for t in texts)
        # lower-casing A-Z early makes fewer words, but could make a special token's string
        words = [(x if b"<|" in x else x.lower()).split() for x in raw]
        known = self.known
        new = [w for w in set().union(*words) if w not in known]
        full = len(known) >= self.kept
        found = self.learnt(new) if new else {}
        known.update(found)
        end = END_ID.to_bytes(4, "little")
        out = [b"".join(map(known.__getitem__, w)) + end for w in words]
        if full:
            for w in found:
                del known[w]
        return out


_tokenizers: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, kept: int = KEPT_WORDS) -> WordIds:
    if (path, kept) not in _tokenizers:
        _tokenizers[path, kept] = WordIds(path, kept)
    return _tokenizers[path, kept]


def best_patterns(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int = 1) -> list[tuple[float, np.ndarray]]:
    """Unbounded knapsack by dynamic programming: the most worthy multiset of sizes that fits first.

    One table gives ``most`` patterns: the others are the best that hold a given size.
    """
    items = np.flatnonzero(worth > 1e-12)
    items = items[np.argsort(sizes[items], kind="stable")]
    s, w = sizes[items], worth[items]
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fits[c]
        if n:
            value = best[c - s[:n]] + w[:n]
            i = value.argmax()
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i

    def filled(c: int, first: int | None = None) -> np.ndarray:
        pattern = np.zeros(len(sizes), np.int64)
        if first is not None:
            pattern[items[first]] += 1
            c -= s[first]
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                pattern[items[took[c]]] += 1
                c -= s[took[c]]
        return pattern

    out = [(float(best[capacity]), filled(capacity))]
    if most > 1 and fits[capacity]:
        n = fits[capacity]
        value = best[capacity - s[:n]] + w[:n]
        out += [(float(value[i]), filled(capacity, i)) for i in np.argsort(-value, kind="stable")[: most - 1].tolist()]
    return out


#: Patterns that one knapsack table prices.
PRICED = 24


def fractional_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 5000) -> list[tuple[float, np.ndarray]]:
    """(copies, pattern) of the cutting-stock linear program, by revised simplex and column generation.

    The patterns cover the demand, perhaps with a surplus of some sizes. Stops at the optimum, or
    when the dual bound shows that the value is within ``gap`` of it.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)  # column j: pattern of basis variable j
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand

    def entered(column: np.ndarray, price: float) -> bool:
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        amount = max(ratio[out], 0.0)
        x[:] -= amount * step
        x[out] = amount
        inverse[out] /= step[out]
        step[out] = 0.0
        inverse[:] -= np.outer(step, inverse[out])
        columns[:, out], cost[out] = column, price
        return True

    for _ in range(rounds):
        dual = cost @ inverse
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:  # more of a class than asked for would help: its surplus enters
            column = np.zeros(m)
            column[worst] = -1.0
            if not entered(column, 0.0):
                break
            continue
        found = best_patterns(sizes, dual, capacity, PRICED)
        if found[0][0] <= 1 + 1e-7 or 1 - 1 / found[0][0] < gap:
            break
        moved = False
        for _, pattern in found:
            if dual @ pattern > 1 + 1e-7:
                moved |= entered(pattern.astype(float), 1.0)
                dual = cost @ inverse
        if not moved:
            break
    return [(float(n), columns[:, j].astype(np.int64)) for j, n in enumerate(x) if cost[j] > 0 and n > 0]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 5000) -> list[tuple[int, np.ndarray]]:
    """Whole (copies, pattern) pairs that never exceed the demand, from the rounded linear program.

    Copies are rounded down. Where a pattern holds more of a size than is left, it goes on
    without what is too much, so that no other size loses its place. What is left after that is
    solved again while it has more pieces than one copy of each pattern could hold, and at last
    goes into patterns of one size: fewer than ``most_left`` pieces stay, whatever the demand.
    """
    left, plan = demand.astype(np.int64).copy(), []
    for _ in range(4):
        open_ = np.flatnonzero(left)
        if int(left.sum()) < most_left(sizes, capacity) or not len(open_):
            break
        before = int(left.sum())
        found = fractional_plan(sizes[open_], left[open_], capacity, gap, rounds)
        for n, part in sorted(found, key=lambda f: -f[0]):
            pattern, copies = np.zeros(len(sizes), np.int64), int(n + 1e-6)
            pattern[open_] = part
            while copies > 0 and pattern.any():
                used = pattern > 0
                now = min(copies, int((left[used] // pattern[used]).min()))
                if now:
                    plan.append((now, pattern.copy()))
                    left -= now * pattern
                    copies -= now
                pattern = np.minimum(pattern, left)
        if int(left.sum()) == before:
            break
    if int(left.sum()) >= most_left(sizes, capacity):
        for i in np.flatnonzero(left):
            copies = int(left[i] // (capacity // sizes[i]))
            if copies:
                pattern = np.zeros(len(sizes), np.int64)
                pattern[i] = capacity // sizes[i]
                plan.append((copies, pattern))
                left -= copies * pattern
    return plan


def most_left(sizes: np.ndarray, capacity: int) -> int:
    """More pieces than this never stay unplaced: one full pattern of each single size."""
    return int((capacity // sizes).sum())


def _ranked(pieces: DataFrame, total: int, ordered: bool) -> DataFrame:
    """Adds rank: a distinct number from 0 within each class, without one task per class. It grows with
    the pieces' window and place if they are ordered, else with a hash."""
    buckets = max(1, ceil(total / BUCKET_ROWS))
    hashed = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)).cast("int")
    rows = pieces.withColumn("bucket", F.col("window") if ordered else hashed)
    sums = rows.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("class", "bucket").orderBy(*(["place"] if ordered else []), "doc_id", "start", "salt")
    return rows.withColumn("nth", F.row_number().over(order)).join(sums, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before")


def pack(
    documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN,
    kept_words: int = KEPT_WORDS, order: tuple[str, str] | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    ``order`` names two columns of whole numbers: the window of each document in a given order, and its place
    there. Sequences are then numbered in that order, as near as one of SLICES parts of all
    sequences: a part's pieces of every class come from the same part of the documents. Pieces
    that the plan leaves over, a bounded number of the last ones, come at the end.

    ``tokenizer`` is the path of a tokenizer file that all machines have; ``kept_words`` bounds
    what a worker remembers of it. A document's ids are
    those of its text without special tokens, then id 1. Returns one row per piece: id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of the sequence). Every
    id is in exactly one piece; sequences have no gaps and are padded at their end to
    ``capacity``, or not at all where their length is a power of two.

    Edge cases: null and empty texts have the one id 1; documents of any length are cut; rows
    that repeat are packed each; null ids are packed under the null id; an empty table gives an
    empty result. Other columns are ignored.
    """
    if capacity % grain:
        raise ValueError("capacity is a multiple of grain")
    spark = documents.sparkSession
    window, place = (F.col(c).cast("long") for c in order) if order else (F.lit(0).cast("long"),) * 2
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), window.alias("window"), place.alias("place"))
    step = 4 * capacity

    def word_ids_of() -> WordIds:
        return word_ids(tokenizer, kept_words)

    def cut(batches):
        ids_of = word_ids_of()
        salt = 0
        for batch in bounded(batches, "text", BYTES_A_WORD * kept_words):
            rows = []
            for doc, ids, w, p in zip(batch["doc_id"].to_pylist(), ids_of(batch["text"].to_pylist()), batch["window"].to_pylist(), batch["place"].to_pylist()):
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, salt, w, p))
                    salt += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 8)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "window", "place"])

    pieces = written(
        docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long, window long, place long")
        .withColumn("class", F.ceil(F.col("length") / grain).cast("int") + (F.col("length") == capacity).cast("int")),
        "pieces",
    )
    full = capacity // grain + 1  # pieces of exactly the capacity are a class of their own
    demand = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    classes = np.array(sorted(c for c in demand if c != full), dtype=np.int64)
    plan = cutting_stock(classes, np.array([demand[c] for c in classes]), capacity // grain)
    plan = [(copies, [(int(classes[i]), int(pattern[i])) for i in np.flatnonzero(pattern)]) for copies, pattern in plan]
    if full in demand:
        plan.append((demand[full], [(full, 1)]))
    runs, served, sequence = [], dict.fromkeys(demand, 0), 0
    slices = SLICES if order else 1
    for k in range(slices):  # the same part of every pattern's copies
        for copies, pattern in plan:
            own = copies * (k + 1) // slices - copies * k // slices
            for c, each in pattern if own else ():
                runs.append((c, served[c], served[c] + own * each, sequence, each))
                served[c] += own * each
            sequence += own
    if sum(demand[int(c)] - served[int(c)] for c in classes) > most_left(classes, capacity // grain):
        raise AssertionError("more pieces left over than a pattern of each class holds")
    table = spark.createDataFrame(runs, "c int, lo long, hi long, first long, each int")
    ranked = _ranked(pieces, sum(demand.values()), order is not None)
    placed = written(
        ranked.join(F.broadcast(table), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt",
                F.expr("first + (rank - lo) div each").alias("sequence_id")), "placed",
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "salt")
    whole = placed.filter(F.col("sequence_id").isNotNull()).select(
        *columns, (F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.sum("length").over(Window.partitionBy("sequence_id")).alias("used"),
    )
    # cutting_stock leaves fewer than most_left pieces, whatever the histogram
    left = placed.filter(F.col("sequence_id").isNull()).drop("sequence_id").orderBy("doc_id", "start", "ids_crc32", "salt").collect()
    rest = _recut(docs, left, sequence, word_ids_of, capacity)
    out = whole if rest is None else whole.unionByName(rest)
    power = F.expr("used & (used - 1)") == 0
    return out.withColumn("padding", F.when(power, 0).otherwise(capacity - F.col("used")).cast("long")).drop("used").withColumnRenamed("doc_id", id_col)


def _recut(docs: DataFrame, left: list, sequence: int, word_ids_of: Callable[[], WordIds], capacity: int) -> DataFrame | None:
    """Lay the given pieces end to end and cut them at sequence borders, the tail at powers of two."""
    if not left:
        return None
    total = sum(r["length"] for r in left)
    borders = list(range(0, total - total % capacity + 1, capacity))
    for bit in reversed(range(capacity.bit_length())):
        if total % capacity >> bit & 1:
            borders.append(borders[-1] + (1 << bit))
    borders = np.array(borders)
    rows, at = [], 0
    for r in left:
        lo, end = at, at + r["length"]
        at = end
        while lo < end:
            k = int(np.searchsorted(borders, lo, "right")) - 1
            hi = min(end, int(borders[k + 1]))
            rows.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], lo - (end - r["length"]), hi - lo,
                         sequence + k, lo - int(borders[k]), int(borders[k + 1] - borders[k])))
            lo = hi
    spark = docs.sparkSession
    cuts = spark.createDataFrame(
        rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, skip long, take long, sequence_id long, offset long, used long")
    wanted = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in left}

    def again(batches):
        ids_of = word_ids_of()
        for batch in bounded(batches, "text", 1_000_000):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), ids_of(batch["text"].to_pylist())):
                start = (len(ids) // 4 - 1) // capacity * capacity
                piece = ids[4 * start :]
                key = (doc, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                if key in wanted:
                    rows.append((*key, piece))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 5, pa.binary()))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    owners = cuts.select(F.col("doc_id").alias("d")).distinct()
    few = docs.drop("window", "place").join(F.broadcast(owners), docs["doc_id"].eqNullSafe(F.col("d")), "left_semi")
    # equal keys hold equal ids; one copy serves all rows that repeat them
    found = few.mapInArrow(again, ", ".join(f"{c} long" for c in key) + ", ids binary").dropDuplicates(key)
    same = cuts["doc_id"].eqNullSafe(found["doc_id"])
    for c in key[1:]:
        same = same & (cuts[c] == found[c])
    part = F.substring(found["ids"], F.col("skip") * 4 + 1, F.col("take") * 4)
    return cuts.join(found, same).select(
        cuts["doc_id"], (cuts["start"] + F.col("skip")).alias("start"), F.col("take").alias("length"),
        F.crc32(part).alias("ids_crc32"), cuts["doc_tokens"], "sequence_id", "offset", "used",
    )
