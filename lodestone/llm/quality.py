"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Every pair of a good and a poor labelled text is a preference. The score is linear in text
features: measured shares (words, lines, marks, case), and hashed words and byte trigrams. The
weights minimise the logistic loss on feature differences (Newton steps, a small ridge, a
larger one for hashed features, so that they speak where the measured ones are silent). The share of poor texts among the labels gives the quantile of training scores
that becomes the threshold; scores are mapped so that the threshold is 0.3. Labels are taken
from a sample of at most ``MOST_LABELS`` rows, chosen by a hash of the id; features and scores
are computed for every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, hashed_words, tidy

#: Labelled rows that the model is fitted on at most; preference pairs per text of the rarer kind
#: (each text of the other kind is in one more).
MOST_LABELS, PAIRS = 20_000, 8
CUT = 0.3
RIDGE, GRAM_RIDGE = 1e-3, 5e-2
#: Classes of hashed words, and of hashed byte trigrams; pairs of a Newton step's block.
GRAMS, BLOCK_PAIRS = 128, 4096

_ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?!()-|")
_ASCII_LETTERS = bytes(b for b in range(128) if chr(b).isalpha())
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"
_LINE = re.compile(rb"[^\n]+")
NAMES = (
    "log_words", "distinct", "repeated_next", "top_word", "odd_chars", "bang", "bar", "upper", "digits", "word_len", "short_words",
    "full_stops", "commas", "lines", "repeated_lines", "other_bytes", "caps_words", "title_words", "odd_words", "bar_words", "empty",
)
#: Shares whose small values matter most get a logarithm, too.
LOGGED = ("repeated_next", "odd_chars", "bang", "bar", "upper", "caps_words", "odd_words", "bar_words", "repeated_lines", "digits", "full_stops")


def features(text: str | None) -> list[float]:
    """Numbers that describe the whole text; none depends on labels, language, source or id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    size = len(raw)

    def count(kinds: bytes) -> int:
        return size - len(raw.translate(None, kinds))

    seen = Counter(words)
    lines = _LINE.findall(raw)
    letters = max(1, count(_ASCII_LETTERS))
    return [
        log(1 + n), len(seen) / n, sum(map(bytes.__eq__, words, words[1:])) / n, max(seen.values()) / n,
        count(_ODD) / size, raw.count(b"!") / n, raw.count(b"|") / n, count(_UPPER) / letters, count(_DIGITS) / size,
        sum(map(len, words)) / n / 10, sum(len(w) <= 3 for w in words) / n, raw.count(b".") / n, raw.count(b",") / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), (size - len(raw.decode("utf-8", "replace"))) / size,
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n,
        sum(w[-1:] in _ODD_SET for w in words) / n, seen[b"|"] / n, 0.0,
    ]


_ODD_SET = frozenset(bytes([b]) for b in _ODD)


WIDTH = len(NAMES) + 2 * GRAMS


def trigrams(text: str | None) -> np.ndarray:
    """Shares of the classes of byte trigrams, A-Z in lower case."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    out = np.zeros(GRAMS)
    for lo in range(0, max(0, len(raw) - 2), 1 << 20):
        b = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
        out += np.bincount(((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761) >> 16) % GRAMS, minlength=GRAMS)
    return out / max(1, len(raw) - 2)


def described(texts: list[str | None]) -> np.ndarray:
    """One row of WIDTH numbers per whole text: ``features``, then square roots of the shares of
    hashed words and of byte trigrams."""
    out = np.zeros((len(texts), WIDTH))
    if texts:
        words, counts = hashed_words(texts, lower=True)
        at = np.repeat(np.arange(len(texts)), counts) * GRAMS + (words >> np.uint64(32)).astype(np.int64) % GRAMS
        shares = np.bincount(at, minlength=len(texts) * GRAMS).reshape(-1, GRAMS) / np.maximum(counts, 1)[:, None]
        out[:, : len(NAMES)] = [features(t) for t in texts]
        out[:, len(NAMES) :] = np.sqrt(np.hstack([shares, [trigrams(t) for t in texts]]))
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Features and the logarithms of those in LOGGED."""
    return np.hstack([x, np.log(x[:, [NAMES.index(k) for k in LOGGED]] + 0.003)])


class BradleyTerry:
    """score = sigmoid(weights . (x - mean) / scale - threshold + logit(CUT))."""

    def __init__(self, mean, scale, weights, threshold):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((expanded(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.utility(x) - self.threshold + log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 17, steps: int = 25) -> BradleyTerry:
    """Fit weights on preference pairs (good over poor); with one kind of label only, every text
    scores alike: 1 if all are good, else 0."""
    wide = expanded(x.astype(float))
    if not len(x) or good.all() or not good.any():
        width = wide.shape[1]
        return BradleyTerry(np.zeros(width), np.ones(width), np.zeros(width), -60.0 if not len(x) or good.all() else 60.0)
    mean, scale = wide.mean(axis=0), np.maximum(wide.std(axis=0), 1e-6)
    z = wide  # in place, as it is the driver's largest array
    z -= mean
    z /= scale
    rng = np.random.default_rng(seed)
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    few, many = sorted((win, lose), key=len)
    one, other = np.r_[np.repeat(few, PAIRS), rng.choice(few, len(many))], np.r_[rng.choice(many, len(few) * PAIRS), many]
    left, right = (one, other) if few is win else (other, one)
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[len(NAMES) : WIDTH] = GRAM_RIDGE
    for _ in range(steps):
        gradient, hessian = ridge * w, np.diag(ridge)
        for lo in range(0, len(left), BLOCK_PAIRS):
            d = z[left[lo : lo + BLOCK_PAIRS]] - z[right[lo : lo + BLOCK_PAIRS]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
            gradient = gradient + d.T @ (p - 1) / len(left)
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / len(left)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    u = np.sort(z @ w)
    k = len(lose)  # the quantile that the share of poor labels gives, halfway to the next score
    threshold = (u[k - 1] + u[min(k, len(u) - 1)]) / 2
    return BradleyTerry(mean, scale, w, float(threshold))


def fold_out(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, most_labels: int = MOST_LABELS,
) -> BradleyTerry:
    """Fit on labelled rows outside the held-out fold; ids whose labels differ are left out.

    Of rows that repeat a labelled id, one counts (the least by its numbers).
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~fold_out("id", folds))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("id", "y")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_labels)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def measured(batches):
        for batch in bounded(batches):
            x = described(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=["id", "y", "x"])

    rows = docs.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(measured, "id long, y int, x binary")
    # one row per labelled id, so that the sample is bounded however often an id repeats
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["id"])  # the fit doesn't depend on the tasks' order
    y = np.array([r["y"] for r in rows], dtype=bool)
    x = np.empty((len(rows), WIDTH), "<f4")
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r["x"], "<f4")
    del rows
    model = fit(x, y)
    del x
    tidy()
    return model


def score(documents: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, score (0 to 1) and predicted (1 if score >= 0.3). Null text is empty."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scored(batches):
        for batch in bounded(batches):
            s = model.score(described(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.mapInArrow(scored, f"{id_col} long, score double, predicted int")


def only_good(documents: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """The rows predicted 1, with all their columns; each is judged by its own text."""
    def kept(batches):
        for batch in bounded(batches, text_col):
            yield batch.filter(pa.array(model.score(described(batch[text_col].to_pylist())) >= CUT))

    return documents.mapInArrow(kept, documents.schema)


def classify(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5,
    most_labels: int = MOST_LABELS,
) -> DataFrame:
    """Fit outside the held-out fold and score every row: id, held_out, score, predicted.

    Edge cases: null text is empty, and empty texts are scored; labels of null ids or other
    values than 0 and 1 are ignored; without usable labels every row scores close to 1; rows
    that repeat are scored each; a null id is in the fold of the text ''; an empty table gives
    an empty result. Other columns are ignored.
    """
    model = train(documents, labels, id_col, text_col, label_col, folds, most_labels)
    return score(documents, model, id_col, text_col).withColumn("held_out", fold_out(id_col, folds))
