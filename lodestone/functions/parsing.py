"""Parsers of written lines; Arrow functions where no built-in expresses the grammar."""

from __future__ import annotations

import difflib
import heapq
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .text import tokens

LEADING_UNIT = r"^([0-9 /½⅓¾.-]+)(cups|cup|tbsp|tsp|g|kg|ml|l|oz|lb)\b"
#: Words that carry no content.
PLAIN_WORDS = ("that", "this", "with", "from")
NEGATIONS = frozenset("no not never without don't doesn't avoid skip omit".split())
#: Cues that negate what follows, and how many words they reach over.
NEGATION = r"\b(?:no|not|without|never|omit\w*|exclud\w*|avoid\w*|skip\w*|instead of|rather than|free of)\b"
REACH = 8


def spaced(x: Column) -> Column:
    """A space between a digit and a letter, a lower and an upper letter, and after a bracket."""
    t = F.regexp_replace(x, "([0-9])([A-Za-z])", "$1 $2")
    t = F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(t, r"\)([A-Za-z])", ") $1")


def phrase_pattern(phrase: str) -> str:
    """The phrase as whole words, its last word also in the plural."""
    return r"\b" + re.escape(phrase).replace(r"\ ", " ") + r"(?:s|es)?\b"


def content_words(x: Column) -> Column:
    return F.filter(F.array_distinct(tokens(x)), lambda w: (F.length(w) > 3) & ~w.isin(*PLAIN_WORDS))


def step_numbers(x: Column, most: int = 200) -> Column:
    """Numbers and ranges a-b as one list; ranges that are reversed or too long are left out."""
    parts = F.regexp_extract_all(x, F.lit("[0-9]{1,9}(?:-[0-9]{1,9})?"), F.lit(0))
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("long").alias("a"), F.split_part(p, F.lit("-"), F.lit(-1)).cast("long").alias("b")))
    fine = F.filter(pairs, lambda p: (p["b"] >= p["a"]) & (p["b"] - p["a"] < most))
    return F.flatten(F.transform(fine, lambda p: F.sequence(p["a"], p["b"])))


@pandas_udf(ArrayType(StringType()))
def r_vector(x: pd.Series) -> pd.Series:
    """Items of ``c("a", NA, ...)``; ``character(0)`` is empty, a bare word one item, anything malformed null."""
    item = re.compile(r'\s*(?:(NA)|("(?:[^"\\]|\\.)*"))\s*(,|$)')

    def one(t):
        if t is None or t.strip() in ("", "NA", "NULL"):
            return None
        t = t.strip()
        if t == "character(0)":
            return []
        if not (t.startswith("c(") and t.endswith(")")):
            return None if re.search(r'["()]', t) else [t]
        out, pos, body = [], 0, t[2:-1]
        while pos < len(body) or not out:
            m = item.match(body, pos)
            if not m:
                return None
            try:
                out.append(None if m[1] else json.loads(m[2]))
            except ValueError:
                return None
            pos = m.end()
            if m[3] == "," and pos >= len(body):
                return None
        return out

    return x.map(one)


def negated(text: Column, term: str) -> Column:
    """Whether the term occurs and a cue stands among the eight words before each of its
    mentions, in the same clause."""
    whole = r"\b" + re.escape(term).replace(r"\ ", " ") + r"\b"

    def clause_cues(clause: Column) -> Column:
        parts = F.split(clause, whole)

        def cue(i: Column) -> Column:
            words = F.filter(F.split(F.array_join(F.slice(parts, F.lit(1), i), term), r"\s+"), lambda w: w != "")
            return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - (REACH - 1)), F.lit(REACH)), " ").rlike(NEGATION)

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), cue)

    cues = F.flatten(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "[.!?;:]"), clause_cues))
    return (F.size(cues) > 0) & F.forall(cues, lambda c: c)


@pandas_udf(BooleanType())
def claims_fidelity(x: pd.Series) -> pd.Series:
    """Whether a clause claims to be true to the source without one of the three words before negating it."""
    claim = re.compile(r"\b(exactly|faithfully|unchanged|word for word|the original recipe)\b", re.I)

    def one(t):
        if t is None:
            return None
        for clause in re.split(r"[.;!?,]", t):
            for m in claim.finditer(clause):
                if not NEGATIONS & set(re.findall(r"[\w']+", clause[: m.start()].lower())[-3:]):
                    return True
        return False

    return x.map(one)


def suggestions(vocabulary: DataFrame, asked: list[tuple[int, str]], most: int = 8) -> DataFrame:
    """(id, suggestions) for a stated set of terms: names of ratio 0.6 or more, the closest first,
    then names that contain the term or lie in it, alphabetically.

    ``vocabulary`` has distinct names; each task compares its names with the terms and sends on
    no more than ``most`` of either kind per term.
    """
    def compared(batches):
        near: dict[int, list] = {i: [] for i, _ in asked}
        part: dict[int, list] = {i: [] for i, _ in asked}
        for batch in batches:
            for name in batch["name"].to_pylist():
                for i, term in asked:
                    if not name or not term:
                        continue
                    match = difflib.SequenceMatcher(None, name, term)
                    ratio = match.ratio() if match.real_quick_ratio() >= 0.6 and match.quick_ratio() >= 0.6 else 0.0
                    if ratio >= 0.6:
                        near[i] = heapq.nlargest(most, [*near[i], (ratio, name)])
                    elif term in name or name in term:
                        part[i] = heapq.nsmallest(most, [*part[i], name])
        rows = [(i, r, n) for i, found in near.items() for r, n in found] + [(i, 0.0, n) for i, found in part.items() for n in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.string()))], names=["id", "ratio", "name"])

    rows = vocabulary.select("name").mapInArrow(compared, "id long, ratio double, name string")
    close = F.sort_array(F.collect_list(F.when(F.col("ratio") > 0, F.struct("ratio", "name"))), asc=False)
    # at most ``most`` names per task and term are collected
    found = rows.groupBy("id").agg(F.transform(F.slice(close, 1, most), lambda c: c["name"]).alias("near"), F.sort_array(F.collect_list(F.when(F.col("ratio") == 0, F.col("name")))).alias("part"))
    ids = vocabulary.sparkSession.createDataFrame([(i,) for i, _ in asked], "id long")
    both = F.slice(F.concat("near", "part"), 1, most)
    return ids.join(found, "id", "left").select("id", F.coalesce(both, F.array().cast("array<string>")).alias("suggestions"))


_NUMBER = r"(?:[0-9]+ [0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?)"
LINE_START = rf"^\s*({_NUMBER})(?:\s*(?:-|to)\s*({_NUMBER}))?\s*(.*)$"


def unit_words() -> dict[str, str]:
    """Each known unit word with its canonical unit."""
    from .rational import ALIASES, UNITS

    return {u: u for g in UNITS.values() for u in g} | ALIASES


def ingredient_line(x: Column) -> Column:
    """One written line as a struct; a range keeps both ends and never a midpoint. Blank lines give nulls."""
    start = lambda i: F.nullif(F.regexp_extract(x, LINE_START, i), F.lit(""))
    known = F.create_map(*(F.lit(v) for pair in unit_words().items() for v in pair))
    rest = F.when(start(1).isNotNull(), F.regexp_extract(x, LINE_START, 3)).otherwise(F.trim(x))
    unit = F.try_element_at(known, F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^ ]*", 0), r"\.+$", "")))
    body = F.when(unit.isNotNull(), F.regexp_replace(rest, "^[^ ]* ?", "")).otherwise(rest)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = {
        "amount": start(1), "amount_high": start(2), "unit": unit, "item": text(F.regexp_extract(body, "^[^,]*", 0)), "preparation": text(F.regexp_replace(body, "^[^,]*,?", "")),
        "is_range": start(2).isNotNull(), "optional": F.lower(x).contains("optional"), "qualitative": x.rlike(r"(?i)\bto taste\b|\bas needed\b"), "alternatives": x.rlike(r"(?i)\bor\b"),
    }
    blank = F.coalesce(F.trim(x), F.lit("")) == ""
    return F.struct(*(F.when(~blank, c).alias(n) for n, c in parts.items()))


ATTRIBUTION = ArrayType(StructType([StructField("amount", StringType()), StructField("position", IntegerType()), StructField("item", StringType()), StructField("distance", DoubleType())]))


@pandas_udf(ATTRIBUTION)
def attributed_amounts(text: pd.Series, items: pd.Series) -> pd.Series:
    """Each amount in prose with the item mentioned nearest to it; a mention after it wins ties."""
    number = re.compile(_NUMBER)

    def one(t, names):
        if t is None or names is None:
            return []
        low = t.lower()
        mentions = [(m.start(), m.end(), n) for n in names if n for m in re.finditer(rf"\b{re.escape(n.lower())}(?:s|es)?\b", low)]
        out = []
        for m in number.finditer(low):
            near = min(((min(abs(a - m.end()), abs(m.start() - b)), a < m.start(), a, n) for a, b, n in mentions), default=None)
            out.append({"amount": m[0], "position": m.start(), "item": near[3] if near else None, "distance": float(near[0]) if near else None})
        return out

    return pd.Series([one(a, b) for a, b in zip(text, items)], dtype=object)
