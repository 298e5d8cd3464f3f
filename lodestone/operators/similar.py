"""Names close to asked terms: the ratio of matching blocks for few pairs, bounds for all others.

The ratio of two strings is 2 * M / (la + lb), where M, the characters in matching blocks, is at
most the number of characters that they share, repeats counted. So a ratio of at least t needs
shared >= t * (la + lb) / 2 and lb between la * t / (2 - t) and la * (2 - t) / t. Characters with
their number of occurrence ("e1", "e2", ...) make sets with that overlap. Of two sets that
overlap so far, one of the rarest elements of each, as many as the bound lets go, is
shared: pairs are met by joining those prefixes, counted by their lengths' and overlaps' bounds, and only
what passes is compared exactly.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Least ratio, and how many suggestions a term gets.
RATIO, MOST = 0.6, 8


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, grams): characters numbered by occurrence."""
    chars = F.split(F.col(text), "")
    order = F.array_sort(F.filter(chars, lambda c: c != ""))
    # in sorted order an occurrence's number is its place less that of its character's first one, plus one
    grams = F.transform(order, lambda c, i: F.concat(c, (i - F.array_position(order, c).cast("int") + 2).cast("string")))
    return df.select(key, text, F.length(text).alias("size"), grams.alias("grams"))


def _prefixes(df: DataFrame, key: str, rank: DataFrame, ratio: float) -> DataFrame:
    """(key, gram): the rarest grams, enough that one is shared with whatever is close."""
    need = F.ceil(F.col("size") * (ratio / (2 - ratio)) - 1e-9)  # least overlap with the shortest close name
    rows = df.select(key, "size", F.explode("grams").alias("gram")).join(rank, "gram")
    place = F.row_number().over(Window.partitionBy(key).orderBy("times", "gram"))  # a row per character
    return rows.withColumn("place", place).filter(F.col("place") <= F.col("size") - need + 1).select(key, "gram")


@pandas_udf(DoubleType())
def matching_ratio(name: pd.Series, term: pd.Series) -> pd.Series:
    """2 * M / (la + lb) of the pairs' matching blocks; the name is the first sequence."""
    match = difflib.SequenceMatcher(None)
    out, last = [], None
    for a, b in zip(name, term):
        if b != last:
            match.set_seq2(b)
            last = b
        match.set_seq1(a)
        out.append(match.ratio())
    return pd.Series(out, dtype="float64")


def close_pairs(names: DataFrame, terms: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(term, name, ratio) of all pairs of distinct non-empty strings with at least that ratio."""
    left, right = _marked(names, "name", "name"), _marked(terms, "term", "term")
    rank = left.select(F.explode("grams").alias("gram")).unionByName(right.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("times"))
    met = _prefixes(left, "name", rank, ratio).join(_prefixes(right, "term", rank, ratio), "gram").select("name", "term").distinct()
    both = met.join(left.select("name", F.col("size").alias("a"), F.col("grams").alias("ag")), "name").join(
        right.select("term", F.col("size").alias("b"), F.col("grams").alias("bg")), "term")
    shared = F.size(F.array_intersect("ag", "bg"))
    able = both.filter(2 * shared >= ratio * (F.col("a") + F.col("b")) - 1e-9).select("term", "name")
    return able.withColumn("ratio", matching_ratio("name", "term")).filter(F.col("ratio") >= ratio)


def _parts(df: DataFrame, key: str, width: int) -> DataFrame:
    t = F.col(key)
    starts = F.sequence(F.lit(1), F.length(t) - (width - 1))
    return df.filter(F.length(t) >= width).select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(width))))).alias("part"))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of all pairs where the one string lies in the other.

    Inner strings of three and more characters are met by their rarest trigram among the outer ones, shorter ones as wholes.
    """
    found = None
    for width in (1, 2, 3):
        parts = _parts(outer, "outer", width)
        own = inner.filter(F.length("inner") == width if width < 3 else F.length("inner") >= 3)
        if width < 3:
            one = own.join(parts.withColumnRenamed("part", "inner"), "inner")
        else:
            times = parts.groupBy("part").agg(F.count("*").alias("times"))
            place = Window.partitionBy("inner").orderBy(F.coalesce("times", F.lit(0)), "part")
            rare = _parts(own, "inner", 3).join(times, "part", "left").withColumn("nth", F.row_number().over(place)).filter("nth = 1")
            one = rare.select("inner", "part").join(parts, "part").filter(F.contains("outer", "inner"))
        one = one.select("inner", "outer")
        found = one if found is None else found.unionByName(one)
    return found


def suggestions(names: DataFrame, terms: DataFrame, most: int = MOST, ratio: float = RATIO) -> DataFrame:
    """(term, place, name, ratio): at most ``most`` names per term of a table (term).

    First names of at least that ratio, the closest first and equal ones by falling name; then names
    that contain the term or lie in it, alphabetically, with a null ratio. Null and empty strings
    suggest nothing; repeated ones count once.
    """
    known = names.select("name").filter("name <> ''").distinct()
    asked = terms.select("term").filter("term <> ''").distinct()
    near = close_pairs(known, asked, ratio)
    part = containing(asked.select(F.col("term").alias("inner")), known.select(F.col("name").alias("outer"))).select(F.col("inner").alias("term"), F.col("outer").alias("name")).unionByName(
        containing(known.select(F.col("name").alias("inner")), asked.select(F.col("term").alias("outer"))).select(F.col("outer").alias("term"), F.col("inner").alias("name"))).distinct()
    part = part.join(near.select("term", "name"), ["term", "name"], "left_anti").withColumn("ratio", F.lit(None).cast("double"))
    order = [F.col("ratio").desc_nulls_last(), F.when(F.col("ratio").isNotNull(), F.col("name")).desc_nulls_last(), F.col("name")]
    place = F.row_number().over(Window.partitionBy("term").orderBy(*order)).cast("long")
    return near.unionByName(part).withColumn("place", place).filter(F.col("place") <= most).select("term", "place", "name", "ratio")
