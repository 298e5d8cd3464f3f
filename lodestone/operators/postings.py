"""Inverted tables of documents, written once and read by every search.

``terms`` has one row per term and document with the number of occurrences, ``lexemes`` one per
stemmed word and document with its positions. Rows are dealt by range of (term, key) and
sorted, so that a frequent term spreads over files and a file's statistics name few terms.
A stored table serves as long as the files that it was made of stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .storage import files_state, written

#: Terms that a search hands to the scan as a filter; more are only joined.
MOST_LISTED = 1000
#: Words that aren't indexed as lexemes.
STOP = (
    "a an and are as at be but by for from had has have he her his i in is it its me my no not of on or our she so that the their them they this to was we "
    "were what when which who will with you your"
).split()
#: Fixed values of the light stemmer: ending, least length of the word, what stands in its place.
ENDINGS = (("ies", 5, "y"), ("sses", 5, "ss"), ("ing", 6, ""), ("edly", 7, ""), ("ed", 5, ""), ("ly", 5, ""), ("es", 5, "e"), ("s", 4, ""))


def stemmed(word: Column) -> Column:
    """A light stemmer: plural, -ing, -ed and -ly endings; documented, not Porter's."""
    out = word
    for ending, least, instead in reversed(ENDINGS):
        fits = word.endswith(ending) & (F.length(word) >= least) & ~word.endswith("ss")
        out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(instead))).otherwise(out)
    return out


def terms(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(term, keys, n): occurrences of each token."""
    return docs.select(*keys, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", *keys).agg(F.count("*").alias("n"))


def forms(term: Column) -> Column:
    """Every word that ``stemmed`` can turn into the term, and some that it doesn't."""
    out = [term]
    for ending, _, instead in ENDINGS:
        out.append(F.when(term.endswith(instead), F.concat(F.substring(term, F.lit(1), F.length(term) - len(instead)), F.lit(ending))))
    return F.array_compact(F.array_distinct(F.array(*out)))


def lexemes(docs: DataFrame, keys: list[str], text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(term, keys, at): sorted positions, from 1, of each stemmed word outside the stop list.

    With ``wanted``, a small table (term), only words that can be forms of its terms are stemmed at all.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select(*keys, F.posexplode(words).alias("p", "word")).filter(~F.col("word").isin(STOP))
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted.select(F.explode(forms(F.col("term"))).alias("word")).distinct()), "word", "left_semi")
    return rows.groupBy(stemmed(F.col("word")).alias("term"), *keys).agg(F.sort_array(F.collect_list(F.col("p") + 1)).alias("at"))


_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, path: str, kind: str, make: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """The table that ``make`` makes of the Parquet files at ``path``, from disk if they haven't changed."""
    key = (kind, *files_state(spark, [path]))
    if key not in _stored:
        made = make(spark.read.parquet(path))
        _stored[key] = written(made.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys), f"postings-{kind}")
    return _stored[key]


def of_terms(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``postings`` whose term is among a stated set (column term), filtered in the scan."""
    listed = [r.term for r in wanted.select("term").distinct().limit(MOST_LISTED + 1).collect()]
    if len(listed) > MOST_LISTED:
        return postings.join(wanted.select("term").distinct(), "term", "left_semi")
    return postings.filter(F.col("term").isin(listed))
