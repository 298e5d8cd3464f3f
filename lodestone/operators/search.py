"""Full-text search over many queries at once, on the texts or on inverted tables (``postings``).

A search keeps the occurrences of the terms that some query asks for and shuffles no more than its
hits. Tokens are unstemmed runs of a-z and 0-9; cover density ranks stemmed words.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from . import postings as P

#: Weight of one occurrence, of pantry terms and of title terms.
WEIGHT, PANTRY_WEIGHT, TITLE_WEIGHT = 0.1, 0.25, 2.0
#: Rows that may be broadcast; parts of hits per partition of the texts.
BROADCAST_ROWS, SPREAD = 1_000_000, 8
#: Birds whose names also find "poultry".
POULTRY = ("chicken", "turkey", "duck", "goose")


def with_synonyms(queries: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(query_id, terms) -> (query_id, slot, n_slots, term): each term with its alternatives."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if synonyms else F.lit(None).cast("map<string,array<string>>")
    slots = queries.select("query_id", F.size("terms").alias("n_slots"), F.posexplode("terms").alias("slot", "own"))
    more = F.coalesce(F.try_element_at(table, F.col("own")), F.array().cast("array<string>"))
    return slots.select("query_id", "n_slots", "slot", F.explode(F.array_distinct(F.concat(F.array("own"), more))).alias("term"))


def hits(docs: DataFrame, queries: DataFrame, keys: list[str], text: str = "text", synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """``hits_in`` of documents that have no stored table: one pass over the texts that counts asked terms only."""
    return hits_in(P.terms(docs, keys, text), queries, keys, synonyms, docs)


def _dealt(rows: DataFrame, keys: list[str], source: DataFrame) -> DataFrame:
    """Rows by key in parts whose number grows with the input's, so that a task's groups don't."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD * source.rdd.getNumPartitions())
    return rows.repartition(parts, *keys)


def _small(df: DataFrame) -> DataFrame:
    """With a hint where a broadcast can hold the rows; a table from Python has no size that Spark knows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hits_in(postings: DataFrame, queries: DataFrame, keys: list[str], synonyms: dict[str, list[str]] | None = None, source: DataFrame | None = None) -> DataFrame:
    """Per query and document with any hit: matched (slots), n_slots, hits (occurrences), score.

    ``source`` is the table whose partitions tell how many parts hits are dealt to, ``postings`` where it is None."""
    wanted = with_synonyms(queries, synonyms or {})
    found = P.of_terms(postings, wanted).join(_small(wanted), "term").select("query_id", *keys, "slot", "n_slots", "n")
    # both groupings are by what the rows are dealt by
    slots = _dealt(found, ["query_id", *keys], postings if source is None else source).groupBy("query_id", *keys, "slot").agg(F.max("n_slots").alias("n_slots"), F.sum("n").alias("n"))
    return slots.groupBy("query_id", *keys).agg(
        F.count("*").alias("matched"), F.max("n_slots").cast("long").alias("n_slots"), F.sum("n").alias("hits")).withColumn("score", F.col("hits") * WEIGHT)


def all_then_any(found: DataFrame) -> DataFrame:
    """Documents with all terms; for queries without any such document, those with any term."""
    # one row per query; the hits' exchange is reused, no window gathers a frequent word's documents
    best = found.groupBy("query_id").agg(F.max((F.col("matched") == F.col("n_slots")).cast("int")).alias("all_"))
    out = found.join(best, "query_id")
    return out.filter((F.col("all_") == 0) | (F.col("matched") == F.col("n_slots"))).withColumn("match", F.when(F.col("all_") == 1, "all").otherwise("any")).drop("all_")


def only_all(found: DataFrame) -> DataFrame:
    return found.filter(F.col("matched") == F.col("n_slots"))


def top(found: DataFrame, keys: list[str], limit: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``limit`` per query by score (or ``order``), then key; rank from 1."""
    w = Window.partitionBy("query_id").orderBy(*(order or [F.desc("score")]), *keys)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


@pandas_udf(DoubleType())
def _density(places: pd.Series) -> pd.Series:
    """Per document, the sum over minimal covers of its terms' positions (one sorted list per term)."""
    def one(lists):
        n = len(lists)
        order = sorted((int(p), k) for k, at in enumerate(lists) for p in at)
        last, seen, total, previous = [0] * n, 0, 0.0, 0
        for p, k in order:
            seen += not last[k]
            last[k] = p
            if seen == n:
                lo = min(last)
                if lo > previous:  # a cover that starts later than the one before is a minimal one
                    total += WEIGHT / (1 + p - lo + 1 - n)
                    previous = lo
        return total

    return places.map(one)


def needed(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct stemmed words that a query needs."""
    words = queries.select("query_id", F.explode("terms").alias("word")).filter(~F.col("word").isin(P.STOP))
    return words.select("query_id", P.stemmed(F.col("word")).alias("term")).distinct()


def cover_density(lexemes: DataFrame, queries: DataFrame, keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """(query_id, keys, score) of the documents that hold all of a query's stemmed words.

    Sums over minimal covers 0.1 / (1 + words inside that aren't terms). A cover is a shortest
    run of positions that holds every term; a single term gives 0.1 per occurrence. Queries
    without a word outside the stop list find nothing. ``lexemes`` is an inverted table, stored or not; only
    documents that hold all words are ranked. ``source`` as for ``hits_in``.
    """
    needs = needed(queries)
    sizes = needs.groupBy("query_id").agg(F.count("*").alias("need"))
    # positions move once, to their document; queries meet them there
    found = _dealt(P.of_terms(lexemes, needs), keys, lexemes if source is None else source).join(_small(needs.join(sizes, "query_id")), "term")
    every = found.groupBy("query_id", *keys).agg(F.collect_list("at").alias("places"), F.first("need").alias("need")).filter("size(places) = need")
    return every.select("query_id", *keys, _density("places").alias("score"))
