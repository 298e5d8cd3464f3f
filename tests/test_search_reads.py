"""Searches count asked terms in the texts: what they shuffle follows the hits, not the vocabulary."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, search


def test_no_more_than_hits_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(postings, "stored", None)  # a search builds no table
    docs = spark.createDataFrame([(i, f"the w{i} and w{i + 1} The thing") for i in range(50)] + [(7, "thing"), (60, None)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, ["the", "w3"]), (2, ["thing"])], "query_id long, terms array<string>")
    found = search.hits(docs, queries, ["doc_id"])
    got = {(r.query_id, r.doc_id): (r.matched, r.n_slots, r.hits) for r in found.collect()}
    want = {(1, i): (1 + (i in (2, 3)), 2, 2 + (i in (2, 3))) for i in range(50)} | {(2, i): (1, 1, 1 + (i == 7)) for i in range(50)}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "ObjectHashAggregate" not in plan
    assert found.rdd.getNumPartitions() >= 3 * search.SPREAD  # parts follow the input


def test_alternatives_and_many_terms(spark):
    docs = spark.createDataFrame([(i, f"t{i} t{i + 1} t{i}") for i in range(1500)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}"]) for i in range(1200)], "query_id long, terms array<string>")
    found = search.only_all(search.hits(docs, queries, ["doc_id"]))
    assert {(r.query_id, r.doc_id, r.hits) for r in found.collect()} == {(i, i, 3) for i in range(1200)}
    two = search.hits(docs.limit(3), spark.createDataFrame([(1, ["t0"])], "query_id long, terms array<string>"), ["doc_id"], synonyms={"t0": ["t1", "t9"]})
    assert {(r.doc_id, r.matched, r.hits) for r in two.collect()} == {(0, 1, 3), (1, 1, 2)}


@pytest.mark.parametrize("word", ["cities", "classes", "cooking", "cooked", "reportedly", "quickly", "boxes", "cats", "glass", "ring", "ies", "sses", "bed"])
def test_forms_hold_every_word_of_a_stem(spark, word):
    row = spark.createDataFrame([(word,)], "w string").select(postings.stemmed(F.col("w")).alias("t")).select(postings.forms(F.col("t")).alias("f")).first()
    assert word in row.f
