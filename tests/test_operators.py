"""Operators on edge tables that the shipped tables do not hold."""

import difflib
import json
import math
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import bounded, chunking, parsing, rational, requests, text
from lodestone.functions.manifest import Cache, canonical_hash, verify_frozen
from lodestone.operators import aggregate, evaluation, events, filters, ingest, joins, limits, postings, rules, search, validation, vectors


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_ceiling_admits_only_finite_positive_totals(spark):
    df = spark.createDataFrame([(1, 107.0), (2, None), (3, 0.0), (4, -5.0), (5, float("nan")), (6, 20.0), (7, float("inf"))], "id long, minutes double")
    assert rows(df.filter(filters.under_ceiling(F.col("minutes"), 60)).select("id")) == [(6,)]
    assert df.filter(filters.under_ceiling(F.col("minutes"), None)).count() == 7
    status = dict(rows(df.select("id", filters.total_status(F.col("minutes")))))
    assert status == {1: "reported", 2: "missing", 3: "reported_zero_unverified", 4: "negative", 5: "non_finite", 6: "reported", 7: "non_finite"}


def test_array_predicates_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, []), (3, None), (4, ["olive oil"])], "id long, names array<string>")
    n = F.col("names")
    assert rows(df.filter(filters.contains_all(n, ["a", "b"])).select("id")) == [(1,)]
    assert df.filter(filters.contains_all(n, [])).count() == 4 and df.filter(filters.contains_any(n, [])).count() == 0
    assert rows(df.filter(filters.contains_any(n, ["oil", "olive oil"])).select("id")) == [(4,)]
    first = df.filter("id = 1")
    assert first.select(filters.overlap_count(n, ["a"]), filters.overlap_set(n, ["a"])).first() == (2, 1)


def test_arguments_are_checked():
    for bad in ((" ", 5, None), ("q", 0, None), ("q", 51, None), ("q", 5, float("nan")), ("q", 5, -1)):
        with pytest.raises(ValueError):
            filters.check_search(*bad)
    filters.check_search("q", 50, 10.0)
    with pytest.raises(ValueError):
        vectors.check_vector([1.0, float("inf")], 2)
    with pytest.raises(ValueError):
        limits.ranged(F.lit(None), 3, 3)


def test_cutoff_is_finite_and_keeps_order(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.66), (3, 0.7), (4, float("nan")), (5, None)], "id long, distance double")
    assert rows(filters.within_cutoff(df, 0.66).select("id")) == [(1,), (2,)]
    assert filters.within_cutoff(df, None).count() == 5
    with pytest.raises(ValueError):
        filters.within_cutoff(df, float("inf"))
    with pytest.raises(ValueError):
        filters.in_dataset(df, "nowhere", ("a",))


def test_pattern_signs_are_literal(spark):
    df = spark.createDataFrame([("100% rye bread",), ("1000 rye bread",)], "title string")
    assert df.filter(filters.ordered_pattern(F.col("title"), F.array(F.lit("100%"), F.lit("rye")))).count() == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9999), st.integers(1, 9999)), min_size=1, max_size=8))
def test_rationals_are_exact(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a long, b long")
    q = rational.reduced(F.col("a"), F.col("b"))
    half = rational.reduced(F.lit(1), F.lit(2))
    got = df.select("i", q.alias("q"), rational.times(q, half).alias("t"), rational.over(q, half).alias("o")).collect()
    for r in got:
        f = Fraction(*pairs[r.i])
        assert (Fraction(r.q.num, r.q.den), Fraction(r.t.num, r.t.den), Fraction(r.o.num, r.o.den)) == (f, f / 2, f * 2)
        assert math.gcd(r.q.num, r.q.den) == 1


def test_rational_overflow_is_null_and_conversion_refuses(spark):
    big = rational.reduced(F.lit(2**62), F.lit(1))
    df = spark.range(1).select(
        rational.times(big, big).alias("t"), rational.convert(rational.reduced(F.lit(1), F.lit(1)), F.lit("lb"), F.lit("oz")).alias("c"),
        rational.convert(big, F.lit("cup"), F.lit("g")).alias("r"), rational.convert(big, F.lit("pinch"), F.lit("g")).alias("u"),
        rational.convert(rational.reduced(F.lit(3), F.lit(1)), F.lit(""), F.lit(None).cast("string")).alias("n"))
    r = df.first()
    assert r.t is None and (r.c.amount.num, r.c.amount.den) == (16, 1)
    assert (r.r.amount, r.r.refusal, r.u.refusal) == (None, "different_dimension", "unknown_unit") and r.n.amount.num == 3


def test_written_lines(spark):
    df = spark.createDataFrame([('c("eggs", "olive oil")',), ("character(0)",), ('c("egg",)',), ('c("a" "b")',), ("eggs",), (None,)], "x string")
    assert [r[0] for r in df.select(parsing.r_vector("x")).collect()] == [["eggs", "olive oil"], [], None, None, ["eggs"], None]
    line = spark.createDataFrame([("1 1/2 - 2 cups flour, sifted",), ("salt to taste",), ("",), (None,)], "x string").select(parsing.ingredient_line(F.col("x")).alias("i"))
    got = [r.i for r in line.collect()]
    assert (got[0].amount, got[0].amount_high, got[0].unit, got[0].item, got[0].preparation, got[0].is_range) == ("1 1/2", "2", "cup", "flour", "sifted", True)
    assert got[1].qualitative and got[1].amount is None and got[2].item is None and got[3].item is None


def test_nearest_mention_takes_the_amount(spark):
    df = spark.createDataFrame([("add 2 cups flour and 3 eggs", ["flour", "eggs"]), ("nothing", ["flour"]), (None, None)], "t string, i array<string>")
    got = [[(a.amount, a.item) for a in r[0]] for r in df.select(parsing.attributed_amounts("t", "i")).collect()]
    assert got == [[("2", "flour"), ("3", "eggs")], [], []]


def test_text_helpers(spark):
    r = spark.range(1).select(
        text.canonical(F.lit("  ＡＢ\tStraße ")).alias("c"), text.scrubbed(F.lit("write a@b.org, call +1 555 123 4567 for my Bo Derek at 12 Long Oak rd.; my name is Bo")).alias("s"), text.url_key(F.lit("https://www.A.org/x/?q#f")).alias("u"),
        text.within_domain(F.lit("notexample.org"), "example.org").alias("w"), text.ascii_fractions(F.lit("1½ cups")).alias("f"), text.singular(F.lit("berries")).alias("g")).first()
    assert tuple(r) == ("ab strasse", "write [redacted-email], call [redacted-phone] for my [redacted-name] at [redacted-address]; my name is Bo", "a.org/x", False, "1 1/2 cups", "berry")


HTML = """<html><nav>menu<p>in</p></nav><div class="site-toc">buy<img></div><header class="row content-header"><h1>Title</h1><p>First <b>bold</b>.</p></header>
<p>lost <p>Bake at 180<sup>o</sup>C, 160&deg;F<br>or x<sup>2</sup></p>loose text
<table><tr><td>layout</td></tr></table><h2>Times</h2><table><caption>How long</caption><tr><th>Cut</th><th>Min</th></tr><tr><td>thin</td><td></td><td>5</td></tr></table>
<script>var x="</p>";</script><p id="mw-editsection-1">edit</p><h2>Works cited</h2><p>gone</p><table><tr><th>gone</th></tr></table><h3>Last &amp;amp; least</h3><ul><li>end</ul></html>"""


def test_html_keeps_what_is_content():
    title, whole = chunking.page_text(HTML)
    assert title == "Title" and whole.startswith("## Title\n\nFirst bold.")
    assert chunking.sections_of(HTML) == [
        ("Title", "First bold.\n\nBake at 180 °C, 160 °F or x2"), ("Times", "How long\n\nCut | Min\n\nthin | 5")]
    assert "## Last & least" in whole  # a heading without closed text is a section without text
    assert chunking.sections_of(None) == [] and chunking.sections_of("plain") == []
    assert chunking.sections_of("<h2>A</h2><p>one<h3>B</h3><li>two</li>") == [("A", "one"), ("B", "two")]


def test_sections_and_sentences_by_hand():
    assert chunking.marked_sections("lead\n  ## One \nx\n##no\n## Two\n\n### deep") == [("", "lead"), ("One", "x\n##no"), ("Two", "### deep")]
    long = " ".join(["Word" * 5 + "."] * 8)  # 8 sentences of 21 characters, 5 tokens each
    assert chunking.chunks_of("short one\n \n" + long, 12) == ["short one\n\n" + "Word" * 5 + "."] + ["\n\n".join(["Word" * 5 + "."] * 2)] * 3 + ["Word" * 5 + "."]
    assert chunking.chunks_of("aaaa. bbbb. cccc", 2) == ["aaaa. bb", "bb. cccc"]  # a sentence starts with a capital or a digit
    assert chunking.chunks_of("x" * 41 + "\n\ny", 5) == ["x" * 20, "x" * 20, "x\n\ny"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abA .\n", max_size=300), max_size=6), st.integers(3, 40))
def test_chunks_fit_and_lose_nothing(parts, most):
    whole = "\n\n".join(parts)
    chunks = chunking.chunks_of(whole, most)
    for c in chunks[: len(chunks) if len(chunks) > 1 else 0]:
        pieces = c.split("\n\n")
        assert sum(map(chunking.estimated, pieces)) + len(pieces) - 1 <= most or len(pieces) == 1
    assert "".join("".join(chunks).split()) == "".join(whole.split())


def test_bounded_json_is_valid_and_short(spark):
    df = spark.createDataFrame([(1, 'say "hi" \n', ["a", 'b"', None, "x" * 30]), (None, None, None), (2, "y" * 200, ["z" * 99, "k"])], "a long, b string, c array<string>")
    fields = {"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}
    for limit in (20, 40, 60, 90, 2000):
        for r in df.select("a", "b", "c", bounded.bounded_object(fields, limit).alias("j"), bounded.bounded_items(F.col("c"), limit).alias("i")).collect():
            got, whole = json.loads(r.j), {"a": r.a, "b": r.b, "c": r.c}
            assert len(r.j) <= limit or got == {"_truncated": 3}
            assert got == whole or got.pop("_truncated") == 3 - len(got) and all(whole[k] == v for k, v in got.items())
            items = json.loads(r.i.json)
            assert len(r.i.json) <= limit and items == (r.c or [])[: len(items)] and r.i.dropped == len(r.c or []) - len(items)
            assert not r.i.dropped or len(json.dumps(r.c[: len(items) + 1])) > limit
    assert [r.j for r in df.select(bounded.bounded_object(fields).alias("j")).collect()][1] == '{"a": null, "b": null, "c": null}'


def test_mentions_terms_and_suggestions(spark):
    texts = [(1, "Contains no olive oil; add oil"), (2, "without any of the oil"), (3, "oil"), (4, "no. oil"), (5, None), (6, "no a b c d e f g h oil"), (7, "coil")]
    df = spark.createDataFrame(texts, "id long, t string")
    assert [r.n for r in df.select("id", parsing.negated(F.col("t"), "oil").alias("n")).orderBy("id").collect()] == [False, True, False, False, False, False, False]
    names = [f"name{i}" for i in range(30)] + ["red bolt", "bolt", "a bolt", "thunderbolts are loud things"]
    asked = [(1, "bolt"), (2, "name1"), (3, "zzz"), (4, "")]
    got = {r.id: r.suggestions for r in parsing.suggestions(spark.createDataFrame([(n,) for n in names], "name string").repartition(3), asked).collect()}
    for i, term in asked:
        close = difflib.get_close_matches(term, sorted(names), 8, 0.6) if term else []
        rest = [n for n in sorted(names) if n not in close and term and (term in n or n in term)]
        assert got[i] == [*close, *rest][:8]


def test_requests_as_columns(spark):
    long = "x" * 250
    data = [(" soup  of day ", ["a", " ", "b"], "30"), ("", ["p1", "p2", "p3", "p4", "p5", "p6"], "soon"), (None, None, "nan"), (long, [long], "1441")]
    df = spark.createDataFrame(data, "dish string, pantry array<string>, minutes string")
    for row, (dish, pantry, minutes) in zip(df.select(requests.search_columns(F.col("dish"), F.col("pantry"), F.col("minutes")).alias("a")).collect(), data):
        want = requests.search_arguments({"dish": dish, "pantry": pantry, "time_minutes": minutes})
        assert (row.a.query, row.a.by_overlap, tuple(row.a.hints), row.a.max_minutes, tuple(row.a.changes)) == (want.query, want.by_overlap, want.pantry, want.max_minutes, want.changes)
    cases = [(a, b) for a in ("vector", "fulltext", "hybrid", None) for b in ("vector", "odd", None)]
    got = spark.createDataFrame(cases, "a string, b string").select("a", "b", requests.mode_columns(F.col("a"), F.col("b")).alias("m")).collect()
    assert all((r.m.mode, r.m.source) == requests.mode(r.a, r.b) for r in got)
    args = [(" ", 5, None), ("q", 0, None), ("q", 51, None), ("q", 5, float("nan")), ("q", 5, -1.0), ("q", 50, 10.0), (None, 5, None)]
    bad = spark.createDataFrame(args, "q string, n int, m double").select(filters.search_problem(F.col("q"), F.col("n"), F.col("m"))).collect()
    assert [r[0] for r in bad] == ["query_or_limit"] * 3 + ["max_minutes"] * 2 + [None, "query_or_limit"]


def test_chunks_do_not_cross_sections(spark):
    doc = "intro\n## One\n" + "word " * 900 + "\n## Two\nshort"
    got = rows(chunking.chunked(spark.createDataFrame([(1, doc), (2, None)], "id long, t string"), "id", "t").select("id", "chunk_id", "section", "tokens"))
    assert [g[1] for g in got] == list(range(len(got))) and {g[2] for g in got} == {"", "One", "Two"} and all(g[3] <= 800 for g in got)


def test_search_falls_back_only_on_empty(spark):
    docs = spark.createDataFrame([(1, "red bolt red"), (2, "red nut"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["red", "bolt"]), (2, ["nut", "gear"]), (3, ["none"]), (4, [])], "query_id long, terms array<string>")
    found = search.all_then_any(search.hits(docs, q, ["doc_id"]))
    assert rows(found.select("query_id", "doc_id", "hits", "match")) == [(1, 1, 3, "all"), (2, 2, 1, "any")]


def test_cover_density_against_all_windows(spark):
    texts = [(1, "red bolts here"), (2, "red and big old bolts"), (3, "red red"), (4, None), (5, "bolt red x bolting y y red bolts"), (6, "Éclair bolts, éclair"), (7, "a red a a bolt")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    asked = [(1, ["red", "bolt"]), (2, ["red"]), (3, ["the", "of"]), (4, ["éclair", "bolts", "bolt"]), (5, [])]
    got = {(r.query_id, r.id): r.score for r in search.cover_density(postings.lexemes(df, ["id"], "t"), spark.createDataFrame(asked, "query_id long, terms array<string>"), ["id"]).collect()}
    stem = lambda w: {"bolts": "bolt", "bolting": "bolt"}.get(w, w)
    want = {}
    for q, terms in asked:
        need = {stem(t) for t in terms if t not in postings.STOP}
        for i, t in texts:
            w = [stem(x) for x in re.findall(r"\w+", (t or "").lower())]
            holds = [(a, b) for a in range(len(w)) for b in range(a, len(w)) if need and need <= set(w[a : b + 1])]
            least = [(a, b) for a, b in holds if not any((c, e) != (a, b) and a <= c and e <= b for c, e in holds)]
            if least:
                want[q, i] = sum(0.1 / (1 + b - a + 1 - len(need)) for a, b in least)
    assert got == pytest.approx(want) and (1, 2) in got and (3, 1) not in got


def test_stored_postings_follow_the_files(spark, tmp_path):
    path = f"{tmp_path}/d.parquet"
    made = lambda: {r.term: r.n for r in postings.stored(spark, path, "terms", lambda d: postings.terms(d, ["id"], "t"), ["id"]).collect()}
    spark.createDataFrame([(1, "a b a")], "id long, t string").write.parquet(path)
    assert made() == {"a": 2, "b": 1} and made() == {"a": 2, "b": 1}
    spark.createDataFrame([(1, "c")], "id long, t string").write.mode("overwrite").parquet(path)
    assert made() == {"c": 1}


def test_fusion_and_neighbours_break_ties_by_key(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, k long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "query_id long, k long, rank long")
    assert [r.k for r in vectors.rrf([a, b], ["k"], 5).orderBy("rank").collect()] == [10, 11]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert rows(vectors.neighbours(v, v.filter("id = 1"), "id", 2).select("id", "rank")) == [(2, 1), (3, 2)]


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 2, 2), ("a", 3, 3, None), ("b", 4, 1, None)], "case_id string, doc_id long, rank int, grade int")
    relevant = spark.createDataFrame([("a", 2), ("a", 9)], "case_id string, doc_id long")
    assert rows(evaluation.recall_at(ranking, relevant, 5)) == [("a", 0.5, 2)]
    assert rows(evaluation.reciprocal_rank(ranking, 5)) == [("a", 0.5), ("b", 0.0)]
    got = {r.case_id: r.ndcg for r in evaluation.ndcg(ranking).collect()}
    assert got["a"] == pytest.approx(1 / math.log2(3)) and got["b"] == 0


def test_compare_and_set_folds_in_order(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 5)], "session_id long, seq long, expected long")
    assert rows(events.cas(df)) == [(1, 1, True, 1), (1, 2, False, 1), (1, 3, True, 2), (2, 1, False, 0)]


def test_budgets_skip_or_stop(spark):
    r = spark.range(1).select(limits.greedy_fit(F.array(*[F.lit(x).cast("long") for x in (5, 9, 4)]), 10).alias("g"), limits.next_fit(F.array(*[F.lit(x).cast("long") for x in (5, 9, 4)]), 9, 10).alias("n")).first()
    assert (r.g.used, r.g.kept, r.n.batches) == (9, [True, False, True], 3)
    tail = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 5, 50))], "g long, o long, n long")
    assert rows(limits.tail_budget(tail, "g", "o", "n", 20).select("o")) == [(2,)]


def test_numbered_over_partitions(spark):
    df = spark.range(0, 999, 3).repartition(7)
    got = rows(limits.numbered(df, "id"))
    assert got == [(i * 3, i + 1) for i in range(333)]


def test_duplicates_and_aliases(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "z", 4)], "id string, t string, n int")
    assert dict(rows(aggregate.duplicate_status(df, "id", F.col("t"), ["n"]).filter("n <> 2").select("id", "status"))) == {"a": "accepted", "b": "duplicate_content", "c": "accepted"}
    assert ("b", "a") in rows(aggregate.exact_sources(df.filter("n <> 2"), "id", "t").select("member", "canonical"))


def test_fingerprint_sees_one_changed_value(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "k long, v string")
    f = lambda d: aggregate.table_fingerprint(d, ["k"], ["k", "v"]).first().fingerprint
    assert f(df) == f(df.repartition(5)) != f(df.withColumn("v", F.when(F.col("k") == 7, None).otherwise(F.col("v"))))


def test_rerun_writes_nothing(spark):
    stored = spark.createDataFrame([(1, "h1"), (2, "h2")], "id long, h string")
    new = spark.createDataFrame([(1, "h1"), (2, "new"), (3, "h3")], "id long, h string")
    delta = ingest.changed(stored, new, "id", "h")
    assert rows(delta.select("id")) == [(2,), (3,)]
    after = ingest.upserted(stored, delta.select("id", "h"), ["id"])
    assert rows(after) == [(1, "h1"), (2, "new"), (3, "h3")] and ingest.changed(after, new, "id", "h").count() == 0


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿RecipeId,Name\n000038,"Egg\nbowl"\n', encoding="utf-8")
    assert rows(ingest.read_csv(spark, str(path), ["RecipeId", "Name"])) == [("000038", "Egg\nbowl")]
    with pytest.raises(ValueError):
        ingest.read_csv(spark, str(path), ["Missing"])
    path.write_text("RecipeId,Name\n1,a,b\n", encoding="utf-8")
    with pytest.raises(Exception):
        ingest.read_csv(spark, str(path), ["RecipeId", "Name"]).collect()


def test_jsonl_splits_at_newlines_only(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"t": "a b"}\nnot json\n\n', encoding="utf-8")
    got = ingest.read_jsonl(spark, str(path), "t string").select("record.t").collect()
    assert [r.t for r in got] == ["a b", None]


def test_diets_never_call_no_hit_safe(spark):
    r = spark.createDataFrame([("d", "1", ["red bolts"]), ("d", "2", ["red ring"]), ("d", "3", ["free red cup"]), ("d", "4", [])], "dataset_id string, source_id string, names array<string>")
    got = {x.source_id: x.verdict for x in rules.diet_verdicts(r, rules.diet_rules(spark)).filter("diet = 'red_free'").collect()}
    assert got == {"1": "violated", "2": "unresolved", "3": "unresolved", "4": "unresolved"}


def test_reconciliation(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    res = spark.createDataFrame([("a", 1, 1, "ok"), ("a", 2, 1, "ok"), ("b", 1, 2, "bad"), ("z", 1, 3, "ok")], "custom_id string, file int, line int, status string")
    assert rows(joins.reconciled(asked, res).select("custom_id", "outcome")) == [("a", "duplicate"), ("a", "ok"), ("b", "failed"), ("c", "missing"), ("z", "unknown")]


def test_manifests(tmp_path):
    assert canonical_hash({"a": 1, "b": [2]}) == canonical_hash({"b": [2], "a": 1})
    assert verify_frozen({"x": 1}, {"x": canonical_hash(1), "y": "0"}) == ["y"]
    cache = Cache(str(tmp_path), {"v": "1"})
    assert cache.read("k") is None
    cache.write("k", [1])
    assert cache.read("k") == [1] and Cache(str(tmp_path), {"v": "2"}).read("k") is None


def test_streams_over_several_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    from lodestone.streaming import sessions

    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", 1.0, "{}") for i in range(60)]
    for k in range(3):
        spark.createDataFrame(data[k * 20 : k * 20 + 20], sessions.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = lambda: sessions.read_events(spark, f"{tmp_path}/in/*", "*.parquet", 1)
    seq = sessions.run(sessions.numbered(read()), f"{tmp_path}/seq").collect()
    for s in range(3):
        assert sorted(r.seq for r in seq if r.session_id == s) == list(range(1, 21))
    granted = sessions.run(sessions.claims(read(), 5), f"{tmp_path}/claims").collect()
    assert sum(r.granted for r in granted) == 15 and len(granted) == 60
    days = sessions.run(sessions.windowed(read(), "1 hour"), f"{tmp_path}/win", "complete")
    assert sum(r.n for r in days.collect()) == 60


def test_request_to_search():
    a = requests.search_arguments({"dish": "  Egg   bowl ", "pantry": list("abcdefg"), "time_minutes": "30", "cuisine": "thai"}, "d1")
    assert (a.query, a.by_overlap, a.pantry, a.max_minutes, a.unenforced, a.changes) == ("Egg bowl", False, tuple("abcde"), 30.0, ("cuisine",), ("pantry_capped",))
    b = requests.search_arguments({"pantry": ["rice", " "], "time_minutes": True})
    assert (b.query, b.by_overlap, b.max_minutes, b.has_keys) == ("rice", True, None, True) and not requests.search_arguments({}).has_keys
    assert requests.mode("vector") == ("vector", "explicit") and requests.mode(None, "bad") == ("fulltext", "default") and requests.cutoff("x") == 0.66


def test_interpreted_lines_are_checked(spark):
    base = {"expected_record": "a", "hash": "h", "expected_hash": "h", "line": "2 cups flour", "excerpt": "flour", "name": "flour", "amount_text": "2", "amount_value": "2", "unit": "cups", "is_range": False, "uncertain": False}
    cases = [
        ({}, set()), ({"expected_record": "b"}, {"identity_mismatch"}), ({"excerpt": "sugar"}, {"fabricated_evidence"}), ({"line": None}, {"evidence_unknown_line"}),
        ({"excerpt": " "}, {"missing_evidence"}), ({"amount_value": "3"}, {"amount_inconsistent"}), ({"amount_value": None}, {"quantity_unresolved"}),
        ({"amount_value": None, "is_range": True}, {"quantity_uncertain"}), ({"unit": "glug"}, {"unsupported_unit"}), ({"name": "2 flour"}, {"name_contains_measure"}), ({"name": "2 % milk"}, set()),
        ({"amount_value": "x"}, {"malformed_amount"}),
    ]
    schema = "record string, position int, expected_record string, hash string, expected_hash string, line string, excerpt string, name string, amount_text string, amount_value string, unit string, is_range boolean, uncertain boolean"
    df = spark.createDataFrame([("a", i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    got = {i: set() for i in range(len(cases))}
    for r in validation.problems(df).collect():
        got[r.position].add(r.code)
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert validation.verdicts(df).first().verdict == "rejected"


def test_cover_density_ranks_every_case(spark, tmp_path):
    from lodestone.plans.search import fts06b

    spark.createDataFrame([(i, f"term{i}") for i in range(2100)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "term0 x term999"), (2, "term1000 term2099 y term2099"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in fts06b(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 0.1), (999, 1, 0.1), (1000, 2, 0.1), (2099, 2, 0.2)]


def test_query_vectors_beyond_one_block(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(30)], "vec_id long, v array<double>")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = rows(vectors.scored(v, asked).withColumn("distance", F.round("distance", 9)), "vec_id", "query_id")
    assert len(want) == 900
    monkeypatch.setattr(vectors, "MOST_QUERIES", 7)
    monkeypatch.setattr(vectors, "MOST_SCORES", 20)
    assert rows(vectors.scored(v, asked).withColumn("distance", F.round("distance", 9)), "vec_id", "query_id") == want
    assert vectors.scored(v, asked.limit(0)).count() == 0


def test_best_rows_of_tasks_hold_the_best_of_all(spark):
    data = [(i, i % 3, [float((i * 7) % 11), float((i * 5) % 4), 1.0]) for i in range(200)] + [(200, 0, None), (201, 1, [0.0, 0.0, 0.0]), (202, 2, [1.0])]
    v = spark.createDataFrame(data, "k long, g long, v array<double>").repartition(5)
    asked = v.filter("k % 40 = 0 and v is not null").select(F.col("k").alias("query_id"), F.col("v").alias("q"), "g")
    every = vectors.scored(v, asked).withColumn("distance", F.round("distance", 9)).collect()
    for best, within in ((4, None), (3, "g")):
        got = vectors.scored(v, asked, best=best, within=within).withColumn("distance", F.round("distance", 9)).collect()
        for q in {r.query_id for r in every}:
            own = sorted((r.distance, r.k) for r in every if r.query_id == q and (not within or r.g == q % 3))[:best]
            assert sorted((r.distance, r.k) for r in got if r.query_id == q)[:best] == own
        assert len(got) < len(every)
    near = vectors.scored(v, asked, cutoff=0.1).collect()
    assert len(near) == sum(r.distance <= 0.1 for r in every)
    owners = {(r.query_id, r.g): (round(r.distance, 9), r.chunks) for r in vectors.owner_distances(v.select("g", "v", F.lit(0).cast("long").alias("overlap")), asked, ["g"]).collect()}
    assert owners == {(q, g): (min(r.distance for r in every if (r.query_id, r.g) == (q, g)), sum((r.query_id, r.g) == (q, g) for r in every)) for q, g in {(r.query_id, r.g) for r in every}}


def test_stalls_keep_one_state_per_session(spark, tmp_path):
    import datetime

    from lodestone.streaming import sessions

    day = lambda d, h=0: datetime.datetime(2024, 1, 1, h) + datetime.timedelta(days=d)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    files = [
        [(1, day(0), 1, "a", 0.0, "x"), (2, day(0, 1), 1, "a", 0.0, None), (3, day(1), 1, "a", 0.0, "x"), (4, day(1), 2, "a", 0.0, "x")],
        [(5, day(2), 1, "a", 0.0, "x"), (6, day(2), 1, "a", 0.0, None), (7, day(3), 1, "b", 0.0, "x"), (8, day(3), 1, "a", 0.0, None)],
        [(9, day(80), 3, "a", 0.0, "x"), (10, day(80), 1, "b", 0.0, "x")],
        # calls that come again at once go on; the others of session 1 are forgotten here
        [(11, day(81), 1, "b", 0.0, "x"), (12, day(81), 2, "a", 0.0, "x"), (13, day(82), 2, "a", 0.0, "x")],
        [(14, day(83), 1, "a", 0.0, "x"), (15, day(83, 1), 1, "a", 0.0, "x"), (16, day(83, 2), 1, "a", 0.0, "x")],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = sessions.stalls(sessions.read_events(spark, f"{tmp_path}/in", "*.parquet", 1))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "[user_id#" in plan.split("FlatMapGroupsInPandasWithState")[1].split("\n")[0].replace("['user_id", "[user_id#")
    got = {(r.session_id, r.event_id) for r in sessions.run(found, f"{tmp_path}/out").collect()}
    assert got == {(1, 5), (1, 8), (1, 11), (2, 13), (1, 16)}


def test_steps_lose_spaces_at_their_ends_and_no_digits(spark):
    from lodestone.operators import ingest

    docs = spark.createDataFrame([(1, "s", "0 eggs 0\n 1 cup\n\n 2")], "doc_id long, source string, text string")
    assert [i.text for i in ingest.normalised(docs).first().document.instructions] == ["0 eggs 0", "1 cup", "2"]


def test_cut_entities_are_replaced_as_in_html(spark, tmp_path):
    """The query and its SQL, on entities whose semicolon is missing."""
    import duckdb

    from lodestone.catalog import oracle_sql, queries

    pages = [(1, "<article><h1>a&amp;&amp</h1><p>x &lt y &amp;amp; &gt;&quot z &#39;q&#39; &amp</p></article>"), (2, "<article><h1>b</h1><p>&amp;lt; &amplt; &#39</p><p>&amp;&amp;&amp;</p></article>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries()["htm01_html_sections"](spark, str(tmp_path)).orderBy("page_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({oracle_sql()['htm01_html_sections']}) ORDER BY page_id").fetchall()
    assert got == want and got[0][1] == "a&&"
