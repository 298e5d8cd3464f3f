"""Phrases found by tries, and the food rules that stand on them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import food_rules as R
from lodestone.operators import phrases as P

WORDS = ["olive", "oil", "the", "of", "za'atar", "x", "y", "red", "ring", "é", "b", "half-and-half", "half", "zz", "olive-oil", "İx", "nut", "nuts", "nutes", "9"]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    gaps = [" ", " ", "  ", ", ", "\n", " \t "]
    return [(0, None), (1, ""), (2, "OIL"), *((i, "".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randrange(40)))) for i in range(3, n))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "id long, t string, phrase string, start int").repartition(4)


def vocabulary(spark, phrases, plural=False):
    return spark.createDataFrame([(k, p, plural) for k, p in enumerate(phrases)], "phrase_id long, phrase string, plural boolean")


PHRASES = ["olive oil", "oil", "the", "of the", "of the oil", "za'atar", "x y", "red ring", "ring of", "é b", "half-and-half", "half", "nut", " RED ", "", None, ".x", "x.", "oil"]


@pytest.mark.parametrize("plural,spaces,per_trie", [(False, "exact", 100), (True, "any", 3), (True, "exact", 4)])
def test_mentions_against_regular_expressions(spark, plural, spaces, per_trie):
    index = P.PhraseIndex.build(vocabulary(spark, PHRASES, plural), spaces, per_trie)
    got = P.mentions(frame(spark, texts()), index, ["id"], "t")
    assert got.columns == ["id", "phrase_id", "start", "length"]
    want = []
    for i, t in texts():
        low = (t or "").lower()
        for k, p in enumerate(PHRASES):
            p = (p or "").strip().lower()
            if not re.fullmatch(r"\w(.*\w)?", p):
                continue
            gap = r"\s+" if spaces == "any" else " "
            for end in ("", "s", "es") if plural else ("",):
                want += [(i, k, m.start(1) + 1, len(m[1])) for m in re.finditer(rf"(?=\b({gap.join(map(re.escape, p.split(' ')))}{end})\b)", low)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_longest_first_blanks_what_it_found(spark):
    named = sorted(p for p in set(PHRASES) if p and re.fullmatch(r"\w(.*\w)?", p))
    index = P.PhraseIndex.build(vocabulary(spark, named))
    got = {r.id: r.phrase_ids for r in P.longest_mentions(frame(spark, texts(7)), index, ["id"], "t").collect()}
    for i, t in texts(7):
        low, found = (t or "").lower(), []
        for k, p in sorted(enumerate(named), key=lambda x: (-len(x[1]), x[0])):
            m = re.search(rf"\b{re.escape(p)}\b", low)
            if m:
                found.append(k)
                low = low[: m.start()] + " " * len(p) + low[m.end() :]
        assert got[i] == sorted(found)
    index = P.PhraseIndex.build(vocabulary(spark, ["no olive", "oil", "olive oil"]))
    rows = [(1, "Contains no olive oil; add oil"), (2, "coil"), (3, "no. oil")]
    got = {r.id: r.phrase_ids for r in P.longest_mentions(frame(spark, rows), index, ["id"], "t").collect()}
    assert got == {1: [1, 2], 2: [], 3: [1]}


def test_fifty_thousand_phrases(spark):
    """As many phrases as a large vocabulary has; the plan does not grow with them."""
    rng = random.Random(3)
    phrases = sorted({" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 5))) for _ in range(52_000)})
    rows = [(i, " ".join(f"W{rng.randrange(3000)}" for _ in range(400))) for i in range(60)]
    index = P.PhraseIndex.build(vocabulary(spark, phrases), trie_phrases=20_000)
    assert len(index.parts) == 3
    found = P.mentions(frame(spark, rows), index, ["id"], "t")
    assert len(found._jdf.queryExecution().toString()) < 6000
    number = {p: k for k, p in enumerate(phrases)}
    want = []
    for i, t in rows:
        w = t.lower().split()
        want += [(i, number[g]) for n in range(1, 5) for j in range(len(w) - n + 1) if (g := " ".join(w[j : j + n])) in number]
    assert sorted((r.id, r.phrase_id) for r in found.collect()) == sorted(want) and len(want) > 1000


def test_no_phrases_and_no_texts(spark):
    nothing = P.PhraseIndex.build(vocabulary(spark, [None, ".."]))
    assert P.mentions(frame(spark, texts()), nothing, ["id"], "t").collect() == []
    assert P.mentions(frame(spark, []), P.PhraseIndex.build(vocabulary(spark, ["a"])), ["id"], "t").collect() == []
    with pytest.raises(ValueError):
        P.PhraseIndex.build(vocabulary(spark, ["a"]), "some")


def statuses(spark, check, lines):
    """label -> (status, terms, unverified terms) of a document of these lines."""
    df = spark.createDataFrame([(1, x) for x in lines] + [(2, None)], "doc long, line string")
    rows = check(df, ["doc"]).collect()
    assert {r.status for r in rows if r.doc == 2} <= {"no_listed_terms_found", "checked", "unresolved"}
    return {r.label: (r.status, r.terms, r["unverified_terms"] if "unverified_terms" in r else None) for r in rows if r.doc == 1}


#: label, line, status, term that says so
ALLERGY = [
    ("wheat/gluten", "2 cups Flour", "violated", "flour"), ("wheat/gluten", "rice flours", "no_listed_terms_found", None), ("wheat/gluten", "rice flour and bread", "violated", "bread"),
    ("wheat/gluten", "gluten-free bread", "no_listed_terms_found", None), ("wheat/gluten", "glutenfree bread", "no_listed_terms_found", None), ("wheat/gluten", "glass noodles", "no_listed_terms_found", None),
    ("wheat/gluten", "egg noodle", "violated", "noodle"), ("wheat/gluten", "corn  tortillas", "no_listed_terms_found", None), ("wheat/gluten", "soy  sauce", "violated", "soy sauce"),
    ("wheat/gluten", "tamari soy sauce", "no_listed_terms_found", None), ("wheat/gluten", "chicken stock cubes", "unverified", R.CUBES), ("wheat/gluten", "chicken stock", "no_listed_terms_found", None),
    ("wheat/gluten", "oat milk", "unverified", "oat"), ("wheat/gluten", "oat flour", "unverified", "oat"), ("tree nuts", "chopped nuts", "violated", "nut"), ("tree nuts", "doughnuts, nutmeg, coconut", "no_listed_terms_found", None),
    ("peanut", "chopped nuts", "unverified", "nut"), ("peanut", "peanuts", "violated", "peanut"), ("milk/dairy", "coconut milk", "no_listed_terms_found", None), ("milk/dairy", "coconut milk and milk", "violated", "milk"),
    ("milk/dairy", "cream of tartar", "no_listed_terms_found", None), ("milk/dairy", "ice cream", "violated", "cream"), ("egg", "custard", "unverified", "custard"), ("fish", "caesar dressing", "unverified", "caesar dressing"),
    ("shellfish", "XO sauce", "unverified", "xo sauce"), ("sesame", "za'atar", "unverified", "za'atar"), ("soy", "vegetable oil", "unverified", "vegetable oil"), ("fish", "fishes", "violated", "fish"),
]
OPTION = [
    ("vegetarian", "chicken stock", "violated", "chicken"), ("vegetarian", "chickens", "checked", None), ("vegetarian", "beef stock", "violated", "beef"), ("vegetarian", "stock", "unverified", "stock"),
    ("vegetarian", "vegetable stock", "checked", None), ("vegan", "almond milk", "checked", None), ("vegan", "milk", "violated", "milk"), ("vegetarian", "milk", "checked", None),
    ("vegetarian", "Comté", "unverified", "comté"), ("vegetarian", "vegetarian parmesan", "checked", None), ("vegan", "vegetarian parmesan", "violated", "parmesan"), ("vegan", "vegan broth", "checked", None),
]
DIET = [
    ("vegan", "chickens", "violated", "chicken"), ("vegan", "vegan chicken", "unresolved", None), ("vegan", "coconut milk and butter", "unresolved", None), ("vegetarian", "egg", "unresolved", None),
    ("gluten-free", "wheat flour", "violated", "wheat"), ("gluten-free", "gluten free flour", "unresolved", None), ("vegan", "honeys", "violated", "honey"),
]


def test_food_rules_line_by_line(spark):
    for check, rows in ((R.allergen_checks, ALLERGY), (R.option_checks, OPTION), (R.diet_checks, DIET)):
        df = spark.createDataFrame([(k, line) for k, (_, line, _, _) in enumerate(rows)], "doc long, line string")
        got = {(r.doc, r.label): r for r in check(df, ["doc"]).collect()}
        for k, (label, line, status, term) in enumerate(rows):
            r = got[k, label]
            said = r.terms if status == "violated" else r["unverified_terms"] if status == "unverified" else []
            assert (r.status, said) == (status, [term] if term else []), (label, line, r)


def test_a_document_collects_its_lines(spark):
    got = statuses(spark, R.allergen_checks, ["soy sauce", "soy sauce", "bread", "malt", "oat bread", None])
    assert got["wheat/gluten"] == ("violated", ["bread", "soy sauce"], ["malt"]) and got["soy"] == ("violated", ["soy"], []) and len(got) == 9
    assert got["egg"] == ("no_listed_terms_found", [], [])
    assert statuses(spark, R.diet_checks, ["Egg", "milk"])["vegan"][:2] == ("violated", ["egg", "milk"])
    assert R.allergen_checks(spark.createDataFrame([], "doc long, line string"), ["doc"]).collect() == []


def test_diet_names_and_claims(spark):
    names = [("Plant-Based", "vegan"), (" gluten  free", "gluten-free"), ("VEG", "vegetarian"), ("keto", None), (None, None), ("celiac", "gluten-free")]
    assert [r.d for r in spark.createDataFrame(names, "x string, y string").select(R.diet_name(F.col("x")).alias("d")).collect()] == [y for _, y in names]
    claims = [
        ("It is Peanut-free.", "peanut-FREE snack", "Peanut-free", True), ("tree nut free", None, "tree nut free", False), ("Safe for an allergy", "", "Safe for an allergy", False),
        ("carefree", "x", None, None), (None, None, None, None), ("glutenfree", "glutenfree", "glutenfree", True)]
    df = spark.createDataFrame([c[:2] for c in claims], "t string, s string").withColumn("c", R.free_claim(F.col("t"))).withColumn("a", R.claim_allowed(F.col("c"), F.col("s")))
    assert [(r.c, r.a) for r in df.collect()] == [c[2:] for c in claims]
