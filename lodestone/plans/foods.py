"""Queries: phrases found in texts by tries, and food rules over ingredient lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import food_rules as R
from ..operators import phrases as P
from ..sources.tables import table

#: Food as sources write it; a line of an order is one of these behind its quantity.
FOODS = [
    "large eggs", "cups all-purpose flour", "cups rice flour", "cups Almond  Flour, sifted", "tbsp oat flour", "gluten-free bread slices", "cans coconut milk", "cups milk",
    "tbsp peanut butter", "oz butter, melted", "chicken breasts", "vegetable broth cubes", "cups chicken stock", "stock cubes", "cups beef broth", "tsp worcestershire sauce",
    "oz Parmesan", "oz gruyère", "oz vegetarian parmesan", "Brazil nuts", "chopped nuts", "pine  nut", "doughnuts", "butternut squash", "tsp nutmeg", "tbsp fish sauce",
    "tbsp oyster sauce", "tbsp tamari soy sauce", "tbsp soy sauce", "rice noodles", "egg noodles", "corn tortillas", "flour tortillas", "cups oatmeal", "cups oat milk",
    "tbsp za'atar", "tsp furikake", "tbsp tahini", "shrimps", "cod fillets", "anchovies", "cups vanilla custard", "scoops ice cream", "tsp cream of tartar",
    "bottles beer", "tbsp caesar dressing", "cups seafood stock", "tbsp XO sauce", "cups vegetable oil", "tsp soy lecithin", "oz vegan cheese", "dairy-free yogurt", "tsp honey",
    "ham-free sausages", "tsp gelatin", "carrots", "onions, chopped", "", "comté wheels", "hens", "meat balls", "bouillon with vegan butter",
]
_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in FOODS) + "]"
LINES_SQL = f"""food_lines AS (SELECT l_orderkey AS okey, CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' || {_LIST}[1 + (l_partkey * 7 + l_linenumber) % {len(FOODS)}] AS line FROM lineitem)"""


def food_lines(spark, d):
    """(okey, line): one ingredient line per line of an order."""
    place = ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(FOODS) + 1).cast("int")
    food = F.element_at(F.array(*map(F.lit, FOODS)), place)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("okey"), F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), food).alias("line"))


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _rules_sql(rules: list[tuple], exemptions: list[tuple], no_hit: str) -> str:
    """The rules evaluated by looking for each term, between blanks, in distinct lines whose marks are blanks."""
    rows = ", ".join(f"({_text(label)}, '{tier}', {place}, {_text(term)}, {str(plural).lower()}, '{form}')" for label, tier, place, term, plural, form in rules)
    excuses = ", ".join(f"({_text(label)}, {_text(term)}, '{tier}', {_text(p)})" for label, term, tier, p in exemptions)
    scrubbed = "lower(line)"
    for p in R.NON_DAIRY:
        scrubbed = f"regexp_replace({scrubbed}, {_text(p)}, ' ', 'g')"
    bare = lambda text, kept: f"' ' || regexp_replace({text}, '[^{kept}]+', ' ', 'g') || ' '"
    forms = {"line": bare("lower(line)", "a-z0-9é''"), "words": bare("lower(line)", "a-z0-9"), "line_scrubbed": bare(scrubbed, "a-z0-9éè''"), "words_scrubbed": bare(scrubbed, "a-z0-9")}
    texts = " UNION ALL ".join(f"SELECT line, '{f}' AS form, {sql} AS text FROM dl" for f, sql in forms.items())
    cube = "wheat/gluten" in {r[0] for r in rules}
    cubes = f"""UNION ALL SELECT line, 'wheat/gluten', 'unverified', 999, '{R.CUBES}' FROM dl WHERE regexp_matches(lower(line), '\\bcube(?:s|es)?\\b') AND regexp_matches(lower(line), '\\b(?:stock|broth)(?:s|es)?\\b')""" if cube else ""
    return f"""WITH {LINES_SQL}, dl AS (SELECT DISTINCT line FROM food_lines), texts AS ({texts}),
rules(label, tier, place, term, plural, form) AS (VALUES {rows}), ex(label, term, tier, pattern) AS (VALUES {excuses}),
hits AS (SELECT line, r.label, r.tier, r.place, r.term FROM texts JOIN rules r USING (form) 
  WHERE (contains(text, ' ' || r.term || ' ') OR r.plural AND (contains(text, ' ' || r.term || 's ') OR contains(text, ' ' || r.term || 'es ')))
  AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.label = r.label AND ex.tier = r.tier AND (ex.term IS NULL OR ex.term = r.term) AND regexp_matches(lower(line), ex.pattern)) {cubes}),
found AS (SELECT line, label, min_by(term, place) FILTER (tier = 'violated') AS v, list(DISTINCT term) FILTER (tier = 'unverified') AS o FROM hits GROUP BY ALL),
said AS (SELECT okey, label, string_agg(DISTINCT v, ',' ORDER BY v) AS terms, array_to_string(list_sort(list_distinct(flatten(list(o) FILTER (v IS NULL)))), ',') AS unverified FROM food_lines JOIN found USING (line) GROUP BY ALL),
every AS (SELECT okey, label FROM (SELECT DISTINCT okey FROM food_lines), (SELECT DISTINCT label FROM rules))
SELECT okey, label, CASE WHEN terms IS NOT NULL THEN 'violated' WHEN coalesce(unverified, '') <> '' THEN 'unverified' ELSE '{no_hit}' END AS status, coalesce(terms, '') AS terms, coalesce(unverified, '') AS unverified
FROM every LEFT JOIN said USING (okey, label)"""


def _shown(df):
    more = [F.array_join("unverified_terms", ",").alias("unverified")] if "unverified_terms" in df.columns else [F.lit("").alias("unverified")]
    return df.select("okey", "label", "status", F.array_join("terms", ",").alias("terms"), *more)


@query("rul04_allergen_tiers", _rules_sql(R.allergen_rules(), R.allergen_exemptions(), "no_listed_terms_found"))
def rul04_tiers(spark, d):
    return _shown(R.allergen_checks(food_lines(spark, d), ["okey"]))


@query("rul03_diet_options", _rules_sql(R.option_rules(), R.option_exemptions(), "checked"))
def rul03_options(spark, d):
    return _shown(R.option_checks(food_lines(spark, d), ["okey"]))


@query("rul01_policy_diets", _rules_sql(R.diet_rules(), R.diet_exemptions(), "unresolved"))
def rul01_policy(spark, d):
    return _shown(R.diet_checks(food_lines(spark, d), ["okey"]))


#: Notes on pages: what a plan says of a dish, and what its page says.
_NOTE = """CASE page_id % 6 WHEN 0 THEN 'this one is Peanut-Free' WHEN 1 THEN 'safe for a nut allergy' WHEN 2 THEN 'tree nut free, and quick' WHEN 3 THEN 'no listed terms found' WHEN 4 THEN 'SAFE for her' ELSE 'allergenfree' END"""
_PAGE = """CASE page_id % 4 WHEN 0 THEN concat(url, ' says: peanut-free') WHEN 1 THEN concat(url, ' is safe for a nut allergy') WHEN 2 THEN url END"""


@query("rul06_claims_allowed", rf"""
WITH n AS (SELECT page_id, {_NOTE} AS note, {_PAGE} AS page FROM pages),
c AS (SELECT *, coalesce(nullif(trim(regexp_extract(note, '{R.FREE_OF}', 0)), ''), nullif(trim(regexp_extract(note, '{R.SAFE_FOR}', 0)), '')) AS claim FROM n)
SELECT page_id, claim, CASE WHEN claim IS NOT NULL THEN coalesce(contains(lower(page), lower(claim)), false) END AS allowed FROM c""")
def rul06_claims(spark, d):
    n = table(spark, d, "pages").select("page_id", F.expr(_NOTE).alias("note"), F.expr(_PAGE).alias("page")).withColumn("claim", R.free_claim(F.col("note")))
    return n.select("page_id", "claim", R.claim_allowed(F.col("claim"), F.col("page")).alias("allowed"))


#: All three words in a row of a text, with single blanks between them.
_PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"


def _triples_sql(name: str, source: str, key: str) -> str:
    return rf"""{name} AS (SELECT {key}, array_to_string(t[i : i + 4], '') AS phrase FROM (SELECT {key}, t, unnest(range(1, len(t) - 3)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '{_PIECES}') AS t FROM {source}))
  WHERE t[i + 1] = ' ' AND t[i + 3] = ' ' AND regexp_matches(t[i] || t[i + 2] || t[i + 4], '^[\p{{L}}\p{{N}}_]+$'))"""


def word_triples(df, text):
    """(phrase): distinct sequences of three words with single blanks between them, in lower case."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(_PIECES), F.lit(0))
    starts = F.when(F.size(pieces) > 4, F.sequence(F.lit(1), F.size(pieces) - 4)).otherwise(F.array().cast("array<int>"))
    rows = df.select(pieces.alias("t"), starts.alias("s")).select("t", F.explode("s").alias("i"))
    five = [F.element_at("t", F.col("i") + k) for k in range(5)]
    word = r"^[\p{L}\p{N}_]+$"
    return rows.filter((five[1] == " ") & (five[3] == " ") & F.concat(five[0], five[2], five[4]).rlike(word)).select(F.concat(*five).alias("phrase")).distinct()


@query("str22_benchmark_phrases", f"""
WITH {_triples_sql('p', 'benchmark', 'item_id')}, v AS (SELECT DISTINCT phrase FROM p), {_triples_sql('dt', 'documents', 'doc_id')}
SELECT doc_id, count(*) AS mentions, count(DISTINCT phrase) AS phrases FROM dt SEMI JOIN v USING (phrase) GROUP BY doc_id""")
def str22_benchmark(spark, d):
    vocabulary = word_triples(table(spark, d, "benchmark"), F.col("text")).select(F.xxhash64("phrase").alias("phrase_id"), "phrase")
    found = P.mentions(table(spark, d, "documents"), P.PhraseIndex.build(vocabulary), ["doc_id"], "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.count_distinct("phrase_id").alias("phrases"))
