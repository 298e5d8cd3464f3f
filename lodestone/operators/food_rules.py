"""Food rules over ingredient lines: diets and allergens as rows of rule tables.

A rule says that a term in a line breaks a label (tier ``violated``) or leaves it open (tier
``unverified``); an exemption says that a pattern in the line excuses a term. Distinct lines are
scanned once for the terms of all rules (``phrases``), whose hits are joined with the rules;
documents then collect what their lines say. A line that breaks a label gives its first
term, by the rules' places, and nothing else for that label. No hit never means safe.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import phrase_pattern
from .phrases import PhraseIndex, mentions
from .storage import written

# Which words and phrases break a label, which leave it open, and what excuses them.

VEGETARIAN = (
    "beef pork lamb veal venison goat mutton rabbit bacon ham sausage salami pepperoni chorizo prosciutto pancetta meatball meatballs jerky "
    "chicken turkey duck goose quail pheasant poultry hen capon "
    "fish salmon tuna cod haddock halibut tilapia trout sardine sardines anchovy anchovies mackerel sole snapper catfish bass eel swordfish surimi "
    "shrimp prawn crab lobster crayfish scallop scallops clam clams mussel mussels oyster oysters squid calamari octopus seafood "
    "gelatin gelatine lard tallow suet rennet"
).split()
DAIRY = (
    "milk cheese butter cream yogurt yoghurt whey casein caseinate ghee kefir buttermilk mozzarella parmesan cheddar feta ricotta mascarpone halloumi "
    "paneer provolone gouda brie"
).split()
VEGAN = [*VEGETARIAN, *DAIRY, "egg", "eggs", "honey"]
OPEN_STOCKS = "broth stock bouillon worcestershire".split()
RENNET_CHEESES = "parmesan parmigiano pecorino romano grana gorgonzola gruyere gruyère manchego emmental emmentaler comte comté".split()
#: Plant butters, milks and creams aren't dairy.
NON_DAIRY = (
    r"\b(?:peanut|almond|cashew|sunflower|sesame|soy|tahini|apple|coconut) butter\b",
    r"\b(?:coconut|oat|soy|almond|cashew|rice|hemp|pea|flax|hazelnut) milk\b",
    r"\bcoconut cream\b",
    r"\bcream of tartar\b",
)
ALLERGENS: dict[str, dict[str, list[str]]] = {
    "peanut": {"words": ["peanut"], "open_words": ["nut"]},
    "tree nuts": {
        "words": "nut almond walnut cashew pecan pistachio hazelnut macadamia praline marzipan nutella".split(), "phrases": ["brazil nut", "pine nut"]},
    "shellfish": {
        "words": "shrimp prawn crab lobster scallop clam mussel oyster shellfish".split(), "phrases": ["oyster sauce"],
        "open_phrases": ["seafood stock", "xo sauce"]},
    "fish": {
        "words": "fish tuna salmon cod anchovy sardine trout".split(), "phrases": ["fish sauce"], "open_words": ["worcestershire"],
        "open_phrases": ["caesar dressing"]},
    "egg": {"words": "egg mayonnaise aioli meringue".split(), "open_words": "custard pasta batter".split()},
    "milk/dairy": {"words": [*DAIRY, "gruyere", "custard", "lactose", "dairy"], "phrases": ["ice cream"]},
    "wheat/gluten": {
        "words": (
            "wheat gluten barley rye flour bread breadcrumb panko pasta spaghetti macaroni noodle udon ramen couscous semolina bulgur farro spelt seitan "
            "cracker tortilla beer").split(),
        "phrases": ["soy sauce"], "open_words": "bouillon malt seasoning oat oatmeal".split()},
    "soy": {
        "words": "soy tofu miso edamame tamari tempeh".split(), "phrases": ["soy sauce"], "open_words": ["lecithin"], "open_phrases": ["vegetable oil"]},
    "sesame": {"words": ["sesame", "tahini"], "open_words": ["furikake"], "open_phrases": ["za'atar"]},
}
#: A flour, noodle or tortilla of something else than wheat.
NO_WHEAT = {
    "flour": [f"{x} flour" for x in "rice almond coconut chickpea oat buckwheat corn potato tapioca".split()],
    "noodle": ["rice noodle", "glass noodle"],
    "tortilla": ["corn tortilla"],
}
GLUTEN_FREE = r"gluten[-\s]?free"
CUBES = "stock/broth cubes"
_PLANTS = "chicken beef pork fish bacon turkey lamb meat sausage ham shrimp crab"
DIETS: dict[str, list[str]] = {
    "vegan": [*_PLANTS.split(), *"milk cheese butter cream yogurt egg honey gelatin".split()],
    "vegetarian": [*_PLANTS.split(), "gelatin"],
    "gluten-free": "wheat gluten barley rye flour bread pasta spaghetti noodle couscous semolina".split(),
}
DIET_NAMES: dict[str, list[str]] = {
    "vegan": ["vegan", "plant based", "dairy free vegan"],
    "vegetarian": ["vegetarian", "veggie", "veg"],
    "gluten-free": ["gluten free", "glutenfree", "coeliac", "celiac"],
}
#: Names that hold one of these anywhere are left undecided.
COMPOUNDS = [
    "coconut milk", "coconut cream", "almond milk", "oat milk", "soy milk", "rice milk", "hemp milk", "peanut butter", "almond butter", "cashew butter",
    "cocoa butter", "shea butter", "rice flour", "almond flour", "coconut flour", "chickpea flour", "oat flour", "buckwheat flour",
]
QUALIFIERS = [
    "gluten-free", "gluten free", "vegan", "vegetarian", "dairy-free", "dairy free", "egg-free", "egg free", "plant-based", "plant based",
]
FREE_OF = r"(?i)\b(?:peanut|tree[\s-]?nuts?|nut|shellfish|fish|egg|milk|dairy|wheat|gluten|soy|sesame|allergen)[\s-]?free\b"
SAFE_FOR = r"(?i)\bsafe\b[\s\S]{0,60}\ballerg(?:y|ies|ic)\b"

#: A rule: label, tier, place among its label's rules, term, whether s or es may follow it, and the form of the
#: line that it is looked for in.
RULE = "label string, tier string, place int, term string, plural boolean, form string"
#: An exemption: label, term (null: any), tier that it excuses, pattern in the lower-cased line.
EXEMPTION = "label string, term string, tier string, pattern string"
#: Forms of a line: as it is in lower case, with everything but a-z and 0-9 as blanks, and both without NON_DAIRY.
FORMS = ("line", "words", "line_scrubbed", "words_scrubbed")


def allergen_rules() -> list[tuple]:
    """Words in alphabetical order, then phrases as listed; dairy words in the scrubbed line."""
    rows = []
    for label, kinds in ALLERGENS.items():
        words = "words_scrubbed" if label == "milk/dairy" else "words"
        listed = [("violated", w, words) for w in sorted(kinds["words"])] + [("violated", p, "line") for p in kinds.get("phrases", ())]
        listed += [("unverified", w, words) for w in sorted(kinds.get("open_words", ()))] + [("unverified", p, "line") for p in kinds.get("open_phrases", ())]
        rows += [(label, tier, k, term, True, form) for k, (tier, term, form) in enumerate(listed)]
    return rows


def allergen_exemptions() -> list[tuple]:
    """Lines that say gluten-free break nothing; flours, noodles and tortillas of something else; tamari."""
    label = "wheat/gluten"
    rows = [(label, None, "violated", GLUTEN_FREE)]
    rows += [(label, term, "violated", phrase_pattern(p).replace(" ", r"\s+")) for term, phrases in NO_WHEAT.items() for p in phrases]
    return [*rows, (label, "soy sauce", "violated", "tamari")]


def option_rules() -> list[tuple]:
    """Vegetarian and vegan options; ambiguous stocks and cheeses of animal rennet leave them open."""
    rows = []
    for label, broken in (("vegetarian", VEGETARIAN), ("vegan", VEGAN)):
        open_ = [*sorted(OPEN_STOCKS), *(sorted(RENNET_CHEESES) if label == "vegetarian" else ())]
        listed = [("violated", t) for t in sorted(broken)] + [("unverified", t) for t in open_]
        rows += [(label, tier, k, term, False, "line_scrubbed") for k, (tier, term) in enumerate(listed)]
    return rows


def option_exemptions() -> list[tuple]:
    rows = [(label, t, "unverified", r"\b(?:vegetable|vegan)\b") for label in ("vegetarian", "vegan") for t in OPEN_STOCKS]
    return rows + [("vegetarian", t, "unverified", r"\bvegetarian\b") for t in RENNET_CHEESES]


def diet_rules() -> list[tuple]:
    return [(label, "violated", k, term, True, "words") for label, terms in DIETS.items() for k, term in enumerate(terms)]


def diet_exemptions() -> list[tuple]:
    return [(label, None, "violated", re.escape(x).replace(r"\ ", " ").replace(r"\-", "-")) for label in DIETS for x in [*QUALIFIERS, *COMPOUNDS]]


def line_form(line: Column, form: str) -> Column:
    """One of FORMS; null is empty."""
    text = F.lower(F.coalesce(line, F.lit("")))
    if form.endswith("scrubbed"):
        for pattern in NON_DAIRY:
            text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(text, "[^a-z0-9]+", " ") if form.startswith("words") else text


def diet_name(x: Column) -> Column:
    """The diet that a name stands for; null for an unknown one."""
    key = F.trim(F.regexp_replace(F.lower(F.translate(x, "-", " ")), r"\s+", " "))
    out = F.lit(None).cast("string")
    for diet, names in DIET_NAMES.items():
        out = F.when(key.isin(*names), diet).otherwise(out)
    return out


def line_findings(lines: DataFrame, line_col: str, rules: DataFrame, exemptions: DataFrame) -> DataFrame:
    """(line, label, tier, terms) of distinct non-null lines: the one term that breaks a label, else all
    that leave it open; lines that no rule meets have no row."""
    numbered = rules.select(F.xxhash64("term", "plural", "form").alias("phrase_id"), "label", "tier", "place", "term", "plural", "form")
    index = PhraseIndex.build(numbered.select("phrase_id", F.col("term").alias("phrase"), "plural").distinct(), "any")
    distinct = lines.select(F.col(line_col).alias("line")).filter("line is not null").distinct()
    forms = sorted(r.form for r in rules.select("form").distinct().collect())  # of four
    texts = None
    for form in forms:
        one = distinct.select("line", F.lit(form).alias("form"), line_form(F.col("line"), form).alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    said = mentions(texts, index, ["line", "form"], "text").select("line", "form", "phrase_id").distinct()
    hits = said.join(numbered, ["phrase_id", "form"]).select("line", "label", "tier", "place", "term")
    cubes = distinct.select("line", F.split(line_form(F.col("line"), "words"), " ").alias("w")).filter(
        F.arrays_overlap("w", F.array(*map(F.lit, ("cube", "cubes", "cubees")))) & F.arrays_overlap("w", F.array(*map(F.lit, ("stock", "stocks", "stockes", "broth", "broths", "brothes")))))
    cube_rule = numbered.filter("label = 'wheat/gluten'").groupBy("label").agg((F.max("place") + 1).alias("place"))
    hits = hits.unionByName(cubes.select("line").join(F.broadcast(cube_rule)).select(
        "line", "label", F.lit("unverified").alias("tier"), "place", F.lit(CUBES).alias("term")))
    excuses = exemptions.select("label", F.col("term").alias("of"), "tier", "pattern")
    excused = hits.join(excuses, ["label", "tier"]).filter(
        (F.col("of").isNull() | (F.col("of") == F.col("term"))) & F.call_function("rlike", F.lower("line"), F.col("pattern")))
    hits = hits.join(excused.select("line", "label", "tier", "term").distinct(), ["line", "label", "tier", "term"], "left_anti")
    violated = F.min(F.when(F.col("tier") == "violated", F.struct("place", "term")))
    opened = F.collect_set(F.when(F.col("tier") == "unverified", F.col("term")))
    # a line has at most as many terms as there are rules
    found = hits.groupBy("line", "label").agg(violated.alias("v"), opened.alias("o"))
    return found.select(
        "line", "label", F.when(F.col("v").isNotNull(), "violated").otherwise("unverified").alias("tier"),
        F.when(F.col("v").isNotNull(), F.array("v.term")).otherwise(F.col("o")).alias("terms"))


def checked(lines: DataFrame, keys: list[str], line_col: str, rules: DataFrame, exemptions: DataFrame, no_hit: str) -> DataFrame:
    """(keys, label, status, terms, unverified_terms) per document and label.

    ``lines`` has a row per line; a document without usable lines has a row with a null line. The status is
    violated, unverified, or ``no_hit``. Terms are sorted and distinct. Repeated lines count once.
    """
    found = written(line_findings(lines, line_col, rules, exemptions), "line-findings")
    own = lines.select(*keys, F.col(line_col).alias("line"))
    said = own.join(found, "line").groupBy(*keys, "label").agg(*(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("tier") == tier, F.col("terms")))))).alias(name)
        for tier, name in (("violated", "terms"), ("unverified", "unverified_terms"))))
    every = own.select(*keys).distinct().join(F.broadcast(rules.select("label").distinct()))  # a stated, small set of labels
    none = F.array().cast("array<string>")
    return every.join(said, [*keys, "label"], "left").select(
        *keys, "label",
        F.when(F.size("terms") > 0, "violated").when(F.size("unverified_terms") > 0, "unverified").otherwise(no_hit).alias("status"),
        F.coalesce("terms", none).alias("terms"), F.coalesce("unverified_terms", none).alias("unverified_terms"))


def rule_tables(spark: SparkSession, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rules and exemptions of kind ``allergens``, ``options`` or ``diets`` as tables."""
    rows = {"allergens": (allergen_rules, allergen_exemptions), "options": (option_rules, option_exemptions), "diets": (diet_rules, diet_exemptions)}[kind]
    return spark.createDataFrame(rows[0](), RULE), spark.createDataFrame(rows[1](), EXEMPTION)


def allergen_checks(lines: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """All nine labels per document; no hit is ``no_listed_terms_found``, as the lists are incomplete."""
    return checked(lines, keys, line_col, *rule_tables(lines.sparkSession, "allergens"), "no_listed_terms_found")


def option_checks(lines: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """Vegetarian and vegan per document; no hit is ``checked``."""
    return checked(lines, keys, line_col, *rule_tables(lines.sparkSession, "options"), "checked")


def diet_checks(lines: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """Vegan, vegetarian and gluten-free per document; no hit is ``unresolved``: absence is not compatibility."""
    return checked(lines, keys, line_col, *rule_tables(lines.sparkSession, "diets"), "unresolved").drop("unverified_terms")


def free_claim(text: Column) -> Column:
    """The words that call something free of an allergen or safe for an allergy, cut to 80 characters, or null."""
    claims = (F.nullif(F.trim(F.regexp_extract(text, pattern, 0)), F.lit("")) for pattern in (FREE_OF, SAFE_FOR))
    return F.substring(F.coalesce(*claims), 1, 80)


def claim_allowed(claim: Column, source: Column) -> Column:
    """Only a source that says the claim itself allows it; without a claim there is nothing to allow (null)."""
    return F.when(claim.isNotNull(), F.coalesce(F.lower(source).contains(F.lower(claim)), F.lit(False)))
