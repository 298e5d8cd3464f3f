"""Ordered rules over titles, directions, errors and ingredient names; the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapsed, first_match

# Patterns of categories and error buckets in their order, words of directions, and screens.

CATEGORIES = [
    ("beverage", r"\b(smoothie|punch|lemonade|cocktail|latte|tea|coffee|shake|sangria)\b"),
    ("cheesecake", r"cheesecake"),
    ("cupcake", r"cupcake"),
    ("cake", r"\bcake\b|torte|gateau"),
    ("bar_cookie", r"\b(bars?|brownies?|blondies?|squares)\b"),
    ("cookie", r"cookie|biscotti|shortbread|snickerdoodle|macaroon"),
    ("muffin", r"muffin"),
    ("scone_biscuit", r"\b(scones?|biscuits?)\b"),
    ("pancake_waffle", r"pancake|waffle|crepe"),
    ("pie_tart", r"\b(pies?|tarts?|tartlets?|galette|cobbler|crisp|crumble)\b"),
    ("bread", r"\b(bread|loaf|rolls?|buns?|focaccia|bagels?|brioche|challah|naan|pita)\b"),
    ("custard_pudding", r"pudding|custard|flan|creme brulee|crème brûlée|panna cotta|mousse"),
    ("frozen_dessert", r"ice cream|sorbet|gelato|popsicle|semifreddo|granita"),
    ("candy", r"fudge|candy|truffles?|brittle|toffee|caramels?"),
    ("soup_stew", r"\b(soup|stew|chowder|chili|bisque|gumbo|broth)\b"),
    ("curry", r"\bcurry\b|masala|korma|vindaloo"),
    ("salad", r"\bsalad\b|slaw"),
    ("sauce_dressing", r"\b(sauce|dressing|vinaigrette|gravy|salsa|pesto|dip|aioli)\b"),
    ("pasta", r"pasta|spaghetti|lasagn|macaroni|penne|fettuccine|linguine|noodle|ravioli"),
    ("rice_grain", r"\b(rice|risotto|pilaf|quinoa|couscous|paella|biryani)\b"),
    ("casserole", r"casserole|bake\b|gratin"),
    ("roast_braise", r"\b(roast|roasted|braised?|pot roast|brisket|ribs)\b"),
    ("stir_fry", r"stir.?fry"),
    ("egg_dish", r"omelet|frittata|quiche|scrambled|deviled eggs"),
]
FOAM, MIX, BUTTER, OIL, YEAST, ROLLED = (
    r"angel food|chiffon|sponge|genoise", r"cake mix", r"\bbutter\b|margarine|shortening", r"\boil\b", r"\byeast\b", r"roll(ed)? out|cookie cutter")
BUCKETS = [
    ("structured_quantity", r"not in source \(invented\)"),
    ("prose_wrong_ingredient", r"but the source states '.+' as"),
    ("prose_no_amount", r"but the source states no amount for"),
    ("prose_ambiguous", r"the amount is ambiguous between"),
    ("prose_unattributed", r"no source ingredient matches that amount"),
    ("food_safety", r"food.safety|safe internal|technique_refs"),
    ("fidelity", r"claims fidelity|follow, match or reproduce"),
    ("omitted_directions", r"omitted direction|unread direction"),
]
STEP_WORDS = (
    "add bake beat blend boil braise broil brown brush chill chop coat combine cook cool cover cream crumble cut dice dip drain drizzle dust enjoyable fill flip fold "
    "freeze fry garnish gather grate grease grill heat knead layer let marinate mash measure melt microwave mix pour preheat press puree reduce refrigerate repeat rest "
    "rinse roast roll saute sauté scoop season serve set shake sift simmer slice soak spoon spread sprinkle stand steam stir store strain stuff toast top toss transfer "
    "turn whip whisk wrap warm cold hot immediately ingredients well done aside overnight chilled oven check use bring place remove return"
).split()
SITE = r"(?i)allrecipes|food\.com|foodnetwork|epicurious|https?://|www\.|\.com\b"
CREDIT = r"(?i)\b(recipe|photo|photos|submitted|adapted|courtesy|contributed)\s+(by|of|from)\b"
PLACEHOLDERS = ["unknown", "n/a", "na", "none", "null", "-", "--", "tbd", "."]
SIGN_OFFS = ["enjoy", "enjoy!", "bon appetit", "bon appétit", "yum", "yummy", "eat", "delicious"]
YIELD = r"(?i)\b(serves|servings?|makes|yields?)\b[^.]*[0-9]"
NOTE_HEADING = r"^[\w’' ]{0,30}\b(notes?|tips?|variations?)\b[\s:.]*$"
USERNAME = r"^[a-z_]+[0-9]+[a-z_0-9]*$"
MEAT_FISH = (
    "chicken beef pork bacon sausage turkey duck lamb veal fish tuna salmon shrimp crab lobster clam clams mussel oyster scallop anchovy meat poultry "
    "prosciutto pancetta chorizo pepperoni"
).split()
EGG_DAIRY = "egg eggs milk butter cheese cream yogurt mayonnaise ghee whey ricotta parmesan mozzarella".split()


def category(title: Column) -> Column:
    """The first category whose pattern occurs in the lower-cased title; unknown without any, and for null."""
    return first_match(F.lower(F.coalesce(title, F.lit(""))), CATEGORIES, "unknown")


def subtype(kind: Column, title: Column, names: Column) -> Column:
    """How a cake, bread or cookie is made, by its title and its ingredients' names (one text); else empty."""
    t, n = (F.lower(F.coalesce(x, F.lit(""))) for x in (title, names))
    cake = (
        F.when(t.rlike(FOAM), "foam").when(t.contains("pound"), "pound").when(n.rlike(MIX), "from_mix").when(n.rlike(BUTTER), "butter").when(n.rlike(OIL), "oil")
        .otherwise("other"))
    return (
        F.when(kind == "cake", cake).when(kind == "bread", F.when(n.rlike(YEAST), "yeast").otherwise("quick"))
        .when(kind == "cookie", F.when(t.rlike(ROLLED), "rolled").otherwise("drop_or_other")).otherwise(""))


def letter_words(text: Column) -> Column:
    """Runs of Latin letters and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ']+"), F.lit(0)), F.lower)


def direction_class(direction: Column) -> Column:
    """site_name, credit_phrase, placeholder, sign_off, yield_note, heading, name_like, step or unclear."""
    text = collapsed(direction)
    lowered = F.lower(text)
    bare = F.btrim(lowered, F.lit(" .!"))
    words = letter_words(text)
    step = F.arrays_overlap(words, F.array(*map(F.lit, STEP_WORDS)))
    return (
        F.when(text.rlike(SITE), "site_name").when(text.rlike(CREDIT), "credit_phrase")
        .when(bare.isin(PLACEHOLDERS) | (F.size(words) == 0), "placeholder")
        .when(lowered.isin(SIGN_OFFS) | bare.isin(SIGN_OFFS), "sign_off")
        .when(text.rlike(YIELD), "yield_note").when(lowered.rlike("(?U)" + NOTE_HEADING), "heading").when(bare.rlike(USERNAME), "name_like")
        .when(lowered.endswith(":") & (F.size(words) <= 5), "heading").when(step, "step")
        .when((F.size(words) <= 3) & ~text.rlike("[0-9]"), "name_like").otherwise("unclear"))


def audit_candidate(direction: Column, max_words: int) -> Column:
    """Directions worth a look: short ones, and those that name a site or give credit."""
    t = F.coalesce(direction, F.lit(""))
    return (F.size(letter_words(t)) <= max_words) | t.rlike(SITE) | t.rlike(CREDIT)


def error_bucket(error: Column) -> Column:
    """The bucket of an error's text, in any case; other without a match."""
    return first_match(F.coalesce(error, F.lit("")), [(name, "(?i)" + pattern) for name, pattern in BUCKETS], "other")


def screened(names: Column, words: list[str]) -> Column:
    """Sorted distinct names that have one of the words."""
    wanted = F.array(*map(F.lit, words))
    said = lambda n: F.arrays_overlap(F.regexp_extract_all(F.lower(n), F.lit("[a-z]+"), F.lit(0)), wanted)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & F.coalesce(said(n), F.lit(False)))))


def diet_status(names: Column, diet: Column) -> Column:
    """violated, supported (as displayed: not proved) or, for another diet, unresolved; null names are none."""
    own = F.coalesce(names, F.array().cast("array<string>"))
    meat, dairy = F.size(screened(own, MEAT_FISH)) > 0, F.size(screened(own, EGG_DAIRY)) > 0
    return F.when(diet == "vegetarian", F.when(meat, "violated").otherwise("supported")).when(
        diet == "vegan", F.when(meat | dairy, "violated").otherwise("supported")).otherwise("unresolved")


def suitability(grade: Column, statuses: Column) -> Column:
    """What a topical grade and the statuses of constraints add up to."""
    has = lambda s: F.array_contains(statuses, s)
    return (
        F.when(grade < 1, "not_suitable").when(has("violated"), "not_suitable").when(has("unresolved"), "unresolved")
        .when(F.size(statuses) == 0, "not_applicable").otherwise("supported"))
