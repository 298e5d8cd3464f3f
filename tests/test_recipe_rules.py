"""One line or more for every rule of titles, directions, errors and screens."""

from pyspark.sql import functions as F

from lodestone.operators import recipe_rules as R

TITLES = [
    ("Iced Tea", "beverage"), ("New York Cheesecake", "cheesecake"), ("Vanilla Cupcakes", "cupcake"), ("Carrot Cake", "cake"), ("Sachertorte", "cake"), ("Lemon bars", "bar_cookie"),
    ("Almond biscotti", "cookie"), ("Blueberry muffins", "muffin"), ("Cream scones", "scone_biscuit"), ("Buttermilk Pancakes", "pancake_waffle"), ("Apple Crisp", "pie_tart"),
    ("Garlic naan", "bread"), ("Crème brûlée", "custard_pudding"), ("Lemon sorbet", "frozen_dessert"), ("Peanut brittle", "candy"), ("Clam chowder", "soup_stew"),
    ("Lamb vindaloo", "curry"), ("Coleslaw", "salad"), ("Salsa verde", "sauce_dressing"), ("Ravioli", "pasta"), ("Mushroom risotto", "rice_grain"), ("Potato gratin", "casserole"),
    ("Braised ribs", "roast_braise"), ("Beef stir-fry", "stir_fry"), ("Ham quiche", "egg_dish"), ("Steak", "unknown"), (None, "unknown"), ("Pancake bake", "pancake_waffle"),
    ("Tear and share", "unknown"), ("Coffee cake", "beverage"),
]
DIRECTIONS = [
    ("See www.site.org", "site_name"), ("from AllRecipes", "site_name"), ("Recipe  by Ann", "credit_phrase"), ("n/a", "placeholder"), ("12 - 3", "placeholder"), ("Enjoy!!", "sign_off"),
    ("Bon appétit.", "sign_off"), ("Serves about 4", "yield_note"), ("Chef's notes:", "heading"), ("baker_42x", "name_like"), ("For the big sauce:", "heading"), ("Mix it", "step"),
    ("Sauté gently", "step"), ("Aunt May", "name_like"), ("Aunt May 2", "unclear"), ("a b c d e", "unclear"), (None, "placeholder"), ("", "placeholder"), ("Mix the dry things:", "heading"),
]
ERRORS = [
    ("3 cups NOT in source (invented)", "structured_quantity"), ("but the source states '2 g' as salt", "prose_wrong_ingredient"), ("but the source states no amount for salt", "prose_no_amount"),
    ("the amount is ambiguous between a and b", "prose_ambiguous"), ("no source ingredient matches that amount", "prose_unattributed"), ("food-safety", "food_safety"),
    ("claims fidelity", "fidelity"), ("Unread direction 3", "omitted_directions"), ("else", "other"), (None, "other"),
]


def test_every_rule(spark):
    for rows, rule in ((TITLES, R.category), (DIRECTIONS, R.direction_class), (ERRORS, R.error_bucket)):
        df = spark.createDataFrame(rows, "t string, want string")
        got = [(r.t, r.c) for r in df.select("t", rule(F.col("t")).alias("c")).collect()]
        assert got == rows
    assert {c for _, c in TITLES} == {c for c, _ in R.CATEGORIES} | {"unknown"} and {b for _, b in ERRORS} == {b for b, _ in R.BUCKETS} | {"other"}


def test_subtypes_and_candidates(spark):
    rows = [
        ("cake", "Angel food cake", "oil", "foam"), ("cake", "Pound cake", "butter", "pound"), ("cake", "Cake", "1 cake mix, butter", "from_mix"), ("cake", "Cake", "Butter, oil", "butter"),
        ("cake", "Cake", "olive oil", "oil"), ("cake", "Cake", None, "other"), ("bread", "Bread", "dry yeast", "yeast"), ("bread", "Bread", "yeasty", "quick"), ("cookie", "Rolled out cookies", "", "rolled"),
        ("cookie", "Cookies", "", "drop_or_other"), ("soup_stew", "Soup", "butter", "")]
    df = spark.createDataFrame(rows, "k string, t string, n string, want string")
    assert all(r.s == r.want for r in df.select("want", R.subtype(F.col("k"), F.col("t"), F.col("n")).alias("s")).collect())
    lines = [("one two three", True), ("one two three four", False), ("one two three four www.x", True), ("a b c photo by d e", True), (None, True)]
    df = spark.createDataFrame(lines, "t string, want boolean")
    assert all(r.c == r.want for r in df.select("want", R.audit_candidate(F.col("t"), 3).alias("c")).collect())


def test_screens_and_suitability(spark):
    rows = [
        (["Chicken stock", "egg"], "vegetarian", "violated"), (["eggplant", "hamster"], "vegan", "supported"), (["Whole-milk"], "vegan", "violated"), (["Whole-milk"], "vegetarian", "supported"),
        (["x"], "keto", "unresolved"), (None, "vegan", "supported"), ([None, ""], "vegan", "supported")]
    df = spark.createDataFrame(rows, "n array<string>, d string, want string")
    assert all(r.s == r.want for r in df.select("want", R.diet_status(F.col("n"), F.col("d")).alias("s")).collect())
    found = spark.createDataFrame([(["b bacon", "a beef", "b bacon", None],)], "n array<string>").select(R.screened(F.col("n"), R.MEAT_FISH).alias("s")).first().s
    assert found == ["a beef", "b bacon"]
    rows = [
        (0, ["supported"], "not_suitable"), (None, ["violated", "unresolved"], "not_suitable"), (1, ["unresolved", "supported"], "unresolved"), (2, [], "not_applicable"), (2, ["supported"], "supported")]
    df = spark.createDataFrame(rows, "g int, s array<string>, want string")
    assert all(r.x == r.want for r in df.select("want", R.suitability(F.col("g"), F.col("s")).alias("x")).collect())
