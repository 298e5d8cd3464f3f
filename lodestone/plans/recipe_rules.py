"""Queries: ordered rules over titles, directions, errors and names that are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import recipe_rules as R
from ..sources.tables import table
from .foods import LINES_SQL, food_lines

DISHES = [
    "Iced Tea", "Cheesecake", "Cupcakes", "Carrot Cake", "Pound Cake", "Chiffon cake", "Torte", "Lemon bars", "Sugar cookies", "Rolled out cookies", "Muffins", "Scones", "Waffles",
    "Apple Pie", "Garlic bread", "Dinner rolls", "Flan", "Gelato", "Fudge", "Beef stew", "Korma", "Potato Salad", "Pesto", "Lasagna", "Fried rice", "Tuna casserole", "Pot roast",
    "Stir fry", "Frittata", "Grilled cheese", "Coffee cake", "Cake of the day",
]
DIRECTIONS = [
    "Mix well.", "See www.food.com", "Recipe by Ann B", "n/a", "Enjoy!", "Serves 4 to 6", "Tips:", "cook_77", "For the sauce:", "Aunt May", "Aunt May 2", "Put it away for the night now",
    "Preheat the oven to 350", "-", " Bon  appetit ", "Makes 12 rolls", "Variations and notes", "Photo of the dish", "12", "Dust with sugar:", "Pour, then stir",
]
ERRORS = [
    "3 cups not in source (invented)", "but the source states '2 g' as salt", "but the source states no amount for salt", "The amount is ambiguous between 1 and 2",
    "no source ingredient matches that amount", "see food safety", "follow, match or reproduce", "omitted direction 3", "timeout",
]


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _of(values, place):
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def _cases(column: str, rules, default: str, flags: str = "") -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {quoted(flags + p)}) THEN '{name}'" for name, p in rules) + f" ELSE '{default}' END"


@query("str10_title_categories", f"""WITH {LINES_SQL}, n AS (SELECT okey, string_agg(lower(line), ' ' ORDER BY line) AS names FROM food_lines GROUP BY okey),
t AS (SELECT o_orderkey, 'Best ' || {_list(DISHES)}[1 + o_orderkey % {len(DISHES)}] AS title, coalesce(names, '') AS names FROM orders LEFT JOIN n ON okey = o_orderkey),
c AS (SELECT *, {_cases('lower(title)', R.CATEGORIES, 'unknown')} AS category FROM t)
SELECT o_orderkey, title, category, CASE category
  WHEN 'cake' THEN CASE WHEN regexp_matches(lower(title), '{R.FOAM}') THEN 'foam' WHEN contains(lower(title), 'pound') THEN 'pound' WHEN regexp_matches(names, '{R.MIX}') THEN 'from_mix'
    WHEN regexp_matches(names, '{R.BUTTER}') THEN 'butter' WHEN regexp_matches(names, '{R.OIL}') THEN 'oil' ELSE 'other' END
  WHEN 'bread' THEN CASE WHEN regexp_matches(names, '{R.YEAST}') THEN 'yeast' ELSE 'quick' END
  WHEN 'cookie' THEN CASE WHEN regexp_matches(lower(title), '{R.ROLLED}') THEN 'rolled' ELSE 'drop_or_other' END ELSE '' END AS subtype FROM c""")
def str10_titles(spark, d):
    names = food_lines(spark, d).groupBy("okey").agg(F.array_join(F.array_sort(F.collect_list(F.lower("line"))), " ").alias("names"))
    t = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Best "), _of(DISHES, F.col("o_orderkey"))).alias("title"))
    t = t.join(names, F.col("okey") == F.col("o_orderkey"), "left").withColumn("category", R.category(F.col("title")))
    return t.select("o_orderkey", "title", "category", R.subtype(F.col("category"), F.col("title"), F.col("names")).alias("subtype"))


@query("str11_direction_classes", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, {_list(DIRECTIONS)}[1 + (l_partkey * 3 + l_linenumber) % {len(DIRECTIONS)}] AS raw FROM lineitem),
t AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM l),
w AS (SELECT *, lower(t) AS low, trim(lower(t), ' .!') AS bare, list_transform(regexp_extract_all(t, '[A-Za-zÀ-ÿ'']+'), lambda x: lower(x)) AS ws FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(t, '{R.SITE}') THEN 'site_name' WHEN regexp_matches(t, '{R.CREDIT}') THEN 'credit_phrase'
  WHEN list_contains({_list(R.PLACEHOLDERS)}, bare) OR len(ws) = 0 THEN 'placeholder' WHEN list_contains({_list(R.SIGN_OFFS)}, low) OR list_contains({_list(R.SIGN_OFFS)}, bare) THEN 'sign_off'
  WHEN regexp_matches(t, '{R.YIELD}') THEN 'yield_note' WHEN regexp_matches(low, '{R.NOTE_HEADING.replace(chr(39), chr(39) * 2)}') THEN 'heading' WHEN regexp_matches(bare, '{R.USERNAME}') THEN 'name_like'
  WHEN suffix(low, ':') AND len(ws) <= 5 THEN 'heading' WHEN list_has_any(ws, {_list(R.STEP_WORDS)}) THEN 'step' WHEN len(ws) <= 3 AND NOT regexp_matches(t, '[0-9]') THEN 'name_like'
  ELSE 'unclear' END AS class, len(regexp_extract_all(raw, '[A-Za-zÀ-ÿ'']+')) <= 3 OR regexp_matches(raw, '{R.SITE}') OR regexp_matches(raw, '{R.CREDIT}') AS candidate FROM w""")
def str11_classes(spark, d):
    raw = _of(DIRECTIONS, F.col("l_partkey") * 3 + F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", R.direction_class(F.col("raw")).alias("class"), R.audit_candidate(F.col("raw"), 3).alias("candidate"))


@query("str12_attribution_buckets", f"""
SELECT event_id, {_cases('e', R.BUCKETS, 'other', '(?i)')} AS bucket FROM (SELECT event_id, event_type || ': ' || {_list(ERRORS)}[1 + event_id % {len(ERRORS)}] AS e FROM events)""")
def str12_errors(spark, d):
    text = F.concat("event_type", F.lit(": "), _of(ERRORS, F.col("event_id")))
    return table(spark, d, "events").select("event_id", R.error_bucket(text).alias("bucket"))


@query("evl14_suitability", f"""WITH {LINES_SQL}, w AS (SELECT okey, list(DISTINCT line) AS names, flatten(list(regexp_extract_all(lower(line), '[a-z]+'))) AS ws FROM food_lines GROUP BY okey),
s AS (SELECT *, list_has_any(ws, {_list(R.MEAT_FISH)}) AS meat, list_has_any(ws, {_list(R.EGG_DAIRY)}) AS dairy FROM w),
v AS (SELECT okey, okey % 4 AS grade, CASE okey % 3 WHEN 0 THEN CASE WHEN meat THEN 'violated' ELSE 'supported' END WHEN 1 THEN CASE WHEN meat OR dairy THEN 'violated' ELSE 'supported' END ELSE 'unresolved' END AS status,
  (SELECT count(*) FROM (SELECT unnest(names) AS n) WHERE list_has_any(regexp_extract_all(lower(n), '[a-z]+'), {_list(R.MEAT_FISH)})) AS meats FROM s)
SELECT okey, status, meats, CASE WHEN grade < 1 OR status = 'violated' THEN 'not_suitable' WHEN status = 'unresolved' THEN 'unresolved' ELSE 'supported' END AS suitability FROM v""")
def evl14_suit(spark, d):
    names = food_lines(spark, d).groupBy("okey").agg(F.collect_list("line").alias("names"))  # an order has a few lines
    diet = F.when(F.col("okey") % 3 == 0, "vegetarian").when(F.col("okey") % 3 == 1, "vegan").otherwise("keto")
    v = names.select("okey", R.diet_status(F.col("names"), diet).alias("status"), F.size(R.screened(F.col("names"), R.MEAT_FISH)).cast("long").alias("meats"))
    return v.withColumn("suitability", R.suitability(F.col("okey") % 4, F.array("status")))
