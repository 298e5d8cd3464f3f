"""Rule tables over nested ingredient names: diets, allergens, questions, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import says_word, tokens

#: Per diet the words that break it, and compounds that excuse a word.
DIETS: dict[str, tuple[list[str], list[str]]] = {
    "red_free": (["red"], ["red ring"]),
    "metal_free": (["bolt", "nut", "gear"], ["small nut"]),
    "round_free": (["ring", "wheel"], []),
}
ALIASES = {"no red": "red_free", "red-free": "red_free", "metal free": "metal_free", "non-metal": "metal_free", "no rounds": "round_free"}
#: Per label the words named for certain and those that only may hold it.
ALLERGENS: dict[str, tuple[list[str], list[str]]] = {"bolts": (["bolt"], ["widget"]), "rings": (["ring"], ["gear"]), "nuts": (["nut"], [])}


def diet_alias(x: Column) -> Column:
    """The name of a diet for one of its aliases, else the trimmed text."""
    t = F.lower(F.trim(x))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in ALIASES.items() for y in kv]), t), t)


def diet_rules(spark) -> DataFrame:
    rows = [(d, w, x) for d, (words, x) in DIETS.items() for w in words]
    return spark.createDataFrame(rows, "diet string, word string, except array<string>")


def diet_hits(recipes: DataFrame, rules: DataFrame, tasks: int | None = None) -> DataFrame:
    """(dataset_id, source_id, diet, name): names that break a diet; excused and ``free`` names don't.

    The rules go to every task, so that no word's names meet in one. Hits that several rows of a
    source give are made one in ``tasks`` tasks, by default as many as the session shuffles to.
    """
    names = recipes.select("dataset_id", "source_id", F.explode(F.array_distinct("names")).alias("name")).withColumn("tokens", F.array_distinct(tokens(F.col("name"))))
    said = names.filter(~F.array_contains("tokens", "free")).select("dataset_id", "source_id", "name", F.explode("tokens").alias("token"))
    # a word and its plurals, so that the join is one of equal values
    forms = rules.select("diet", "except", F.explode(F.array(*(F.concat("word", F.lit(x)) for x in ("", "s", "es")))).alias("token"))
    found = said.join(F.broadcast(forms), "token").filter(~F.array_contains("except", F.lower("name"))).select("dataset_id", "source_id", "diet", "name")
    return (found.repartition(tasks, "dataset_id", "source_id") if tasks else found).distinct()


def diet_verdicts(recipes: DataFrame, rules: DataFrame, tasks: int | None = None) -> DataFrame:
    """violated where a name breaks the diet; else unresolved: no hit never means safe."""
    hits = diet_hits(recipes, rules, tasks).groupBy("dataset_id", "source_id", "diet").agg(F.count("*").alias("hits"))
    every = recipes.select("dataset_id", "source_id").crossJoin(F.broadcast(rules.select("diet").distinct()))
    return every.join(hits, ["dataset_id", "source_id", "diet"], "left").select(
        "dataset_id", "source_id", "diet", F.when(F.col("hits") > 0, "violated").otherwise("unresolved").alias("verdict"))


def allergen_status(names: Column, label: str) -> Column:
    """named, possible or no_listed_terms_found."""
    sure, maybe = ALLERGENS[label]
    says = lambda words: F.exists(names, lambda n: _any(tokens(n), words)) if words else F.lit(False)
    return F.when(says(sure), "named").when(says(maybe), "possible").otherwise("no_listed_terms_found")


def _any(words: Column, wanted: list[str]) -> Column:
    out = F.lit(False)
    for w in wanted:
        out = out | says_word(words, w)
    return out


def time_verdict(minutes: Column, ceiling: float) -> Column:
    return F.when(minutes.isNull() | F.isnan(minutes) | (minutes <= 0), "unresolved").when(minutes <= ceiling, "supported").otherwise("violated")


def planned_questions(catalog: DataFrame, answered: DataFrame, cap: int) -> DataFrame:
    """Open questions per request: required first, then higher priority, then id; at most ``cap``."""
    open_ = catalog.join(answered, ["request", "question"], "left_anti")
    w = Window.partitionBy("request").orderBy(F.desc("required"), F.desc("priority"), "question")
    return open_.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def proposals(rows: DataFrame, kinds: tuple[str, ...], least_confidence: float) -> DataFrame:
    """Accepts typed proposals in order of seq; the first failing test names the reason."""
    nth = F.row_number().over(Window.partitionBy("request", "kind", "target").orderBy("seq"))
    return rows.withColumn("nth", nth).withColumn("reason", F.when(~F.col("kind").isin(*kinds), "unsupported_kind").when(F.col("target").isNull(), "no_target").when(
        F.col("nth") > 1, "duplicate").when(F.col("confidence") < least_confidence, "low_confidence")).withColumn("accepted", F.col("reason").isNull())


def conflicts(stated: Column, wanted: Column) -> Column:
    """A stated exclusion and a wish for the same token."""
    return F.arrays_overlap(tokens(stated), tokens(wanted))


def evidence_status(asked: Column, available: Column, matched: Column) -> Column:
    return F.when(~asked, "not_queried").when(~available, "unavailable").when(matched, "backed").otherwise("queried_no_result")
