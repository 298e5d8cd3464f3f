"""Predicates and projections over recipes, rankings and documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def under_ceiling(minutes: Column, ceiling: float | None) -> Column:
    """No ceiling passes all; else only finite positive totals up to it."""
    if ceiling is None:
        return F.lit(True)
    return F.coalesce((minutes > 0) & (minutes <= ceiling) & ~F.isnan(minutes), F.lit(False))


def total_status(minutes: Column) -> Column:
    """missing, non_finite, negative, reported_zero_unverified or reported."""
    return (
        F.when(minutes.isNull(), "missing").when(F.isnan(minutes) | (F.abs(minutes) == float("inf")), "non_finite")
        .when(minutes < 0, "negative").when(minutes == 0, "reported_zero_unverified").otherwise("reported")
    )


def contains_all(names: Column, wanted: list[str]) -> Column:
    """Every wanted name is there; an empty list passes all."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), names)) == 0, F.lit(False))


def contains_any(names: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, wanted))), F.lit(False))


def overlap_count(names: Column, wanted: list[str]) -> Column:
    """Elements among the wanted ones, repeats counted."""
    return F.size(F.filter(names, lambda n: n.isin(*wanted))).cast("long")


def overlap_set(names: Column, wanted: list[str]) -> Column:
    """Distinct names among the wanted ones."""
    return F.size(F.array_intersect(names, F.array(*map(F.lit, wanted)))).cast("long")


def in_dataset(df: DataFrame, dataset: str | None, known: tuple[str, ...]) -> DataFrame:
    """Scope to one data set; an unknown id is an error, not an empty result."""
    if dataset is None:
        return df
    if dataset not in known:
        raise ValueError(f"unknown data set {dataset!r}")
    return df.filter(F.col("dataset_id") == dataset)


def check_search(query: str | None, limit: int, minutes: float | None) -> None:
    """Arguments of a search, checked before a plan is built."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is 1 to 50")
    if minutes is not None and not (math.isfinite(minutes) and minutes > 0):
        raise ValueError("minutes are finite and positive")
    if query is not None and not query.strip():
        raise ValueError("the query is blank")


def search_problem(query: Column, limit: Column, minutes: Column) -> Column:
    """``check_search`` for rows of arguments: what is wrong with them, or null."""
    blank = F.coalesce(F.trim(F.regexp_replace(query, r"\s+", " ")), F.lit("")) == ""
    odd = minutes.isNotNull() & (F.isnan(minutes) | (F.abs(minutes) == float("inf")) | (minutes <= 0))
    return F.when(blank | ~limit.between(1, 50), "query_or_limit").when(odd, "max_minutes")


def within_cutoff(df: DataFrame, cutoff: float | None, distance: str = "distance") -> DataFrame:
    """Rows of finite distance up to the cutoff; None keeps all."""
    if cutoff is None:
        return df
    if not math.isfinite(cutoff):
        raise ValueError("the cutoff is finite")
    d = F.col(distance)
    return df.filter((d <= cutoff) & ~F.isnan(d) & (F.abs(d) != float("inf")))


def violations(minutes: Column, ceiling: float | None, dataset: Column, scope: Column) -> Column:
    """Sorted subset of {dataset, time} that a candidate breaks."""
    return F.array_compact(F.array(
        F.when(scope.isNotNull() & (dataset != scope), "dataset"), F.when(~under_ceiling(minutes, ceiling), "time"),
    ))


def defective(issues: Column) -> Column:
    """Any issue of severity warning or error."""
    return F.exists(issues, lambda q: q["severity"].isin("warning", "error"))


def capabilities(has_title: Column, has_names: Column, has_steps: Column, measured: Column, servings: Column, complete: Column, clean: Column) -> Column:
    """What a document may be used for; each bit needs the ones before it."""
    searchable = has_title & (has_names | has_steps)
    usable = searchable & clean
    return F.struct(
        searchable.alias("searchable"), usable.alias("evidence_usable"), (usable & measured).alias("quantities_validated"),
        (usable & has_names & has_steps & complete).alias("complete_eligible"), (usable & measured & servings).alias("scalable"),
    )


def readiness(conflicting: Column, blocked: Column, required_open: Column) -> Column:
    """conflicting before blocked before needs_clarification before ready."""
    return F.when(conflicting, "conflicting").when(blocked, "blocked").when(required_open, "needs_clarification").otherwise("ready")


def ordered_pattern(title: Column, terms: Column, most: int = 3) -> Column:
    """The first terms of over two characters occur in the title in this order, any case."""
    kept = F.slice(F.filter(terms, lambda t: F.length(t) > 2), 1, most)
    escaped = F.transform(kept, lambda t: F.regexp_replace(t, r"([%_\\])", r"\\$1"))
    return F.when(F.size(kept) > 0, F.call_function("ilike", title, F.concat(F.lit("%"), F.array_join(escaped, "%"), F.lit("%")))).otherwise(False)


def trigrams(x: Column) -> Column:
    """All distinct runs of three characters of the lower-cased text; null and short texts have none."""
    t = F.lower(F.coalesce(x, F.lit("")))
    return F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 2)), lambda i: F.substring(t, i, F.lit(3)))))


def pattern_trigrams(terms: Column, most: int = 3) -> Column:
    """What every text that ``ordered_pattern`` accepts has among its trigrams."""
    kept = F.slice(F.filter(terms, lambda t: F.length(t) > 2), 1, most)
    return F.array_distinct(F.flatten(F.transform(kept, trigrams)))
