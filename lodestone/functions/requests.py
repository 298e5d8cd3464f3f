"""From a request's settled values to the arguments of a search, before any plan is built."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

#: Most pantry terms that count, longest query and longest dish, minutes allowed.
PANTRY_TERMS, QUERY_CHARS, DISH_CHARS, MINUTES = 5, 500, 200, (1, 1440)
#: Constraints that a search keeps but can't enforce.
UNENFORCED = ("cuisine", "dietary_constraints", "equipment", "portions", "preferences", "substitutions", "task_scope")
MODES, DEFAULT_MODE, DEFAULT_CUTOFF = ("fulltext", "vector"), "fulltext", 0.66


@dataclass(frozen=True)
class SearchArguments:
    """The dish decides what is eligible and the pantry only ranks; without a dish any pantry overlap is eligible."""

    query: str
    by_overlap: bool
    pantry: tuple[str, ...]
    max_minutes: float | None
    dataset_id: str | None
    unenforced: tuple[str, ...]
    changes: tuple[str, ...]

    @property
    def has_keys(self) -> bool:
        return bool(self.query)


def ceiling(value: Any) -> float | None:
    """Minutes as a number between 1 and 1440; anything else, booleans included, is no ceiling."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = float(value)
    except ValueError:
        return None
    return number if math.isfinite(number) and MINUTES[0] <= number <= MINUTES[1] else None


def search_arguments(values: Mapping[str, Any], dataset_id: str | None = None) -> SearchArguments:
    """Map ``dish``, ``pantry``, ``time_minutes`` and other settled values to a search."""
    dish = " ".join(str(values.get("dish") or "").split())
    pantry = [p for p in (" ".join(str(x).split())[:DISH_CHARS] for x in values.get("pantry") or ()) if p]
    changes = []
    if len(dish) > DISH_CHARS:
        dish = dish[:DISH_CHARS]
        changes.append("dish_shortened")
    if len(pantry) > PANTRY_TERMS:
        pantry = pantry[:PANTRY_TERMS]
        changes.append("pantry_capped")
    query = (dish or " ".join(pantry))[:QUERY_CHARS]
    kept = tuple(k for k in UNENFORCED if values.get(k) not in (None, "", [], ()))
    return SearchArguments(query, not dish, tuple(pantry), ceiling(values.get("time_minutes")), dataset_id, kept, tuple(changes))


def mode(requested: str | None, configured: str | None = None) -> tuple[str, str]:
    """(mode, where it comes from): explicit before configured before the default; unknown names fail closed."""
    if requested in MODES:
        return requested, "explicit"
    return (configured, "configured") if configured in MODES else (DEFAULT_MODE, "default")


def cutoff(configured: Any = None) -> float:
    try:
        value = float(configured)
    except (TypeError, ValueError):
        return DEFAULT_CUTOFF
    return value if math.isfinite(value) else DEFAULT_CUTOFF


def search_columns(dish: Column, pantry: Column, minutes: Column) -> Column:
    """``search_arguments`` for rows: struct(query, by_overlap, hints, max_minutes, changes).

    ``pantry`` is an array of texts, ``minutes`` a text; what isn't a number is no ceiling.
    """
    whole = collapsed(dish)
    named = F.filter(F.transform(F.coalesce(pantry, F.array().cast("array<string>")), lambda x: F.substring(collapsed(x), 1, DISH_CHARS)), lambda x: x != "")
    hints = F.slice(named, 1, PANTRY_TERMS)
    number = minutes.try_cast("double")
    fine = ~F.isnan(number) & number.between(*MINUTES)
    changes = F.array_compact(F.array(F.when(F.length(whole) > DISH_CHARS, "dish_shortened"), F.when(F.size(named) > PANTRY_TERMS, "pantry_capped")))
    by_overlap = whole == ""
    return F.struct(
        F.substring(F.when(by_overlap, F.array_join(hints, " ")).otherwise(F.substring(whole, 1, DISH_CHARS)), 1, QUERY_CHARS).alias("query"), by_overlap.alias("by_overlap"),
        hints.alias("hints"), F.when(fine, number).alias("max_minutes"), changes.alias("changes"))


def mode_columns(requested: Column, configured: Column) -> Column:
    """``mode`` for rows: struct(mode, source)."""
    asked, fallback = F.coalesce(requested.isin(*MODES), F.lit(False)), F.coalesce(configured.isin(*MODES), F.lit(False))
    return F.struct(
        F.when(asked, requested).when(fallback, configured).otherwise(DEFAULT_MODE).alias("mode"),
        F.when(asked, "explicit").when(fallback, "configured").otherwise("default").alias("source"))
