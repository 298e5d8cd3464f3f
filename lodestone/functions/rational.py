"""Exact rational amounts as (num, den) pairs of 64-bit integers, units and conversion.

An amount that doesn't fit is null, never rounded; ``wide`` has amounts of any size.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

#: Units by dimension, each with its factor to the first of its group as (num, den).
UNITS: dict[str, dict[str, tuple[int, int]]] = {
    "mass": {"g": (1, 1), "kg": (1000, 1), "mg": (1, 1000), "oz": (45359237, 1600000), "lb": (45359237, 100000)},
    "volume": {"ml": (1, 1), "l": (1000, 1), "tsp": (492892159375, 100000000000), "tbsp": (1478676478125, 100000000000), "cup": (236588236500, 1000000000)},
}
ALIASES = {
    "gram": "g", "grams": "g", "kilogram": "kg", "kilograms": "kg", "milligram": "mg", "ounce": "oz", "ounces": "oz", "pound": "lb", "pounds": "lb", "lbs": "lb",
    "milliliter": "ml", "milliliters": "ml", "liter": "l", "liters": "l", "litre": "l", "teaspoon": "tsp", "teaspoons": "tsp", "tablespoon": "tbsp",
    "tablespoons": "tbsp", "cups": "cup",
}


PAIR = StructType([StructField("num", LongType()), StructField("den", LongType())])
_LIMIT = float(2**62)


def _integers(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values (0 where null) and where they are there."""
    there = x.notna().to_numpy()
    return np.array([int(v) for v in x[there]], np.int64) if x.dtype.kind not in "iu" and there.any() else x[there].to_numpy(np.int64), there


def _pairs(num: np.ndarray, den: np.ndarray, ok: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"num": pd.array(num, "Int64"), "den": pd.array(den, "Int64")})
    out[~ok] = pd.NA
    return out


def _filled(*columns: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    out, ok = [], np.ones(len(columns[0]), bool)
    for x in columns:
        values, there = _integers(x)
        full = np.zeros(len(x), np.int64)
        full[there] = values
        out.append(full)
        ok &= there
    return out, ok


# numpy has a greatest common divisor and Spark none: whole Arrow batches, not steps of Euclid per row
@pandas_udf(PAIR)
def _reduced(num: pd.Series, den: pd.Series) -> pd.DataFrame:
    (n, d), ok = _filled(num, den)
    ok &= d != 0
    g = np.maximum(np.gcd(n, d), 1) * np.where(d < 0, -1, 1)
    return _pairs(n // g, d // g, ok)


@pandas_udf(PAIR)
def _times(an: pd.Series, ad: pd.Series, bn: pd.Series, bd: pd.Series) -> pd.DataFrame:
    (a, b, c, d), ok = _filled(an, ad, bn, bd)
    ok &= (b != 0) & (d != 0)
    g, h = np.maximum(np.gcd(a, d), 1), np.maximum(np.gcd(c, b), 1)
    a, d, c, b = a // g, d // g, c // h, b // h
    ok &= (np.abs(a.astype(float) * c) < _LIMIT) & (np.abs(b.astype(float) * d) < _LIMIT)
    num, den = a * c, b * d
    sign = np.where(den < 0, -1, 1)
    return _pairs(num * sign, den * sign, ok)


def reduced(num: Column, den: Column) -> Column:
    """Lowest terms with a positive denominator; null where either is null or den is 0."""
    pair = _reduced(num.cast("long"), den.cast("long"))
    return F.when(pair["num"].isNotNull(), pair)


def quantity(text: Column) -> Column:
    """``3``, ``1.5``, ``1/2``, ``1 1/2`` as a reduced pair; all else, ranges, units and zero are null."""
    t = F.trim(text)
    whole = F.regexp_extract(t, r"^([0-9]{1,9})(?: ([0-9]{1,9})/([0-9]{1,9}))?$", 1)
    mixed_num, mixed_den = (F.regexp_extract(t, r"^[0-9]{1,9} ([0-9]{1,9})/([0-9]{1,9})$", i) for i in (1, 2))
    top, bottom = (F.regexp_extract(t, r"^([0-9]{1,9})/([0-9]{1,9})$", i) for i in (1, 2))
    left, right = (F.regexp_extract(t, r"^([0-9]{1,9})\.([0-9]{1,6})$", i) for i in (1, 2))
    number = lambda x: F.when(x != "", x).cast("long")
    power = F.pow(F.lit(10), F.length(right)).cast("long")
    num = (
        F.when(mixed_num != "", number(whole) * number(mixed_den) + number(mixed_num)).when(whole != "", number(whole))
        .when(top != "", number(top)).when(left != "", number(left) * power + number(right))
    )
    den = F.when(mixed_num != "", number(mixed_den)).when(whole != "", F.lit(1)).when(top != "", number(bottom)).when(left != "", power)
    out = reduced(num, den)
    return F.when((num > 0) & (den > 0), out)


def times(a: Column, b: Column) -> Column:
    """Product in lowest terms, crossed out before it is multiplied; null beyond 62 bits."""
    pair = _times(a["num"], a["den"], b["num"], b["den"])
    return F.when(pair["num"].isNotNull(), pair)


def over(a: Column, b: Column) -> Column:
    """Quotient; null for a divisor of 0."""
    return times(a, F.when(b["num"] != 0, F.struct(b["den"].alias("num"), b["num"].alias("den"))))


def text(a: Column) -> Column:
    """``n`` or ``n/d``."""
    return F.when(a["den"] == 1, a["num"].cast("string")).otherwise(F.concat(a["num"].cast("string"), F.lit("/"), a["den"].cast("string")))


def canonical_unit(unit: Column) -> Column:
    """A unit's short name; unknown units are null."""
    t = F.rtrim(F.lower(F.trim(unit)), F.lit("."))
    table = F.create_map(*[F.lit(x) for kv in ({u: u for g in UNITS.values() for u in g} | ALIASES).items() for x in kv])
    return F.try_element_at(table, t)


def unit_family(unit: Column) -> Column:
    """mass, volume, other or none."""
    u = canonical_unit(unit)
    out = F.when(F.coalesce(F.trim(unit), F.lit("")) == "", "none")
    for family, units in UNITS.items():
        out = out.when(u.isin(*units), family)
    return out.otherwise("other")


def factor(unit: Column) -> Column:
    out = None
    for units in UNITS.values():
        for u, (n, d) in units.items():
            g = gcd(n, d)
            pair = F.struct(F.lit(n // g).cast("long").alias("num"), F.lit(d // g).cast("long").alias("den"))
            out = F.when(unit == u, pair) if out is None else out.when(unit == u, pair)
    return out


def refusal(source: Column, target: Column) -> Column:
    """Why an amount can't be converted; null if it can."""
    a, b = canonical_unit(source), canonical_unit(target)
    fa, fb = unit_family(source), unit_family(target)
    return F.when((fa == "none") & (fb == "none"), F.lit(None)).when(a.isNull() | b.isNull(), "unknown_unit").when(fa != fb, "different_dimension").otherwise(F.lit(None))


def convert(amount: Column, source: Column, target: Column) -> Column:
    """struct(amount, refusal): refuses unknown units and those of another dimension; a number
    without unit converts to itself."""
    a, b = canonical_unit(source), canonical_unit(target)
    fa, fb = unit_family(source), unit_family(target)
    why = refusal(source, target)
    value = F.when((fa == "none") & (fb == "none"), amount).otherwise(over(times(amount, factor(a)), factor(b)))
    return F.struct(F.when(why.isNull(), value).alias("amount"), why.alias("refusal"))


def iso_minutes(x: Column) -> Column:
    """``PT#H#M#S`` in minutes; null unless at least one part is there."""
    pattern = r"^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?$"
    h, m, s = (F.regexp_extract(x, pattern, i) for i in (1, 2, 3))
    number = lambda t: F.coalesce(F.when(t != "", t).cast("double"), F.lit(0.0))
    return F.when((h != "") | (m != "") | (s != ""), number(h) * 60 + number(m) + number(s) / 60)
