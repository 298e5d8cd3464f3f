"""JSON texts kept within a number of characters: always valid, and counting what went."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of arguments and of a result.
ARGUMENT_CHARS, RESULT_CHARS = 2000, 4000


def json_of(x: Column) -> Column:
    """Any value as JSON text; null as ``null``."""
    listed = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _fitting(parts: Column, room: Column) -> Column:
    """(text, went): the parts, joined by ``, ``, that fit into ``room`` when taken in their order,
    and the number of the others."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("went"))

    def taken(state: Column, part: Column) -> Column:
        longer = F.concat(state["text"], F.when(state["text"] == "", "").otherwise(", "), part)
        fits = F.length(longer) <= room
        return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), (state["went"] + (~fits).cast("int")).alias("went"))

    return F.aggregate(parts, start, taken)


def bounded_object(fields: dict[str, Column], limit: int = ARGUMENT_CHARS) -> Column:
    """An object of the fields, by name, if it has at most ``limit`` characters. Else those that
    fit, tried by name, and their number's rest as ``_truncated``; fields whose value is too
    long go whole, so that no value is half a value."""
    parts = F.array(*(F.concat(F.lit(f'"{name}": '), json_of(fields[name])) for name in sorted(fields)))
    whole = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    mark = F.lit('"_truncated": ')
    spare = F.lit(limit - len('{, "_truncated": }') - len(str(len(fields))))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.transform(
        F.array(_fitting(parts, spare)),
        lambda kept: F.concat(F.lit("{"), kept["text"], F.when(kept["text"] == "", "").otherwise(", "), mark, kept["went"].cast("string"), F.lit("}")))[0])


def bounded_items(items: Column, limit: int = RESULT_CHARS) -> Column:
    """(json, dropped): the longest leading part of the items, as a JSON array, that has at most
    ``limit`` characters, and the number of items behind it. Null is an empty list."""
    items = F.coalesce(items, F.array().cast("array<string>"))
    ends = F.aggregate(
        F.transform(items, lambda x: F.length(json_of(x)) + 2), F.array(F.lit(0)),
        lambda sums, size: F.concat(sums, F.array(F.element_at(sums, -1) + size)))
    count = F.size(F.filter(ends, lambda end: (end > 0) & (end <= limit)))
    json = F.concat(F.lit("["), F.array_join(F.transform(F.slice(items, F.lit(1), count), json_of), ", "), F.lit("]"))
    return F.struct(json.alias("json"), (F.size(items) - count).alias("dropped"))
