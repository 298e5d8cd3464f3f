"""Leaves of JSON texts of any depth: each text is parsed once and walked once, where it lies."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels and digits of a number that Spark's own parser takes, leaves that go on together, and steps of paths that a worker keeps.
DEEPEST, LONGEST, TOGETHER, STEPS = 1000, 1000, 20_000, 100_000
_PLAIN = re.compile("[A-Za-z_][A-Za-z0-9_]*")
_ESCAPED = str.maketrans({chr(i): f"\\u{i:04X}" for i in range(32)} | {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"})


class _Object(list):
    """Pairs of names and values."""


class _Integer(str):
    """A number without point and exponent, as written."""


class _Number(str):
    """Any other number, as written."""


def _refused(x: str):
    raise ValueError(x)


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Integer, parse_float=_Number, parse_constant=_refused)
_steps: dict[str, str] = {}


def _step(name: str) -> str:
    found = _steps.get(name)
    if found is None:
        if len(_steps) >= STEPS:
            _steps.clear()
        found = _steps[name] = f".{name}" if _PLAIN.fullmatch(name) else f'["{name.translate(_ESCAPED)}"]'
    return found


def _walked(text: str) -> tuple[list[str], list[str], list[str | None]]:
    """Paths, kinds and values of the leaves; ValueError where the text isn't JSON."""
    paths, kinds, values = [], [], []
    level, depth = [("$", _DECODER.decode(text))], 0
    while level:
        inner, boxes = [], False
        for path, v in level:
            of = type(v)
            if of is _Object or of is list:
                boxes = True
                if v:
                    if of is list:
                        inner += [(f"{path}[{i}]", x) for i, x in enumerate(v)]
                        continue
                    if len({k for k, _ in v}) < len(v):
                        raise ValueError("a name stands twice")
                    inner += [(path + _step(k), x) for k, x in v]
                    continue
                kind, v = "array" if of is list else "object", None
            elif of is str:
                kind = "string"
            elif of is bool:
                kind, v = "boolean", "true" if v else "false"
            elif v is None:
                kind = "null"
            else:
                if len(v) - v.startswith("-") > LONGEST:
                    raise ValueError("a number is too long")
                # what isn't plain is left to Spark
                kind = "integer" if of is _Integer and len(v) < 19 and v != "-0" else "number"
            paths.append(path)
            kinds.append(kind)
            values.append(v)
        depth += boxes
        if depth > DEEPEST:
            raise ValueError("too deep")
        level = inner
    return paths, kinds, values


def _kind(v: Column) -> Column:
    """integer or number."""
    schema = F.schema_of_variant(v)
    return F.when((schema == "BIGINT") | schema.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("number")


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half a pair of surrogates, by its escape
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def leaves(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """(keys, path, kind, value, malformed): one row per leaf of each row's JSON text.

    Paths are as in ``$.a.b[0].c``; a name with other characters than letters, digits and _ stands
    as ``$["a b"]``. Empty objects and arrays are leaves with a null value, as are JSON nulls. A
    text that isn't JSON gives one row with path ``$`` and ``malformed``; a null text gives none.
    A text of more than 1000 levels, or with a name twice in one object, counts as malformed, as in
    Spark's variants. Numbers are written as Spark's variants write them.
    """

    def walked(batches):
        for batch in batches:
            kept, rows, paths, kinds, values = batch.select(batch.schema.names[:-1]), [], [], [], []

            def made():
                own, kind = kept.take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())
                return pa.RecordBatch.from_arrays(
                    [*own.columns, _strings(paths), kind, _strings(values), kind.is_null()], names=[*own.schema.names, "path", "kind", "value", "malformed"])

            for i, text in enumerate(batch.columns[-1].to_pylist()):
                if text is None:
                    continue
                try:
                    found = _walked(str(text, "utf-8", "replace"))
                except (ValueError, RecursionError):
                    found = ["$"], [None], [None]
                for held, x in zip((paths, kinds, values), found):
                    held += x
                rows += [i] * len(found[0])
                if len(rows) >= TOGETHER:
                    yield made()
                    rows, paths, kinds, values = [], [], [], []
            if rows:
                yield made()

    # bytes that aren't UTF-8 come as they are
    texts = df.select(*keys, F.col(json_col).cast("string").cast("binary").alias("json"))
    fields = [*df.select(*keys).schema.fields, *(T.StructField(n, T.StringType()) for n in ("path", "kind", "value")), T.StructField("malformed", T.BooleanType())]
    number = F.try_parse_json("value")
    plain = F.col("kind") != "number"
    return texts.mapInArrow(walked, T.StructType(fields)).select(
        *keys, "path", F.when(plain | F.col("kind").isNull(), F.col("kind")).otherwise(_kind(number)).alias("kind"),
        F.when(plain | F.col("kind").isNull(), F.col("value")).otherwise(F.variant_get(number, "$", "string")).alias("value"), "malformed")
