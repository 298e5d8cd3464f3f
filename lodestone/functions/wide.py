"""Exact rational amounts of any size as (num, den) pairs of binary integers.

An integer is its shortest big-endian two's complement, a pair is in lowest terms with a positive
denominator: equal amounts have equal bytes, so that they can be grouped and joined by. Whole
Arrow batches go to Python's integers, which have no greatest value; Spark has no such type.
Null gives null, and so does a divisor of 0.

Operands are such pairs, pairs of 64-bit integers as in ``rational``, whole numbers, decimals, or
texts that ``read`` takes. A ``product`` is one pass over a batch, however many operands it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from . import rational

PAIR = StructType([StructField("num", BinaryType()), StructField("den", BinaryType())])
#: Decimal digits that Python turns into an integer at once, well below its own limit, bits of numbers with fewer, and 1 with so many zeros.
DIGITS = 4000
_SHORT = 13_000
_PART = 10**DIGITS


def _bytes(n: int) -> bytes:
    return n.to_bytes((n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big", signed=True)


def _parsed(digits: str) -> int:
    n = 0
    for at in range(0, len(digits), DIGITS):
        part = digits[at : at + DIGITS]
        n = n * 10 ** len(part) + int(part)
    return n


def _written(n: int) -> str:
    if n.bit_length() < _SHORT:
        return str(n)
    rest, parts = abs(n), []
    while rest >= _PART:
        rest, part = divmod(rest, _PART)
        parts.append(str(part).zfill(DIGITS))
    return "-" * (n < 0) + str(rest) + "".join(reversed(parts))


_AMOUNT = re.compile(r"(-?)([0-9]+)(?:/([0-9]+))?")


def _fraction(text: str | None) -> tuple[int, int]:
    if text is None:
        return 0, 0
    top, _, bottom = text.partition("/")
    if len(text) <= DIGITS and text.isascii() and top.isdigit() and (bottom.isdigit() or len(top) == len(text)):
        return int(top), int(bottom or 1)
    found = _AMOUNT.fullmatch(text)
    return (_parsed(found[2]) * (-1 if found[1] else 1), _parsed(found[3] or "1")) if found else (0, 0)


def _integers(x: pa.Array) -> Sequence[int]:
    if not pa.types.is_integer(x.type):
        raise TypeError(f"{x.type} is no operand of exact amounts")
    return x.fill_null(0).to_numpy(zero_copy_only=False).tolist()


def _unscaled(x: pa.Array) -> Sequence[int]:
    """A decimal's digits as an integer, 0 for null."""
    low, high = np.frombuffer(x.buffers()[1], "<i8").reshape(-1, 2)[x.offset : x.offset + len(x)].T * x.is_valid().to_numpy(zero_copy_only=False)
    if (high == low >> 63).all():
        return low.tolist()
    return [(h << 64) | l for h, l in zip(high.tolist(), low.view("<u8").tolist())]


def _operand(x: pa.Array) -> tuple[Sequence[int], Sequence[int]]:
    """Numerators and denominators; null is 0/0."""
    if not len(x):
        return [], []
    if pa.types.is_struct(x.type):
        num, den = x.flatten()
        if pa.types.is_integer(num.type):
            return _integers(num), _integers(den)
        return [_int(b) for b in num.fill_null(b"").to_pylist()], [_int(b) for b in den.fill_null(b"").to_pylist()]
    if pa.types.is_string(x.type):
        rows = [_fraction(t) for t in x.to_pylist()]
        return [n for n, _ in rows], [d for _, d in rows]
    if pa.types.is_decimal128(x.type):
        num, one = _unscaled(x), 10**x.type.scale
    else:
        num, one = _integers(x), 1
    return num, [one] * len(x) if not x.null_count else [one * v for v in x.is_valid().to_numpy(zero_copy_only=False).tolist()]


def _multiplied(a: Iterable[int], b: Iterable[int]) -> list[int]:
    return [x * y for x, y in zip(a, b)]


_TYPE = pa.struct([("num", pa.binary()), ("den", pa.binary())])


def _lowest(nums: Sequence[int], dens: Sequence[int]) -> Iterator[tuple[int, int]]:
    """In lowest terms; 0/0 where the denominator is 0."""
    for n, d in zip(nums, dens):
        if d == 1:
            yield n, 1
        elif d:
            g = gcd(n, d) if d > 0 else -gcd(n, d)
            yield n // g, d // g
        else:
            yield 0, 0


def _pairs(rows: Iterable[tuple[int, int]]) -> pa.Array:
    rows = list(rows)
    columns = [pa.array([_bytes(r[i]) for r in rows], pa.binary()) for i in (0, 1)]
    return pa.StructArray.from_arrays(columns, fields=list(_TYPE), mask=pa.array([not d for _, d in rows], pa.bool_()))


def _texts(rows: Iterable[tuple[int, int]]) -> pa.Array:
    return pa.array([_written(n) if d == 1 else f"{_written(n)}/{_written(d)}" if d else None for n, d in rows], pa.string())


def _ratio(operands: Sequence[pa.Array], factors: int) -> Iterator[tuple[int, int]]:
    """The first ``factors`` operands over the product of the others."""
    num, den = _operand(operands[0])
    for i, x in enumerate(operands[1:], 1):
        n, d = _operand(x)
        if i >= factors:  # null stays 0/0; a divisor of 0 gives a denominator of 0
            n, d = _multiplied(d, d), _multiplied(n, d)
        num, den = _multiplied(num, n), _multiplied(den, d)
    return _lowest(num, den)


@arrow_udf(PAIR)
def _plus(a: pa.Array, b: pa.Array) -> pa.Array:
    (an, ad), (bn, bd) = _operand(a), _operand(b)
    return _pairs(_lowest([x * v + u * y for x, y, u, v in zip(an, ad, bn, bd)], _multiplied(ad, bd)))


def product(factors: Sequence[Column], divisors: Sequence[Column] = ()) -> Column:
    """The product of ``factors`` over that of ``divisors``, brought to lowest terms once."""
    k = len(factors)
    return arrow_udf(lambda *x: _pairs(_ratio(x, k)), PAIR)(*factors, *divisors)


def product_text(factors: Sequence[Column], divisors: Sequence[Column] = ()) -> Column:
    """``text`` of ``product``, without a pair between them."""
    k = len(factors)
    return arrow_udf(lambda *x: _texts(_ratio(x, k)), StringType())(*factors, *divisors)


def reduced(num: Column, den: Column) -> Column:
    """Two 64-bit integers as an amount."""
    return product([num.cast("long")], [den.cast("long")])


def read(text: Column) -> Column:
    """``n`` or ``n/d``, of any number of digits, n with a minus or not; all else is null."""
    return product([text.cast("string")])


def times(a: Column, b: Column) -> Column:
    return product([a, b])


def over(a: Column, b: Column) -> Column:
    return product([a], [b])


def plus(a: Column, b: Column) -> Column:
    return _plus(a, b)


def text(a: Column) -> Column:
    """``n`` or ``n/d``."""
    return product_text([a])


def convert(amount: Column, source: Column, target: Column) -> Column:
    """struct(amount, refusal), as ``rational.convert`` refuses."""
    refusal = rational.refusal(source, target)
    count = (rational.unit_family(source) == "none") & (rational.unit_family(target) == "none")
    one = F.struct(F.lit(1).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    # where it is refused, a factor is null, and so is the amount
    fa, fb = (F.when(refusal.isNull(), F.when(count, one).otherwise(rational.factor(rational.canonical_unit(u)))) for u in (source, target))
    return F.struct(product([amount, fa], [fb]).alias("amount"), refusal.alias("refusal"))
