"""Amounts of any size against Python's fractions."""

import random
import sys
import time
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import wide as W


def shown(x):
    return str(x) if x is not None else None


@pytest.fixture
def long_numbers():
    """Python's own limit of digits is lifted here, not in Spark's workers."""
    before = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    yield
    sys.set_int_max_str_digits(before)


def test_against_fractions(spark, long_numbers):
    rng = random.Random(5)
    number = lambda: rng.choice((-1, 1)) * rng.randrange(10 ** rng.choice((1, 18, 19, 200)))
    rows = [(i, f"{number()}/{rng.randrange(1, 10**200)}", f"{number()}/{rng.randrange(1, 10 ** rng.choice((1, 200)))}") for i in range(300)]
    rows += [(900, "0", "5"), (901, str(2**63), str(-(2**63))), (902, "7/7", "-128"), (903, "255", "-1/256"), (904, "9" * 9001, "1/" + "3" * 5000)]
    df = spark.createDataFrame(rows, "i long, a string, b string").select("i", W.read(F.col("a")).alias("a"), W.read(F.col("b")).alias("b"))
    got = df.select("i", *(W.text(x).alias(n) for n, x in (("a", F.col("a")), ("p", W.times(F.col("a"), F.col("b"))), ("q", W.over(F.col("a"), F.col("b"))), ("s", W.plus(F.col("a"), F.col("b"))))))
    got = {r.i: r for r in got.collect()}
    for i, a, b in rows:
        x, y = Fraction(a), Fraction(b)
        assert (got[i].a, got[i].p, got[i].q, got[i].s) == (shown(x), shown(x * y), shown(x / y if y else None), shown(x + y))


def test_nulls_equal_bytes_and_units(spark):
    bad = spark.createDataFrame([(x,) for x in (None, "", "1/0", "1/2/3", "x", "+1", "1.5")], "t string").select(W.read(F.col("t")).alias("q"))
    assert bad.filter("q is not null").count() == 0 and bad.filter(W.text(W.times(F.col("q"), F.col("q"))).isNotNull()).count() == 0
    same = spark.createDataFrame([("2/4",), ("1/2",), ("0050/100",), ("-1/2",)], "t string").groupBy(W.read(F.col("t")).alias("q")).count()
    assert sorted(r["count"] for r in same.collect()) == [1, 3]
    units = spark.createDataFrame([("3", "lb", "mg"), ("3", "", ""), ("3", "cup", "g"), ("3", "jug", "g"), (None, "g", "g")], "t string, a string, b string")
    c = W.convert(W.read(F.col("t")), F.col("a"), F.col("b"))
    got = [tuple(r) for r in units.select(c.alias("c")).select(W.text(F.col("c.amount")), "c.refusal").collect()]
    assert got == [("136077711/100", None), ("3", None), (None, "different_dimension"), (None, "unknown_unit"), (None, None)]


def test_queries_take_keys_whose_amounts_pass_64_bits(spark, tmp_path):
    from lodestone.catalog import queries

    rows = [(7, 2, 300_000, 5), (2**40, 1, 9_000_000_000, 2**33), (1, 7, 300_001, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r for r in queries()["mth05_wide_conversion"](spark, str(tmp_path)).collect()}
    for o, n, p, _ in rows:
        if p % 3 == 0:
            assert Fraction(got[o].milligrams) == Fraction((p * 10**14 + o) * 45359237, n * 100)
        else:
            assert got[o].refusal
    got = {r.l_orderkey: r for r in queries()["mth06_wide_scaling"](spark, str(tmp_path)).collect()}
    for o, n, p, s in rows:
        assert got[o].unknown == (o % 7 == 0) and (o % 7 == 0 or Fraction(got[o].scaled) == Fraction((p * 10**12 + n) * (s * 10**12 + 6), o % 7))


def test_decimals_and_whole_numbers_are_operands_of_one_pass(spark):
    rng = random.Random(6)
    rows = [(i, Decimal(rng.choice((-1, 1)) * rng.randrange(10 ** rng.choice((1, 18, 19, 38)))), Decimal(rng.randrange(-(10**9), 10**9)).scaleb(-4), rng.randrange(-3, 4)) for i in range(400)]
    rows += [(900, None, Decimal(1), 1), (901, Decimal(2**64), None, 1), (902, Decimal(-(2**63)), Decimal(1), None), (903, Decimal(-(2**63) - 1), Decimal(1), -1), (904, Decimal(0), Decimal(0), 5)]
    df = spark.createDataFrame(rows, "i long, a decimal(38,0), b decimal(20,4), n long")
    shown_in_one = W.product_text([F.col("a"), F.col("b")], [F.col("n"), F.lit("-7/3")])
    got = df.select("i", shown_in_one.alias("x"), W.text(W.over(W.times(F.col("a"), F.col("b")), W.times(F.col("n"), F.lit("-7/3")))).alias("y"))
    got = {r.i: (r.x, r.y) for r in got.collect()}
    for i, a, b, n in rows:
        want = None if None in (a, b, n) or n == 0 else str(Fraction(a) * Fraction(b) / (n * Fraction(-7, 3)))
        assert got[i] == (want, want)


def test_floats_are_refused_and_slices_are_read():
    with pytest.raises(TypeError):
        W._operand(pa.array([1.5]))
    assert list(W._operand(pa.array([Decimal(5), None, Decimal(-(2**70))], pa.decimal128(38, 0))[1:])) == [[0, -(2**70)], [0, 1]]


def test_scaling_is_one_pass_and_a_number_is_written_at_once(spark):
    from lodestone.catalog import queries

    plan = queries()["mth06_wide_scaling"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    start = time.process_time()
    for n in range(20_000):
        W._written(n * 10**25)
    assert time.process_time() - start < 0.5  # about 1.3 s where 10**4000 is made for each
