"""Checks of interpreted lines against their source, as one row per problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rational as R
from ..functions.text import plain

#: Problem codes by what they mean for the whole record.
FATAL = ("identity_mismatch", "stale_source", "evidence_unknown_line", "fabricated_evidence")
MAJOR = ("missing_evidence", "quantity_unresolved", "amount_inconsistent", "unsupported_unit", "name_contains_measure")


def problems(items: DataFrame) -> DataFrame:
    """(record, position, code) for items with columns record, position, expected_record, hash, expected_hash,
    line (the cited line's text, null if there is none), excerpt, name, amount_text, amount_value, unit, is_range, uncertain."""
    has_number = F.coalesce(F.col("amount_text").rlike("[0-9¼½¾⅓⅔⅛⅜⅝⅞]"), F.lit(False))
    value, written = R.quantity(F.col("amount_value")), R.quantity(F.col("amount_text"))
    cited = F.coalesce(F.trim("excerpt"), F.lit("")) != ""
    open_amount = F.col("amount_value").isNull() & has_number
    preserved = F.coalesce(F.col("is_range"), F.lit(False)) | F.coalesce(F.col("uncertain"), F.lit(False))
    tests: list[tuple[str, Column]] = [
        ("identity_mismatch", ~F.col("record").eqNullSafe(F.col("expected_record"))),
        ("stale_source", ~F.col("hash").eqNullSafe(F.col("expected_hash"))),
        ("missing_evidence", ~cited),
        ("evidence_unknown_line", cited & F.col("line").isNull()),
        ("fabricated_evidence", cited & F.col("line").isNotNull() & ~plain(F.col("line")).contains(plain(F.col("excerpt")))),
        ("quantity_uncertain", open_amount & preserved),
        ("quantity_unresolved", open_amount & ~preserved),
        ("amount_inconsistent", value.isNotNull() & written.isNotNull() & ~((value["num"] == written["num"]) & (value["den"] == written["den"]))),
        ("malformed_amount", F.col("amount_value").isNotNull() & value.isNull()),
        ("unsupported_unit", F.col("unit").isNotNull() & R.canonical_unit(F.col("unit")).isNull()),
        ("name_contains_measure", F.coalesce(F.col("name").rlike(r"^\s*\d") & ~F.col("name").rlike(r"^\s*\d+\s*%"), F.lit(False))),
    ]
    codes = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), code) for code, test in tests)))
    return items.select("record", "position", F.explode(codes).alias("code"))


def verdicts(items: DataFrame) -> DataFrame:
    """Per record: rejected (a fatal code), needs_retry (a major one), uncertain (any other) or valid."""
    found = problems(items).groupBy("record").agg(F.collect_set("code").alias("codes"))
    every = items.select("record").distinct().join(found, "record", "left")
    has = lambda names: F.coalesce(F.arrays_overlap("codes", F.array(*map(F.lit, names))), F.lit(False))
    return every.select("record", F.when(has(FATAL), "rejected").when(has(MAJOR), "needs_retry").when(F.col("codes").isNotNull(), "uncertain").otherwise("valid").alias("verdict"))
