"""Folds over append-only session logs (session_id, seq, event_type, ...)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phases and the moves between them.
MOVES = {
    "collecting": ("planning", "abandoned"), "planning": ("collecting", "retrieving", "abandoned"), "retrieving": ("choosing", "planning", "abandoned"),
    "choosing": ("writing", "retrieving", "abandoned"), "writing": ("done", "choosing", "abandoned"),
}


def ordered(*more: str) -> Window:
    return Window.partitionBy("session_id").orderBy("seq", *more)


def appended(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New events numbered on from each session's last seq; the log itself never changes."""
    last = log.groupBy("session_id").agg(F.max("seq").alias("last_"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return new.join(last, "session_id", "left").withColumn("seq", F.coalesce("last_", F.lit(0)) + nth).drop("last_")


def cas(updates: DataFrame) -> DataFrame:
    """Compare-and-set in seq order: an update (expected) is accepted iff it names the current revision.

    Gives session_id, seq, accepted and revision (after the event); ties of seq go by expected, a
    null expected is refused, null sessions are one session. A session's rows pass through its task
    in sorted batches, of which only the revision is kept: memory doesn't grow with a session.
    """
    def fold(batches):
        session, revision = object(), 0
        for batch in batches:
            accepted, after = [], []
            for s, expected in zip(batch["session_id"].to_pylist(), batch["expected"].to_pylist()):
                if s != session:
                    session, revision = s, 0
                accepted.append(expected == revision)
                revision += accepted[-1]
                after.append(revision)
            yield pa.RecordBatch.from_arrays(
                [batch["session_id"], batch["seq"], pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], names=["session_id", "seq", "accepted", "revision"])

    rows = updates.select("session_id", F.col("seq").cast("long"), F.col("expected").cast("long"))
    kind = rows.schema["session_id"].dataType.simpleString()
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq", "expected").mapInArrow(
        fold, f"session_id {kind}, seq long, accepted boolean, revision long")


def claimed(events: DataFrame, claim: Column, cap: int) -> DataFrame:
    """Slot claims in order: granted while fewer than ``cap`` came before."""
    before = F.sum(claim.cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("nth_", before).filter(claim).withColumn("granted", F.col("nth_") <= cap).drop("nth_")


def latest_run(events: DataFrame, opens: Column) -> DataFrame:
    """Events after the last event that opens a run, of sessions that have one."""
    start = F.max(F.when(opens, F.col("seq"))).over(Window.partitionBy("session_id"))
    return events.withColumn("start_", start).filter(F.col("seq") > F.col("start_")).drop("start_")


def covered_slices(events: DataFrame, start: str, stop: str) -> DataFrame:
    """Distinct positions that ranged reads [start, stop) of each session cover; ranges are at most 200 long."""
    safe = events.filter((F.col(stop) > F.col(start)) & (F.col(stop) - F.col(start) <= 200))
    return safe.select("session_id", F.explode(F.sequence(F.col(start), F.col(stop) - 1)).alias("pos")).distinct().groupBy("session_id").agg(F.count("*").alias("covered"))


def stalls(calls: DataFrame, same: list[str], nth: int = 3) -> DataFrame:
    """The ``nth`` identical call of a session, by the given columns."""
    w = Window.partitionBy("session_id", *same).orderBy("seq")
    return calls.withColumn("times", F.row_number().over(w)).filter(F.col("times") == nth)


def pairing(rows: DataFrame, key: list[str], call: Column, output: Column) -> DataFrame:
    """Keys that don't have exactly one call and one output."""
    n = rows.groupBy(*key).agg(F.count_if(call).alias("calls"), F.count_if(output).alias("outputs"))
    return n.filter((F.col("calls") != 1) | (F.col("outputs") != 1)).withColumn(
        "problem", F.when(F.col("calls") == 0, "no_call").when(F.col("calls") > 1, "several_calls").when(F.col("outputs") == 0, "no_output").otherwise("several_outputs"))


def illegal_moves(events: DataFrame, phase: str) -> DataFrame:
    """Events whose phase can't follow the one before it."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    before = F.lag(phase).over(ordered())
    rows = events.withColumn("before", before)
    ok = F.col("before").isNull() | (F.col("before") == F.col(phase)) | F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col(phase)), F.lit(False))
    return rows.filter(~ok)
