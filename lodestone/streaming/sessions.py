"""Streaming twins of the session folds: the same events in any number of micro-batches.

Late rows: the watermark is one hour on ``ts``; windows drop what comes later. The folds keep
one small state per session and see a session's rows in time order
within a micro-batch; rows that arrive in a later micro-batch are appended after it, as in a log.
The folds' watermark is ``FORGET``: rows that come later are dropped, and so is the state of a
session that was silent so long, so that states are in proportion to the sessions alive.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
WATERMARK, FORGET = "1 hour", "30 days"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of event files; ``ts`` becomes an instant (UTC), as watermarks need one."""
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the rows are in ``out``, with exactly-once file commits."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    else:  # a whole small aggregate at each trigger: the last one counts
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows")).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{out}/rows")


def _fold(df: DataFrame, keys: list[str], output: str, state: str, step: Callable[[pd.DataFrame, tuple, int], tuple[pd.DataFrame, tuple]], start: tuple, marked: bool = False) -> DataFrame:
    """``step`` gets a group's rows, its state and the watermark in ms; ``marked``: the rows have their watermark already."""
    def fold(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last = held.getCurrentWatermarkMs()
        now = held.get if held.exists else start
        # one session's rows of one micro-batch, which maxFilesPerTrigger bounds
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, now = step(rows, now, last)
        held.update(now)
        held.setTimeoutTimestamp(max(last, int(rows["ts"].max().timestamp() * 1000)) + 1)
        yield out

    return (df if marked else df.withWatermark("ts", FORGET)).groupBy(*keys).applyInPandasWithState(fold, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def numbered(events: DataFrame) -> DataFrame:
    """session_id, event_id, seq: a counter per session that goes on from batch to batch."""
    def step(rows, now, _):
        n = now[0]
        out = pd.DataFrame({"session_id": rows.user_id, "event_id": rows.event_id, "seq": range(n + 1, n + 1 + len(rows))})
        return out, (n + len(rows),)

    return _fold(events, ["user_id"], "session_id long, event_id long, seq long", "n long", step, (0,))


def compare_and_set(events: DataFrame) -> DataFrame:
    """session_id, event_id, accepted, revision: an event is accepted iff its ``expected`` is the
    session's revision, which then grows by one. An event id that comes again (a redelivery, a
    writer's retry) is passed over, so a replay changes nothing; a null expected is refused."""
    def step(rows, now, _):
        revision, accepted, after = now[0], [], []
        for expected in rows.expected:
            accepted.append(expected == revision)
            revision += int(accepted[-1])
            after.append(revision)
        return pd.DataFrame({"session_id": rows.user_id, "event_id": rows.event_id, "accepted": accepted, "revision": after}), (revision,)

    once = events.withWatermark("ts", FORGET).dropDuplicatesWithinWatermark(["event_id"])
    return _fold(once, ["user_id"], "session_id long, event_id long, accepted boolean, revision long", "revision long", step, (0,), marked=True)


def claims(events: DataFrame, cap: int) -> DataFrame:
    """session_id, event_id, granted: the first ``cap`` claims of a session are granted."""
    def step(rows, now, _):
        n = now[0]
        out = pd.DataFrame({"session_id": rows.user_id, "event_id": rows.event_id, "granted": [n + i < cap for i in range(len(rows))]})
        return out, (n + len(rows),)

    return _fold(events, ["user_id"], "session_id long, event_id long, granted boolean", "n long", step, (0,))


def stalls(events: DataFrame, nth: int = 3) -> DataFrame:
    """session_id, event_id of each ``nth`` identical call (type and payload).

    A session's state holds a count for each of its calls, and goes without those that were silent for ``FORGET``.
    """
    def step(rows, now, watermark):
        counts = {(kind, props): (n, until) for kind, props, n, until in json.loads(now[0])}
        at = rows.ts.to_numpy().astype("datetime64[ms]").astype("int64").tolist()
        hit, came = [], set()
        for i, (kind, props, ms) in enumerate(zip(rows.event_type, rows.props, at)):
            call = (kind, props)
            n = counts[call][0] + 1 if call in counts else 1
            counts[call] = (n, max(watermark, ms) + 1)
            came.add(call)
            if n == nth:
                hit.append(i)
        kept = [[*call, n, until] for call, (n, until) in counts.items() if call in came or until >= watermark]
        return pd.DataFrame({"session_id": rows.user_id.iloc[hit], "event_id": rows.event_id.iloc[hit]}), (json.dumps(kept),)

    return _fold(events, ["user_id"], "session_id long, event_id long", "calls string", step, ("[]",))


def retained(events: DataFrame, before: str, kinds: tuple[str, ...]) -> DataFrame:
    """Events that the retention rule keeps; stateless."""
    return events.filter(~(F.col("event_type").isin(*kinds) & (F.col("ts") < F.lit(before).cast("timestamp"))))


def windowed(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window and type, late rows beyond the watermark dropped."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def deduplicated(events: DataFrame) -> DataFrame:
    """Repeated event ids within the watermark's span pass once."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
