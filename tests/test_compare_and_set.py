"""Compare-and-set in batch and as a stream against a plain loop, with a restart and a replay."""

import random
from datetime import datetime, timedelta

from lodestone.operators import events
from lodestone.streaming import sessions

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def log(n=400, seed=3):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    # session 1 holds more than a third of all rows
    return [(i, start + timedelta(seconds=i), rng.choice((1, 1, 2, 3)), "purchase", None, rng.choice(("0", "1", "2", "3", "5", None))) for i in range(n)]


def looped(rows):
    revision, out = {}, []
    for i, _, user, *_, expected in rows:
        now = revision.setdefault(user, 0)
        ok = expected is not None and int(expected) == now
        revision[user] = now + ok
        out.append((user, i, ok, revision[user]))
    return sorted(out)


def test_batch_equals_loop(spark):
    rows = log()
    df = spark.createDataFrame([(u, i, None if e is None else int(e), "x") for i, _, u, _, _, e in rows], "session_id long, seq long, expected long, revision string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, events.cas(df).collect())) == looped(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert events.cas(df.limit(0)).columns == ["session_id", "seq", "accepted", "revision"] and events.cas(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, 1, 0), (None, 2, None), (None, 2, 1), (None, 2, 1)], "session_id string, seq int, expected int")
    assert sorted(tuple(r)[1:] for r in events.cas(null).collect()) == [(1, True, 1), (2, False, 1), (2, False, 2), (2, True, 2)]


def test_stream_equals_loop_after_restart_and_replay(spark, tmp_path):
    rows = log()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def drained():
        stream = sessions.read_events(spark, source, "*.parquet", 1)
        return sessions.run(sessions.compare_and_set(stream.withColumn("expected", stream["props"].cast("long"))), out)

    arrive(rows[:150])
    arrive(rows[150:200])
    assert sorted(map(tuple, drained().collect())) == looped(rows[:200])
    arrive(rows[100:200])  # comes again, after a restart
    arrive(rows[180:400])
    assert sorted(map(tuple, drained().collect())) == looped(rows)
