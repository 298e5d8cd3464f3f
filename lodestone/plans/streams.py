"""Queries: Structured Streaming twins, each run over all event files to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import SESSIONS_SQL, table
from ..streaming import sessions as S
from .ingest import _folder


#: Files that the events are dealt over, by time; each is a micro-batch of its own.
FILES = 4


def arriving(spark, d):
    """The events as a stream of several files, one after another in order of time."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = [None, *e.approxQuantile("at", [k / FILES for k in range(1, FILES)], 0.01), None]
    folder = _folder(spark)
    for lo, hi in zip(cuts, cuts[1:]):
        part = e.filter((F.lit(lo is None) | (F.col("at") >= F.lit(lo))) & (F.lit(hi is None) | (F.col("at") < F.lit(hi))))
        part.drop("at").coalesce(1).write.mode("append").parquet(folder)
    return S.read_events(spark, folder, "*.parquet", 1)


@query("stream_evt01_numbered", f"WITH {SESSIONS_SQL} SELECT session_id, event_id, seq FROM session_events")
def numbered(spark, d):
    return S.run(S.numbered(arriving(spark, d)), _folder(spark))


@query("stream_evt02_compare_and_set", f"""WITH RECURSIVE {SESSIONS_SQL}, u AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, event_id, k % 4 AS expected FROM session_events WHERE event_type = 'purchase'),
f AS (SELECT session_id, n, event_id, expected = 0 AS accepted, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS revision FROM u WHERE n = 1
UNION ALL SELECT u.session_id, u.n, u.event_id, u.expected = f.revision, CASE WHEN u.expected = f.revision THEN f.revision + 1 ELSE f.revision END FROM f JOIN u ON u.session_id = f.session_id AND u.n = f.n + 1)
SELECT session_id, event_id, accepted, CAST(revision AS BIGINT) AS revision FROM f""")
def compare_and_set(spark, d):
    expected = F.get_json_object("props", "$.k").cast("long") % 4
    return S.run(S.compare_and_set(arriving(spark, d).filter("event_type = 'purchase'").withColumn("expected", expected)), _folder(spark))


@query("stream_evt03_claims", f"WITH {SESSIONS_SQL}, c AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM session_events WHERE event_type = 'click') SELECT session_id, event_id, n <= 5 AS granted FROM c")
def claims(spark, d):
    return S.run(S.claims(arriving(spark, d).filter("event_type = 'click'"), 5), _folder(spark))


@query("stream_evt08_stalls", f"WITH {SESSIONS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_type, k ORDER BY seq) AS times FROM session_events) SELECT session_id, event_id FROM c WHERE times = 3")
def stalls(spark, d):
    return S.run(S.stalls(arriving(spark, d)), _folder(spark))


@query("stream_evt11_retention", "SELECT event_id, event_type FROM events WHERE NOT (event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-20')")
def retention(spark, d):
    kept = S.retained(arriving(spark, d), "2024-01-20 00:00:00", ("click", "view"))
    return S.run(kept.select("event_id", "event_type"), _folder(spark))


@query("stream_daily_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def windows(spark, d):
    out = S.run(S.windowed(arriving(spark, d)), _folder(spark), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query("stream_deduplicated", "SELECT event_id FROM events")
def deduplicated(spark, d):
    return S.run(S.deduplicated(arriving(spark, d)).select("event_id"), _folder(spark))
