"""Queries: event logs, sessions and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import events as E
from ..sources.tables import SESSIONS_SQL, session_events, table


@query("evt01_append", f"""WITH {SESSIONS_SQL}, l AS (SELECT * FROM session_events WHERE event_type <> 'signup'), n AS (SELECT session_id, event_id, ts FROM session_events WHERE event_type = 'signup'),
m AS (SELECT session_id, max(seq) AS last FROM l GROUP BY 1) SELECT n.session_id, event_id, coalesce(last, 0) + row_number() OVER (PARTITION BY n.session_id ORDER BY ts, event_id) AS seq FROM n LEFT JOIN m USING (session_id)""")
def evt01(spark, d):
    e = session_events(spark, d)
    new = e.filter("event_type = 'signup'").select("session_id", "event_id", "ts")
    return E.appended(e.filter("event_type <> 'signup'"), new, ["ts", "event_id"]).select("session_id", "event_id", "seq")


@query("evt02_compare_and_set", f"""WITH RECURSIVE {SESSIONS_SQL}, u AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, seq, k % 4 AS expected FROM session_events WHERE event_type = 'purchase'),
f AS (SELECT session_id, n, seq, expected = 0 AS accepted, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS revision FROM u WHERE n = 1
UNION ALL SELECT u.session_id, u.n, u.seq, u.expected = f.revision, CASE WHEN u.expected = f.revision THEN f.revision + 1 ELSE f.revision END FROM f JOIN u ON u.session_id = f.session_id AND u.n = f.n + 1)
SELECT session_id, seq, accepted, CAST(revision AS BIGINT) AS revision FROM f""")
def evt02(spark, d):
    return E.cas(session_events(spark, d).filter("event_type = 'purchase'").select("session_id", "seq", (F.col("k") % 4).alias("expected")))


@query("evt03_slot_claims", f"""WITH {SESSIONS_SQL}, c AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM session_events WHERE event_type = 'click' AND k >= 50)
SELECT session_id, seq, n <= 5 AS granted FROM c""")
def evt03(spark, d):
    e = session_events(spark, d)
    return E.claimed(e, (F.col("event_type") == "click") & (F.col("k") >= 50), 5).select("session_id", "seq", "granted")


@query("evt04_identity_sets", f"""WITH {SESSIONS_SQL} SELECT session_id, count(DISTINCT CASE WHEN event_type = 'view' THEN k END) AS retrieved, count(DISTINCT CASE WHEN event_type = 'purchase' THEN k END) AS full_reads,
  array_to_string(list_sort(list_distinct(list(k) FILTER (event_type = 'view' AND k < 10))), ',') AS low FROM session_events WHERE event_type <> 'error' GROUP BY 1""")
def evt04(spark, d):
    kind = lambda t: F.when(F.col("event_type") == t, F.col("k"))
    return session_events(spark, d).filter("event_type <> 'error'").groupBy("session_id").agg(
        F.countDistinct(kind("view")).alias("retrieved"), F.countDistinct(kind("purchase")).alias("full_reads"),
        F.collect_set(F.when(F.col("k") < 10, kind("view"))).alias("s")).select(
        "session_id", "retrieved", "full_reads", F.when(F.size("s") > 0, F.array_join(F.sort_array("s"), ",")).alias("low"))


@query("evt05_latest_run_coverage", f"""WITH {SESSIONS_SQL}, s AS (SELECT *, max(seq) FILTER (event_type = 'signup') OVER (PARTITION BY session_id) AS start FROM session_events),
r AS (SELECT session_id, unnest(range(k, k + 5)) AS pos FROM s WHERE seq > start AND event_type = 'view') SELECT session_id, count(DISTINCT pos) AS covered FROM r GROUP BY 1""")
def evt05(spark, d):
    e = E.latest_run(session_events(spark, d), F.col("event_type") == "signup").filter("event_type = 'view'")
    return E.covered_slices(e.withColumn("stop", F.col("k") + 5), "k", "stop")


@query("evt06_family_exclusion", f"""WITH {SESSIONS_SQL} SELECT session_id, k % 3 AS family, bool_or(event_type = 'error' AND k > 95) AS excluded FROM session_events GROUP BY ALL""")
def evt06(spark, d):
    return session_events(spark, d).groupBy("session_id", (F.col("k") % 3).alias("family")).agg(F.bool_or((F.col("event_type") == "error") & (F.col("k") > 95)).alias("excluded"))


@query("evt07_evidence_digest", f"""WITH {SESSIONS_SQL}, l AS (SELECT session_id, min(seq) AS seq, CASE event_type WHEN 'view' THEN 'saw ' || k WHEN 'purchase' THEN 'took ' || k ELSE event_type END AS line FROM session_events GROUP BY session_id, line),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY seq DESC) AS used FROM l) SELECT session_id, string_agg(line, chr(10) ORDER BY seq) AS digest FROM c WHERE used <= 120 GROUP BY 1""")
def evt07(spark, d):
    from ..operators.limits import tail_budget

    k = F.col("k").cast("string")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("saw "), k)).when(F.col("event_type") == "purchase", F.concat(F.lit("took "), k)).otherwise(F.col("event_type"))
    lines = session_events(spark, d).groupBy("session_id", line.alias("line")).agg(F.min("seq").alias("seq")).withColumn("n", F.length("line") + 1)
    kept = tail_budget(lines, "session_id", "seq", "n", 120)
    return kept.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "\n").alias("digest"))


@query("evt08_stalls", f"""WITH {SESSIONS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_type, k ORDER BY seq) AS times FROM session_events) SELECT session_id, seq, event_type, k FROM c WHERE times = 3""")
def evt08(spark, d):
    return E.stalls(session_events(spark, d), ["event_type", "k"]).select("session_id", "seq", "event_type", "k")


@query("evt09_pairing", """
WITH n AS (SELECT conv_id, turn // 2 AS call, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role = 'assistant') AS outputs FROM conversations GROUP BY ALL)
SELECT *, CASE WHEN calls = 0 THEN 'no_call' WHEN calls > 1 THEN 'several_calls' WHEN outputs = 0 THEN 'no_output' ELSE 'several_outputs' END AS problem FROM n WHERE calls <> 1 OR outputs <> 1""")
def evt09(spark, d):
    rows = table(spark, d, "conversations").withColumn("call", F.expr("turn div 2"))
    return E.pairing(rows, ["conv_id", "call"], F.col("role") == "user", F.col("role") == "assistant")


@query("evt10_gap_candidates", f"""WITH {SESSIONS_SQL}, g AS (SELECT session_id, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'view') AS searched, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'view' AND k = 0) AS empty FROM session_events GROUP BY 1)
SELECT session_id, unnest(list_filter([CASE WHEN failed AND NOT bought THEN 'failed_search' END, CASE WHEN searched AND NOT bought THEN 'no_choice' END, CASE WHEN empty THEN 'zero_results' END, CASE WHEN empty AND bought THEN 'fallback_used' END], lambda x: x IS NOT NULL)) AS gap FROM g""")
def evt10(spark, d):
    kind = lambda t: F.bool_or(F.col("event_type") == t)
    g = session_events(spark, d).groupBy("session_id").agg(
        kind("error").alias("failed"), kind("view").alias("searched"), kind("purchase").alias("bought"), F.bool_or((F.col("event_type") == "view") & (F.col("k") == 0)).alias("empty"))
    gaps = F.array_compact(F.array(
        F.when(F.col("failed") & ~F.col("bought"), "failed_search"), F.when(F.col("searched") & ~F.col("bought"), "no_choice"), F.when(F.col("empty"), "zero_results"),
        F.when(F.col("empty") & F.col("bought"), "fallback_used")))
    return g.select("session_id", F.explode(gaps).alias("gap"))


@query("evt11_retention", """
SELECT event_id FROM events WHERE NOT (event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-20')""")
def evt11(spark, d):
    old = F.col("event_type").isin("click", "view") & (F.col("ts") < F.expr("timestamp_ntz'2024-01-20'"))
    return table(spark, d, "events").filter(~old).select("event_id")


@query("evt12_day_sessions", """
SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' AND (CAST(user_id AS VARCHAR) LIKE '1%' OR CAST(user_id AS VARCHAR) LIKE '2%') GROUP BY 1""")
def evt12(spark, d):
    u = F.col("user_id").cast("string")
    day = (F.col("ts") >= F.expr("timestamp_ntz'2024-01-05'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-06'"))
    return table(spark, d, "events").filter(day & (u.startswith("1") | u.startswith("2"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("evt13_outcomes", f"""WITH {SESSIONS_SQL}, o AS (SELECT session_id, max_by(event_type, seq) AS last, bool_or(event_type = 'purchase') AS bought FROM session_events GROUP BY 1)
SELECT session_id, CASE WHEN last = 'purchase' THEN 'completed' WHEN bought THEN 'completed_earlier' WHEN last = 'error' THEN 'failed' ELSE 'open' END AS outcome FROM o""")
def evt13(spark, d):
    o = session_events(spark, d).groupBy("session_id").agg(F.max_by("event_type", "seq").alias("last"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return o.select("session_id", F.when(F.col("last") == "purchase", "completed").when(F.col("bought"), "completed_earlier").when(F.col("last") == "error", "failed").otherwise("open").alias("outcome"))


@query("evt14_token_growth", f"""WITH {SESSIONS_SQL}, g AS (SELECT session_id, seq, k - lag(k) OVER w AS growth, sum(k) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM session_events WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, growth, CAST(used AS BIGINT) AS used, used + coalesce(greatest(growth, 0), 0) > 1000 AS final FROM g""")
def evt14(spark, d):
    w = E.ordered()
    g = session_events(spark, d).select("session_id", "seq", (F.col("k") - F.lag("k").over(w)).alias("growth"), F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return g.withColumn("final", F.col("used") + F.coalesce(F.greatest("growth", F.lit(0)), F.lit(0)) > 1000)


@query("evt15_results_listing", f"""WITH {SESSIONS_SQL}, v AS (SELECT session_id, list_sort(list_distinct(list(k))) AS ks FROM session_events WHERE event_type = 'view' GROUP BY 1)
SELECT session_id, array_to_string(list_slice(ks, 1, 5), ', ') || CASE WHEN len(ks) > 5 THEN ' +' || (len(ks) - 5) || ' more' ELSE '' END AS listing FROM v""")
def evt15(spark, d):
    v = session_events(spark, d).filter("event_type = 'view'").groupBy("session_id").agg(F.sort_array(F.collect_set("k")).alias("ks"))  # ks are percentages: 101 values at most
    more = F.when(F.size("ks") > 5, F.concat(F.lit(" +"), (F.size("ks") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return v.select("session_id", F.concat(F.array_join(F.slice("ks", 1, 5), ", "), more).alias("listing"))


@query("evt17_request_record", f"""WITH {SESSIONS_SQL} SELECT session_id, k AS request, CASE WHEN bool_or(event_type = 'error') THEN NULL ELSE round(sum(value), 6) END AS latency, count(*) AS stages FROM session_events GROUP BY ALL""")
def evt17(spark, d):
    total = F.when(~F.bool_or(F.col("event_type") == "error"), F.round(F.sum("value"), 6))
    return session_events(spark, d).groupBy("session_id", F.col("k").alias("request")).agg(total.alias("latency"), F.count("*").alias("stages"))


@query("rul12_phase_moves", f"""WITH {SESSIONS_SQL}, p AS (SELECT session_id, seq, ['collecting', 'planning', 'retrieving', 'choosing', 'writing', 'done'][1 + CAST(k % 6 AS INTEGER)] AS phase FROM session_events),
b AS (SELECT *, lag(phase) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM p), m(a, b) AS (VALUES ('collecting', 'planning'), ('planning', 'collecting'), ('planning', 'retrieving'), ('retrieving', 'choosing'), ('retrieving', 'planning'), ('choosing', 'writing'), ('choosing', 'retrieving'), ('writing', 'done'), ('writing', 'choosing'))
SELECT session_id, seq, before, phase FROM b WHERE before IS NOT NULL AND before <> phase AND NOT EXISTS (SELECT 1 FROM m WHERE m.a = before AND m.b = phase)""")
def rul12(spark, d):
    phases = F.array(*map(F.lit, ("collecting", "planning", "retrieving", "choosing", "writing", "done")))
    e = session_events(spark, d).select("session_id", "seq", F.element_at(phases, (F.col("k") % 6 + 1).cast("int")).alias("phase"))
    return E.illegal_moves(e, "phase").select("session_id", "seq", "before", "phase")


@query("snk10_session_export", """
SELECT conv_id, string_agg('**' || role || '**: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""".replace("\\\\", "\\"))
def snk10(spark, d):
    from ..functions.text import collapsed

    line = F.concat(F.lit("**"), "role", F.lit("**: "), collapsed(F.col("text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("markdown"))


@query("nst10_payload_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def nst10(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("nst09_json_leaves", "SELECT event_id, '$.' || unnest(json_keys(props)) AS path, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def nst09(spark, d):
    leaves = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(leaves).alias("key", "value")).select("event_id", F.concat(F.lit("$."), "key").alias("path"), "value")


@query("inc05_reservation", "SELECT lang, CAST(sum((octet_length(encode(text)) + 8) * 3) AS BIGINT) AS reserved, sum((octet_length(encode(text)) + 8) * 3) > 1000000 AS over FROM documents GROUP BY 1")
def inc05(spark, d):
    from ..functions.text import reserved_tokens

    r = table(spark, d, "documents").groupBy("lang").agg(F.sum(reserved_tokens(F.col("text")) * 3).alias("reserved"))
    return r.withColumn("over", F.col("reserved") > 1000000)


@query("mth10_budget_stop", f"""WITH {SESSIONS_SQL}, c AS (SELECT session_id, seq, value, sum(value) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM session_events)
SELECT session_id, count(*) FILTER (round(spent, 6) <= 100) AS allowed, round(max(spent), 6) AS asked FROM c GROUP BY 1""")
def mth10(spark, d):
    spent = F.sum("value").over(E.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return session_events(spark, d).withColumn("spent", spent).groupBy("session_id").agg(F.count_if(F.round("spent", 6) <= 100).alias("allowed"), F.round(F.max("spent"), 6).alias("asked"))
