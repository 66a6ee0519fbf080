"""Reply health: windows, trips, sessions, integrity, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import degenerate
from ..operators import integrity as I
from ..operators.human import count_if
from ..session import ship
from ..sources.fixtures import ATTEMPTS, DISCOVERIES, attempts, discoveries, table
from .registry import query

_W = rf"""WITH {ATTEMPTS}, f AS (SELECT event_id, user_id % 4 AS monitor, NOT regexp_matches(raw, '[\p{{L}}\p{{N}}]') AS bad FROM attempts),
 w AS (SELECT *, sum(bad::INT) OVER o AS window_bad, count(*) OVER o AS window_calls FROM f WINDOW o AS (PARTITION BY monitor ORDER BY event_id ROWS 199 PRECEDING)),
 t AS (SELECT *, bool_or(window_calls >= 60 AND 100 * window_bad >= 25 * window_calls) OVER (PARTITION BY monitor ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS tripped FROM w)"""


def _watched(spark, sf_dir):
    df = attempts(spark, sf_dir).select("event_id", (F.col("user_id") % 4).alias("monitor"), "raw")
    return I.monitor(df, "event_id", degenerate(F.col("raw")), "monitor", max_rate_percent=25)


@query(f"{_W} SELECT event_id, monitor, window_bad::BIGINT AS window_bad, window_calls, tripped FROM t")
def health_window(spark, sf_dir):
    return _watched(spark, sf_dir).select("event_id", "monitor", "window_bad", "window_calls", "tripped")


@query(f"{_W} SELECT monitor, min(event_id) FILTER (tripped) AS first_trip, count(*) FILTER (tripped) AS refused, count(*) AS calls FROM t GROUP BY monitor")
def health_trip(spark, sf_dir):
    return _watched(spark, sf_dir).groupBy("monitor").agg(F.min(F.when(F.col("tripped"), F.col("event_id"))).alias("first_trip"), count_if(F.col("tripped")).alias("refused"), F.count("*").alias("calls"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, (event_id * 7919 % 1000)::BIGINT AS calls, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
 walk AS (SELECT user_id, 1::BIGINT AS r, 0::BIGINT AS session, calls AS peak FROM s WHERE r = 1 UNION ALL
  SELECT s.user_id, s.r, w.session + (w.peak > 200 AND 2 * s.calls < w.peak)::INT, CASE WHEN w.peak > 200 AND 2 * s.calls < w.peak THEN s.calls ELSE greatest(w.peak, s.calls) END FROM walk w JOIN s ON s.user_id = w.user_id AND s.r = w.r + 1)
 SELECT user_id, max(session) + 1 AS sessions, max(r) AS snapshots FROM walk GROUP BY user_id""")
def health_sessions(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("calls", F.col("event_id") * 7919 % 1000)
    return I.sessions(df, "user_id", "event_id", "calls")


_S = rf"""WITH {DISCOVERIES}, f AS (SELECT frame, bool_and(NOT regexp_matches(raw_a, '[\p{{L}}\p{{N}}]')) AS all_bad, bool_or(NOT regexp_matches(raw_a, '[\p{{L}}\p{{N}}]')) AS any_bad, count(*) AS n FROM discoveries GROUP BY frame),
 st AS (SELECT frame, n, CASE WHEN all_bad THEN 'corrupt' WHEN any_bad THEN 'partial' ELSE 'clean' END AS status FROM f)"""


def _status(spark, sf_dir):
    frames = discoveries(spark, sf_dir).groupBy("frame").agg(F.collect_list("raw_a").alias("replies"))
    return frames.select("frame", I.frame_status(F.col("replies")).alias("status"), F.size("replies").cast("long").alias("n"))


@query(f"{_S} SELECT status, count(*) AS frames, sum(n)::BIGINT AS replies FROM st GROUP BY status")
def frame_integrity(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("frames"), F.sum("n").alias("replies"))


@query(rf"WITH {ATTEMPTS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (NOT regexp_matches(raw, '[\p{{L}}\p{{N}}]')) AS degenerate FROM attempts GROUP BY ALL")
def integrity_by_day(spark, sf_dir):
    return attempts(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), count_if(degenerate(F.col("raw"))).alias("degenerate"))


@query(f"{_S} SELECT frame FROM st WHERE status = 'corrupt' OR status = 'partial'")
def prune_list(spark, sf_dir):
    return _status(spark, sf_dir).where(F.col("status").isin("corrupt", "partial")).select("frame")


@query("SELECT o_custkey AS frame_id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY ALL")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("frame_id"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("frame_id"))
    return I.resume(wanted, done).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k")
def common_frames(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), count_if(F.col("b").isNull()).alias("only_a"), count_if(F.col("a").isNull()).alias("only_b"))


@query(rf"WITH {ATTEMPTS} SELECT count(*) FILTER (raw = '??????????' AND bad) AS caught, count(*) FILTER (raw = '??????????' AND NOT bad) AS missed, count(*) FILTER (raw <> '??????????' AND NOT bad) AS clean, count(*) FILTER (raw <> '??????????' AND bad) AS false_positives FROM (SELECT raw, NOT regexp_matches(raw, '[\p{{L}}\p{{N}}]') AS bad FROM attempts)")
def response_scoring(spark, sf_dir):
    bad, junk = degenerate(F.col("raw")), F.col("raw") == "??????????"
    return attempts(spark, sf_dir).agg(count_if(junk & bad).alias("caught"), count_if(junk & ~bad).alias("missed"), count_if(~junk & ~bad).alias("clean"), count_if(~junk & bad).alias("false_positives"))
