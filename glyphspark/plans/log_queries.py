"""Queries of the analytics operators over log tables derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphspark.functions import text as tx
from glyphspark.operators import analytics, recommend
from glyphspark.plans.registering import collector
from glyphspark.plans.views import LOG_SQL, performance_logs, search_history, table
from glyphspark.streaming.monitor import windowed_counts

QUERIES, ORACLES, query = collector()
USER, PREFIX = "7", "CLICK 1"


def _as_of(history):
    """The last time in the log as a value for the plan: the logs have no present."""
    return F.lit(history.agg(F.max("run_at")).first()[0])


@query(LOG_SQL + f"SELECT count(*) AS total_searches, CAST(coalesce(sum(matches_count), 0) AS BIGINT) AS total_matches, round(coalesce(avg(duration_ms), 0), 4) AS avg_duration_ms FROM search_history WHERE user_id = '{USER}'")
def user_totals(spark, sf_dir):
    return analytics.user_totals(search_history(spark, sf_dir), USER)


@query("SELECT 0 AS total_searches, 0 AS total_matches, 0.0 AS avg_duration_ms")
def user_totals_unknown(spark, sf_dir):
    return analytics.user_totals(search_history(spark, sf_dir), "nobody")


@query(LOG_SQL + f"SELECT algorithm, count(*) AS searches FROM search_history WHERE user_id = '{USER}' GROUP BY algorithm")
def user_algorithms(spark, sf_dir):
    return analytics.algorithm_counts(search_history(spark, sf_dir), USER)


@query(LOG_SQL + "SELECT user_id, algorithm AS most_used_algorithm, n AS searches FROM (SELECT user_id, algorithm, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, algorithm) AS r FROM search_history GROUP BY user_id, algorithm) WHERE r = 1")
def most_used(spark, sf_dir):
    return analytics.most_used(search_history(spark, sf_dir))


@query(LOG_SQL + f"""
, mine AS (SELECT algorithm, count(*) AS n FROM search_history WHERE user_id = '{USER}' GROUP BY algorithm)
SELECT (SELECT count(*) FROM search_history WHERE user_id = '{USER}') AS total_searches, (SELECT algorithm FROM mine ORDER BY n DESC, algorithm LIMIT 1) AS most_used_algorithm, (SELECT count(*) FROM mine) AS algorithms_used""")
def user_stats(spark, sf_dir):
    found = analytics.user_stats(search_history(spark, sf_dir), USER)
    return found.select("total_searches", "most_used_algorithm", F.size("algorithms").cast("bigint").alias("algorithms_used"))


@query(LOG_SQL + "SELECT query, count(*) AS searches, max(run_at) AS last_seen FROM search_history WHERE run_at >= (SELECT max(run_at) FROM search_history) - INTERVAL 7 DAY GROUP BY query ORDER BY searches DESC, query LIMIT 10")
def trending(spark, sf_dir):
    history = search_history(spark, sf_dir)
    return analytics.trending(history, _as_of(history))


@query(LOG_SQL + f"SELECT query FROM search_history WHERE starts_with(lower(query), lower('{PREFIX}')) GROUP BY query ORDER BY count(*) DESC, query LIMIT 10")
def autocomplete(spark, sf_dir):
    return analytics.autocomplete(search_history(spark, sf_dir), PREFIX)


_BREAKDOWN = "SELECT algorithm, count(*) AS searches, round(coalesce(avg(duration_ms), 0), 4) AS avg_duration_ms, round(avg(matches_count), 2) AS avg_matches, round(avg(text_size_bytes), 0) AS avg_text_size_bytes FROM performance_logs GROUP BY algorithm"


@query(LOG_SQL + _BREAKDOWN)
def algorithm_breakdown(spark, sf_dir):
    return analytics.algorithm_breakdown(performance_logs(spark, sf_dir))


@query(LOG_SQL + f"SELECT algorithm, avg_duration_ms FROM ({_BREAKDOWN}) WHERE searches >= 2 ORDER BY avg_duration_ms, algorithm LIMIT 1")
def fastest_algorithm(spark, sf_dir):
    return analytics.fastest(analytics.algorithm_breakdown(performance_logs(spark, sf_dir)))


@query(LOG_SQL + f", b AS ({_BREAKDOWN}) SELECT u.user_id, u.algorithm AS most_used_algorithm, b.avg_duration_ms FROM (SELECT user_id, algorithm, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, algorithm) AS r FROM search_history GROUP BY user_id, algorithm) u LEFT JOIN b USING (algorithm) WHERE r = 1")
def most_used_performance(spark, sf_dir):
    """Each user's favourite with that algorithm's figures; the breakdown has a row per algorithm."""
    used = analytics.most_used(search_history(spark, sf_dir))
    figures = analytics.algorithm_breakdown(performance_logs(spark, sf_dir)).select(F.col("algorithm").alias("most_used_algorithm"), "avg_duration_ms")
    return used.join(figures, "most_used_algorithm", "left").select("user_id", "most_used_algorithm", "avg_duration_ms")


@query(LOG_SQL + f"SELECT CAST(sum(searches) AS BIGINT) AS searches, round(sum(avg_duration_ms * searches) / greatest(sum(searches), 1), 4) AS avg_duration_ms FROM ({_BREAKDOWN})")
def weighted_overview(spark, sf_dir):
    return analytics.overview(analytics.algorithm_breakdown(performance_logs(spark, sf_dir))).withColumn("avg_duration_ms", F.round("avg_duration_ms", 4))


@query(LOG_SQL + f"SELECT algorithm, searches, CAST(round(searches * 100.0 / sum(searches) OVER ()) AS BIGINT) AS share_percent, CAST(round(avg_duration_ms / greatest(max(avg_duration_ms) OVER (), 0.001) * 100) AS BIGINT) AS bar_percent FROM ({_BREAKDOWN})")
def share_percent(spark, sf_dir):
    figures = analytics.shares(analytics.algorithm_breakdown(performance_logs(spark, sf_dir)), duration_col="avg_duration_ms")
    return figures.select("algorithm", "searches", "share_percent", "bar_percent")


@query(LOG_SQL + f"SELECT log_id, query, algorithm, matches_count, run_at FROM search_history WHERE user_id = '{USER}' ORDER BY run_at DESC, log_id LIMIT 10 OFFSET 5")
def history_page(spark, sf_dir):
    return analytics.page(search_history(spark, sf_dir), "run_at", "log_id", 10, 5, user_id=USER).select("log_id", "query", "algorithm", "matches_count", "run_at")


@query(LOG_SQL + "SELECT log_id, algorithm, text_size_bytes, duration_ms FROM performance_logs WHERE algorithm = 'KMP' ORDER BY created_at DESC, log_id LIMIT 100")
def performance_page(spark, sf_dir):
    return analytics.performance_page(performance_logs(spark, sf_dir), 100, skip=50, algorithm="KMP").select("log_id", "algorithm", "text_size_bytes", "duration_ms")


@query(LOG_SQL + """
, used AS (SELECT user_id, algorithm, count(*) AS n FROM search_history GROUP BY user_id, algorithm),
st AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total, first(algorithm ORDER BY n DESC, algorithm) AS most_used, coalesce(sum(n) FILTER (algorithm = 'AUTO'), 0) AS auto, count(*) AS kinds FROM used GROUP BY user_id),
du AS (SELECT user_id, round(avg(duration_ms), 4) AS avg_ms FROM search_history GROUP BY user_id),
pf AS (SELECT user_id, algorithm, count(*) AS c, round(avg(duration_ms), 4) AS ms, round(avg(matches_count), 2) AS matches, round(avg(text_size_bytes), 0) AS bytes FROM performance_logs GROUP BY user_id, algorithm),
pu AS (SELECT user_id, first(algorithm ORDER BY ms, algorithm) FILTER (c >= 2) AS fast, min(ms) FILTER (c >= 2) AS fast_ms, max(bytes) AS bytes, max(matches) AS matches FROM pf GROUP BY user_id)
SELECT st.user_id, coalesce(fast, most_used, 'AUTO') AS recommended_algorithm, CASE WHEN total >= 20 THEN 'high' WHEN total >= 5 THEN 'medium' ELSE 'low' END AS confidence, total AS based_on_searches,
  array_to_string(list_filter([CASE WHEN auto / total >= 0.7 THEN 'R2' END, CASE WHEN fast <> most_used AND own.ms > 0 AND own.ms / greatest(fast_ms, 0.001) >= 1.3 THEN 'R3' END, CASE WHEN bytes > 1000000 THEN 'R4' END,
    CASE WHEN pu.matches > 200 THEN 'R5' END, CASE WHEN avg_ms > 500 THEN 'R6' END, CASE WHEN kinds = 1 AND total >= 5 THEN 'R7' END], lambda r: r IS NOT NULL), ',') AS rules
FROM st JOIN du USING (user_id) LEFT JOIN pu USING (user_id) LEFT JOIN (SELECT user_id, algorithm, ms FROM pf) own ON own.user_id = st.user_id AND own.algorithm = most_used""")
def recommendations(spark, sf_dir):
    found = recommend.recommend(search_history(spark, sf_dir), performance_logs(spark, sf_dir))
    return found.select("user_id", "recommended_algorithm", "confidence", "based_on_searches", F.array_join("rules", ",").alias("rules"))


@query(LOG_SQL + "SELECT log_id, CASE WHEN duration_ms < 1 THEN CAST(CAST(round(duration_ms * 1000) AS BIGINT) AS VARCHAR) || ' µs' WHEN duration_ms < 1000 THEN printf('%.2f ms', duration_ms) ELSE printf('%.2f s', duration_ms / 1000) END AS shown FROM search_history")
def format_duration(spark, sf_dir):
    return search_history(spark, sf_dir).select("log_id", tx.format_duration(F.col("duration_ms")).alias("shown"))


@query(LOG_SQL + "SELECT log_id, CASE WHEN text_size_bytes = 0 THEN '—' ELSE printf('%.1f KB', round(text_size_bytes / 1024.0, 1)) END AS shown FROM performance_logs")
def format_size(spark, sf_dir):
    return performance_logs(spark, sf_dir).select("log_id", tx.format_kb(F.col("text_size_bytes")).alias("shown"))


@query(LOG_SQL + """
, s AS (SELECT log_id, run_at, CAST(floor(epoch((SELECT max(run_at) FROM search_history))) - floor(epoch(run_at)) AS BIGINT) AS s FROM search_history)
SELECT log_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN CAST(round(s / 60.0) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(round(s / 3600.0) AS BIGINT) || 'h ago' ELSE strftime(run_at, '%Y-%m-%d') END AS shown FROM s""")
def relative_time(spark, sf_dir):
    history = search_history(spark, sf_dir)
    return history.select("log_id", tx.relative_time(F.col("run_at"), _as_of(history)).alias("shown"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_per_hour(spark, sf_dir):
    """An extension: tumbling event-time windows, the same code for streams and tables."""
    found = windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", "event_type")
    return found.select("window_start", "window_end", "event_type", "n")
