"""Analytics over search history and performance logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest page or row limits of the listings.
LIMITS = {"autocomplete": 15, "history": 100, "users": 200, "admin_history": 200, "performance": 500, "trending": 50, "trending_days": 90}


def clamp(kind: str, value: int) -> int:
    if value <= 0:
        raise ValueError("limits must be positive")
    return min(value, LIMITS[kind])


def matching(**equal) -> Column:
    """The conjunction of equalities whose value is given; empty values don't filter."""
    condition = F.lit(True)
    for name, value in equal.items():
        if value not in (None, ""):
            condition = condition & (F.col(name) == value)
    return condition


def user_totals(history: DataFrame, user_id: str) -> DataFrame:
    """One row, zeros for an unknown user: total_searches, total_matches, avg_duration_ms."""
    return history.filter(matching(user_id=user_id)).agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.coalesce(F.sum("matches_count"), F.lit(0)).cast("bigint").alias("total_matches"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 4).alias("avg_duration_ms"),
    )


def algorithm_counts(history: DataFrame, user_id: str | None = None) -> DataFrame:
    """algorithm, searches; most used first."""
    return history.filter(matching(user_id=user_id)).groupBy("algorithm").agg(F.count(F.lit(1)).alias("searches")).orderBy(F.desc("searches"), "algorithm")


def user_stats(history: DataFrame, user_id: str) -> DataFrame:
    """user_totals with algorithms (map) and most_used_algorithm; one row."""
    each = history.filter(matching(user_id=user_id)).groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"))
    used = each.agg(F.map_from_entries(F.collect_list(F.struct("algorithm", "n"))).alias("algorithms"), F.min(F.struct(-F.col("n"), "algorithm"))["algorithm"].alias("most_used_algorithm"))
    return user_totals(history, user_id).crossJoin(used)  # one row each


def most_used(history: DataFrame) -> DataFrame:
    """user_id, most_used_algorithm, searches for every user; ties fall to the first name."""
    each = history.groupBy("user_id", "algorithm").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "algorithm")).alias("b"))
    return best.select("user_id", F.col("b.algorithm").alias("most_used_algorithm"), (-F.col("b.n")).alias("searches"))


def trending(history: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    """query, searches, last_seen over the last days up to as_of."""
    since = as_of - F.make_dt_interval(F.lit(clamp("trending_days", days)))
    recent = history.filter(F.col("run_at") >= since).groupBy("query")
    return recent.agg(F.count(F.lit(1)).alias("searches"), F.max("run_at").alias("last_seen")).orderBy(F.desc("searches"), "query").limit(clamp("trending", limit))


def autocomplete(history: DataFrame, prefix: str, user_id: str | None = None, limit: int = 10) -> DataFrame:
    """Queries that start with a prefix, whatever the case, most frequent first; none for a blank prefix."""
    prefix = prefix.strip()
    wanted = F.startswith(F.lower("query"), F.lit(prefix.lower())) if prefix else F.lit(False)
    found = history.filter(matching(user_id=user_id) & wanted).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "query").limit(clamp("autocomplete", limit)).select("query")


def algorithm_breakdown(logs: DataFrame, user_id: str | None = None) -> DataFrame:
    """algorithm, searches, avg_duration_ms, avg_matches, avg_text_size_bytes; most used first."""
    average = lambda c, digits: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(f"avg_{c.removesuffix('_count')}")
    each = logs.filter(matching(user_id=user_id)).groupBy("algorithm")
    return each.agg(F.count(F.lit(1)).alias("searches"), average("duration_ms", 4), average("matches_count", 2), average("text_size_bytes", 0)).orderBy(F.desc("searches"), "algorithm")


def fastest(breakdown: DataFrame, least: int = 2) -> DataFrame:
    """One row: the algorithm with the smallest mean duration among those with `least` searches."""
    best = breakdown.filter(F.col("searches") >= least).agg(F.min(F.struct("avg_duration_ms", "algorithm")).alias("b"))
    return best.select(F.col("b.algorithm").alias("algorithm"), F.col("b.avg_duration_ms").alias("avg_duration_ms"))


def overview(breakdown: DataFrame) -> DataFrame:
    """One row: searches over all algorithms and the mean duration weighted by them."""
    return breakdown.agg(F.sum("searches").alias("searches"), (F.sum(F.col("avg_duration_ms") * F.col("searches")) / F.greatest(F.sum("searches"), F.lit(1))).alias("avg_duration_ms"))


def shares(counts: DataFrame, count_col: str = "searches", duration_col: str | None = None) -> DataFrame:
    """counts with share_percent of the total and, given durations, bar_percent of the slowest."""
    every = Window.partitionBy()
    out = counts.withColumn("share_percent", F.round(F.col(count_col) / F.sum(count_col).over(every) * 100).cast("bigint"))
    if duration_col:
        out = out.withColumn("bar_percent", F.round(F.col(duration_col) / F.greatest(F.max(duration_col).over(every), F.lit(0.001)) * 100).cast("bigint"))
    return out


def page(rows: DataFrame, time_col: str, key_col: str, limit: int, skip: int = 0, **equal) -> DataFrame:
    """Newest rows first, one page of them."""
    if limit <= 0 or skip < 0:
        raise ValueError("limit must be positive and skip not negative")
    return rows.filter(matching(**equal)).orderBy(F.desc(time_col), key_col).offset(skip).limit(limit)


def performance_page(logs: DataFrame, limit: int, skip: int = 0, algorithm: str | None = None) -> DataFrame:
    """Performance logs; with an algorithm only the limit counts."""
    return page(logs, "created_at", "log_id", clamp("performance", limit), 0 if algorithm else skip, algorithm=algorithm)


def grouped_entities(entities: DataFrame, id_col: str) -> DataFrame:
    """(id, type, value) rows -> id, type, distinct values sorted, n."""
    each = entities.groupBy(id_col, "type").agg(F.array_sort(F.collect_set("value")).alias("vals"))
    return each.withColumn("n", F.size("vals").cast("bigint"))
