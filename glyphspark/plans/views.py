"""Search logs and record tables derived from the generic test tables, with the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("KMP", "Boyer-Moore", "Rabin-Karp", "Shift-Or", "Aho-Corasick", "AUTO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has too few splits for heavy work per row; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() <= 2 * cores else rows


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.get(F.array(*map(F.lit, NAMES)), ((F.col("event_id") + F.col("user_id")) % 6).cast("int"))
    return events.select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", name.alias("algorithm"), k.alias("k"), "value", "ts")


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return rows.select(F.col("event_id").alias("log_id"), "user_id", F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("query"), "algorithm", F.coalesce("k", F.lit(0)).alias("matches_count"), F.col("value").alias("duration_ms"), F.col("ts").alias("run_at"))


def performance_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    size = (F.coalesce("k", F.lit(0)) * 20_000 + F.col("event_id") % 1000).alias("text_size_bytes")
    return rows.select(F.col("event_id").alias("log_id"), "algorithm", size, F.col("value").alias("duration_ms"), F.coalesce("k", F.lit(0)).alias("matches_count"), "user_id", F.col("ts").alias("created_at"))


_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
LOG_SQL = f"""
WITH log AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, {_LIST}[1 + (event_id + user_id) % 6] AS algorithm,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, ts FROM events),
search_history AS (SELECT event_id AS log_id, user_id, concat_ws(' ', event_type, CAST(k AS VARCHAR)) AS query, algorithm, coalesce(k, 0) AS matches_count, value AS duration_ms, ts AS run_at FROM log),
performance_logs AS (SELECT event_id AS log_id, algorithm, coalesce(k, 0) * 20000 + event_id % 1000 AS text_size_bytes, value AS duration_ms, coalesce(k, 0) AS matches_count, user_id, ts AS created_at FROM log)
"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users: id, username, email, role, is_active."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("_"))).alias("username"), F.concat(F.lit(" User."), F.col("c_custkey").cast("string"), F.lit("@Example.COM ")).alias("email"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("user").alias("role"), (F.col("c_custkey") % 7 != 0).alias("is_active"))


USERS_SQL = """
WITH users AS (SELECT CAST(c_custkey AS VARCHAR) AS id, '  ' || replace(c_name, '#', '_') AS username, ' User.' || CAST(c_custkey AS VARCHAR) || '@Example.COM ' AS email,
               CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, c_custkey % 7 <> 0 AS is_active FROM customer)
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, text: events told in words, with entities of every type."""
    from glyphspark.functions.names import ENGLISH_FIRST, ENGLISH_LAST, HEBREW_FIRST

    e = table(spark, sf_dir, "events")
    one = lambda names, by: F.get(F.array(*map(F.lit, sorted(names))), (F.col("event_id") * by % len(names)).cast("int"))
    number = F.lpad((F.col("event_id") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    parts = ["On ", F.date_format("ts", "yyyy-MM-dd"), " at ", F.date_format("ts", "HH:mm"), " @user", F.col("user_id").cast("string"), " saw #", "event_type", " (", one(ENGLISH_FIRST, 1), " ", one(ENGLISH_LAST, 7), "), id ", number]
    parts += [" via https://example.org/e/", F.col("event_id").cast("string"), "?u=", F.col("user_id").cast("string"), " from fe80:0:", F.lower(F.hex("event_id")), ":1 and 10.0.", (F.col("event_id") % 300).cast("string"), ".7, u", F.col("user_id").cast("string"), "@mail.example.org; +1 (555) 010-", (F.col("event_id") % 1000).cast("string"), ", ", one(HEBREW_FIRST, 3), "."]
    return e.select(F.col("event_id").alias("note_id"), F.concat(*[F.lit(p) if isinstance(p, str) and p != "event_type" else F.col(p) if isinstance(p, str) else p for p in parts]).alias("text"))


def notes_sql() -> str:
    from glyphspark.functions.names import ENGLISH_FIRST, ENGLISH_LAST, HEBREW_FIRST

    def one(names, by):
        quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in sorted(names))
        return f"[{quoted}][1 + event_id * {by} % {len(names)}]"

    return f"""SELECT event_id AS note_id, concat('On ', strftime(ts, '%Y-%m-%d'), ' at ', strftime(ts, '%H:%M'), ' @user', user_id, ' saw #', event_type, ' (', {one(ENGLISH_FIRST, 1)}, ' ', {one(ENGLISH_LAST, 7)}, '), id ',
  lpad(CAST(event_id * 7919 % 1000000000 AS VARCHAR), 9, '0'), ' via https://example.org/e/', event_id, '?u=', user_id, ' from fe80:0:', lower(to_hex(event_id)), ':1 and 10.0.', event_id % 300, '.7, u', user_id, '@mail.example.org; +1 (555) 010-', event_id % 1000, ', ', {one(HEBREW_FIRST, 3)}, '.') AS text FROM events"""
