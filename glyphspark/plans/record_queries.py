"""Queries of the record operators: versions, lookups, listings, validation, access, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphspark import __version__
from glyphspark.functions import text as tx
from glyphspark.operators import store
from glyphspark.plans.registering import collector
from glyphspark.plans.views import USERS_SQL, table, users

QUERIES, ORACLES, query = collector()


@query("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def latest_version(spark, sf_dir):
    """Events as versions of a user's record; error events are deletions."""
    found = store.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", deleted=F.col("event_type") == "error")
    return found.select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, c_name, 'DEBTOR' AS c_mktsegment FROM customer WHERE c_acctbal < 0")
def update_records(spark, sf_dir):
    """New versions of the records in debt with an allowed field set; a field that is not allowed stays."""
    rows = table(spark, sf_dir, "customer")
    changes = rows.filter("c_acctbal < 0").select("c_custkey", F.lit("DEBTOR").alias("c_mktsegment"), F.lit("x").alias("c_name"))
    return store.update(rows, changes, "c_custkey", F.lit("2024-02-01").cast("timestamp"), ("c_mktsegment",)).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 5")
def point_lookup(spark, sf_dir):
    return store.by_key(table(spark, sf_dir, "customer"), "c_custkey", 5).select("c_custkey", "c_name")


@query(USERS_SQL + "SELECT id, trim(username) AS username, lower(trim(email)) AS email FROM users WHERE lower(trim(email)) = 'user.12@example.com'")
def lookup_by_email(spark, sf_dir):
    return store.by_email(store.new_user(users(spark, sf_dir)), " USER.12@example.com").select("id", "username", "email")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 20")
def listing(spark, sf_dir):
    return store.listing(table(spark, sf_dir, "part"), "p_partkey", 50, 20).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM documents")
def count_records(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


@query(USERS_SQL + "SELECT id, trim(username) AS username, lower(trim(email)) AS email, role FROM users WHERE regexp_full_match(trim(username), '[a-zA-Z0-9_]{3,32}')")
def new_users(spark, sf_dir):
    return store.new_user(users(spark, sf_dir)).select("id", "username", "email", "role")


@query("SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return store.unique_violations(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment")


@query("""
SELECT c_custkey, regexp_full_match(trim(c_name), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS email_ok,
  CASE WHEN length(trim(c_name)) < 3 THEN 'too_short' WHEN length(trim(c_name)) > 32 THEN 'too_long' WHEN NOT regexp_full_match(trim(c_name), '[a-zA-Z0-9_]+') THEN 'characters' ELSE '' END AS username_problem,
  CASE WHEN length(c_mktsegment) < 8 THEN 'length' WHEN NOT regexp_matches(c_mktsegment, '[A-Z]') THEN 'upper_case' WHEN NOT regexp_matches(c_mktsegment, '[0-9]') THEN 'digit' ELSE '' END AS password_problem
FROM customer""")
def validators(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", tx.valid_email(F.col("c_name")).alias("email_ok"), tx.username_problem(F.col("c_name")).alias("username_problem"), tx.password_problem(F.col("c_mktsegment")).alias("password_problem"))


@query(USERS_SQL + "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE CAST(user_id AS VARCHAR) IN (SELECT id FROM users WHERE is_active AND role = 'admin')")
def allowed_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"))
    return store.allowed(requests, users(spark, sf_dir), role="admin").select("event_id", "user_id")


@query("SELECT event_id, user_id AS admin_id, event_id % 50 AS target_id FROM events WHERE user_id IS DISTINCT FROM event_id % 50")
def deletable(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("admin_id"), (F.col("event_id") % 50).alias("target_id"))
    return store.deletable(rows)


@query("""SELECT r_regionkey, '{"status":"success","success":true,"message":"OK","data":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}' AS body FROM region""")
def json_envelope(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", tx.json_envelope(F.struct("r_regionkey", "r_name")).alias("body"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS created_at FROM events")
def public_records(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.lit("secret").alias("password_hash"))
    return store.public(rows)


@query(f"SELECT 'glyphspark {__version__}' AS version, 'ok' AS status")
def health(spark, sf_dir):
    return spark.range(1).select(F.lit(f"glyphspark {__version__}").alias("version"), F.lit("ok").alias("status"))
