"""Record operators: versioned updates and deletes over append-only tables, lookups, listings, access checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.functions import text as tx

ROLES = ("user", "admin")
#: Fields of a user that an update may set.
UPDATABLE = ("username", "email", "role", "is_active", "password_hash")


def new_user(rows: DataFrame) -> DataFrame:
    """Trimmed user names and trimmed lower-case e-mails; rows with an unknown role or an invalid field go."""
    clean = rows.withColumn("username", F.trim("username")).withColumn("email", F.lower(F.trim("email")))
    return clean.filter(F.col("role").isin(*ROLES) & tx.valid_email(F.col("email")) & (tx.username_problem(F.col("username")) == ""))


def unique_violations(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once: field, value, n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys]))
    return rows.select(each.alias("e")).groupBy("e.field", "e.value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def latest(versions: DataFrame, key: str, order: str, tie: str, deleted: Column | None = None) -> DataFrame:
    """The newest version per key; keys whose newest version is a deletion go."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    out = versions.withColumn("__no", F.row_number().over(newest)).filter("__no = 1").drop("__no")
    return out if deleted is None else out.filter(~deleted)


def update(versions: DataFrame, changes: DataFrame, key: str, stamp: Column, allowed: tuple[str, ...] = UPDATABLE) -> DataFrame:
    """New versions of the rows that changes name, with allowed fields set and updated_at stamped; to be appended."""
    fields = [c for c in changes.columns if c in allowed]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    out = versions.join(new, key)
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.withColumn("updated_at", stamp).drop(*[f"__{c}" for c in fields])


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.col("email") == email.strip().lower()).limit(1)


def listing(rows: DataFrame, key: str, limit: int, skip: int = 0) -> DataFrame:
    """A page in key order."""
    return rows.orderBy(key).offset(skip).limit(limit)


def public(rows: DataFrame, times: tuple[str, ...] = ("created_at", "updated_at")) -> DataFrame:
    """Records as they are shown: no password hash, times in ISO form."""
    out = rows.drop("password_hash")
    for c in times:
        if c in out.columns:
            out = out.withColumn(c, tx.iso(F.col(c)))
    return out


def allowed(requests: DataFrame, users: DataFrame, user_key: str = "user_id", role: str | None = None) -> DataFrame:
    """Requests of users that exist, are active and, if asked for, have a role."""
    good = users.filter("is_active") if role is None else users.filter(F.col("is_active") & (F.col("role") == role))
    return requests.join(good.select(F.col("id").alias(user_key)), user_key, "left_semi")


def deletable(requests: DataFrame) -> DataFrame:
    """Deletions (admin_id, target_id) that don't name the admin's own record."""
    return requests.filter(~F.col("admin_id").eqNullSafe(F.col("target_id")))
