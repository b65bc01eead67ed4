"""Shared helpers: durable intermediate tables, hot-key salting, ASCII lower-casing."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space, tab, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
#: A key is hot when it holds more rows than HOT_ROWS, or than 1/HOT_MAX of all where that is more: rows of one key that a task gets, and hot keys
#: that there can be at most (a row of some 20 bytes each).
HOT_ROWS = 1000
HOT_MAX = 100_000

_own_root: list[str] = []
_scratch: list[list[str]] = []
_written: dict[str, set[str]] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir); a temporary one only in plain local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="glyphspark-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return _own_root[0]


def materialise(df: DataFrame, label: str, bucket_by: str | None = None, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    The tables of an application stand in one folder, which goes when the driver ends; `scratch` drops them earlier. lasting: it outlives
    the innermost scratch, not those around it."""
    spark = df.sparkSession
    top = f"{work_root(spark)}/glyphspark/{spark.sparkContext.applicationId}"
    if top not in _written:
        _written[top] = set()
        atexit.register(_remove, spark, top)
    path = f"{top}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if bucket_by:
        writer = writer.partitionBy(bucket_by)
    writer.parquet(path)
    around = _scratch[:-1] if lasting else _scratch
    if around:
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems; best effort, as the session may have ended."""
    try:
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is gone
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end: whatever is to last has to be written before that."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def type_of(df: DataFrame, column: str) -> str:
    """The type of a column as DDL, so that ids go through Arrow functions as what they are."""
    return df.select(column).schema[0].dataType.simpleString()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join on columns that may hold null (null meets null); right's key columns go."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        one = left[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on]) if how not in ("left_semi", "left_anti") else left.join(renamed, cond, how)


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """Hot keys and over how many salts their rows go, by their counts: (__hot, __salts), or None without any.

    Each holds over 1/HOT_MAX of all rows, so there are fewer than HOT_MAX whatever the input; they can be broadcast."""
    limit = max(HOT_ROWS, (counts.agg(F.sum(n)).first()[0] or 0) // HOT_MAX)
    hot = counts.filter(F.col(n) > limit).groupBy(F.col(key).alias("__hot")).agg(F.ceil(F.sum(n) / limit).cast("int").alias("__salts"))
    hot = materialise(hot, "hot")
    return None if hot.isEmpty() else hot


def add_salt(df: DataFrame, key: str, hot: DataFrame | None, by: Column | None = None) -> DataFrame:
    """The many-rows side: rows of hot keys are dealt over their salts (__salt), others have 0. by: what a row is dealt by, else its place."""
    if hot is None:
        return df.withColumn("__salt", F.lit(0))
    placed = df.withColumn("__dealt", F.xxhash64(F.monotonically_increasing_id() if by is None else by))
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod("__dealt", "__salts")).cast("int")
    return placed.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot", "__salts", "__dealt")


def spread(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The one-row-per-key side: rows of hot keys are repeated for every value of __salt."""
    if hot is None:
        return df.withColumn("__salt", F.lit(0))
    salts = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(salts)).drop("__hot", "__salts")


def pick(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose (id, text_hash) are in chosen: (id, text_hash, copies), one row each.

    copies: rows of docs with that id and text; of those, one row stays."""
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__th", F.xxhash64(text_col))
    chosen = chosen.select(F.col("id").alias("__id"), F.col("text_hash").alias("__th"), F.col("copies").alias("__copies"))
    repeated = chosen.filter(F.col("__copies") > 1)
    if repeated.isEmpty():
        return null_safe(keyed, chosen.drop("__copies"), ["__id", "__th"], "left_semi").drop("__id", "__th")
    once = null_safe(keyed, chosen.filter(F.col("__copies") == 1).drop("__copies"), ["__id", "__th"], "left_semi")
    more = null_safe(keyed, repeated.drop("__copies"), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return once.unionByName(more).drop("__id", "__th")


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose (id, text_hash) are not in rejected."""
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__th", F.xxhash64(text_col))
    gone = rejected.select(F.col("id").alias("__id"), F.col("text_hash").alias("__th")).distinct().hint("shuffle_hash")
    return null_safe(keyed, gone, ["__id", "__th"], "left_anti").drop("__id", "__th")
