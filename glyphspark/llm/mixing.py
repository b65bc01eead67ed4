"""Mixing sources to target weights by Efraimidis-Spirakis sampling with word budgets.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share all words by weight; a target
stops at `max_epochs` times its source's size and the excess is shared again by weight until none is above. That fixed
point is a water level: target = min(cap, level * weight), found from the caps sorted by cap / weight.

Taking: complete epochs come first, floor(target / size) times every document of the source. The rest of the budget goes
to documents in the order of their keys -ln(u) / quality weight (u: a hash of the seed and the id), whose sizes are
prefix-summed to the budget; the document where the budget ends is taken in part, so a source meets its target to a word.

Scale: no task holds a source's documents. Keys fall into ranges of their logarithm, which are even for any mixture of weights (see
PER_DOUBLING); sizes are pre-aggregated per (source, range) and these sums, some ten thousand at most per source, are
prefix-summed; only the rows of the one range where a budget ends are sorted. Targets are worked out over one row per source. Per-source figures reach the rows by a
broadcast below MAX_BROADCAST sources and by a shuffle join, which Spark splits where skewed, beyond.

Edge cases: null or blank texts have size 0 and are never taken; a source without words has target 0; a null source is a
source of its own; equal keys fall to the smaller id, then size; repeated rows are taken on their own; an empty table gives an
empty result; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.llm.common import materialise, null_safe

#: Base weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Ranges of sampling keys, by their logarithm, in each doubling of the key. Keys are exponential with the document's weight as rate, so
#: whatever the weights no range holds more than 0.26 / PER_DOUBLING of a source's documents.
PER_DOUBLING = 1024
#: Sources whose figures are broadcast at most (a row is some 100 bytes).
MAX_BROADCAST = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with target: a water level over one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # the level if this source and all with larger ratios are below their caps
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(from_here)
    ranked = ranked.withColumn("at", level).withColumn("fits", F.col("at") * F.col("w") <= F.col("cap"))
    # the first source that fits has the true level; those before it stop at their caps
    true = F.first(F.when(F.col("fits"), F.col("at")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    capped = F.coalesce(F.max(F.col("fits")).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    target = F.when(capped, true * F.col("w")).otherwise(F.col("cap").cast("double"))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def uniform(seed: str, id_: Column) -> Column:
    """A number in (0, 1) from 52 bits of MD5, so that reruns and other engines agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, seed: str = "mix", max_epochs: int = 3, per_doubling: int = PER_DOUBLING) -> DataFrame:
    """One row per input row: id, text_hash (of the text), source, size, source_size, target, taken. weights: (id, weight), one row per id; missing, null or <= 0 count as 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(weights.select("id", "weight"), "id", "left")
    rows = rows.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0))
    key = -F.log(uniform(seed, F.col("id"))) / F.col("weight")
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor(F.log2("key") * per_doubling).cast("int"))
    rows = materialise(rows.drop("weight"), "mix-rows")

    sums = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.when(F.col("epochs") >= max_epochs, 0).otherwise(F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = null_safe(sums.withColumn("upto", running), plan.select("source", "budget"), ["source"], "inner")
    ends = ends.filter("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    plan = materialise(null_safe(plan, ends, ["source"], "left"), "mix-plan")

    few = plan.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    dealt = null_safe(rows, F.broadcast(plan) if few else plan, ["source"], "inner")
    dealt = dealt.withColumn("end_bucket", F.coalesce("end.bucket", F.lit((1 << 31) - 1)))
    whole = dealt.filter("bucket != end_bucket").withColumn("extra", F.when(F.col("bucket") < F.col("end_bucket"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = dealt.filter("bucket = end_bucket").withColumn("upto", F.sum("size").over(order) + F.col("end.before"))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - (F.col("upto") - F.col("size"))))).drop("upto")
    both = whole.unionByName(last)
    return both.select("id", "text_hash", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def label_weights(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, weight) of the ids from quality labels: good 1, unlabelled 0.5, bad 0.25, toxic 0.1."""
    each = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    weight = F.when(F.col("t") == 1, 0.1).when(F.col("q") == 0, 0.25).when(F.col("q") == 1, 1.0).otherwise(0.5)
    return ids.distinct().join(each, "id", "left").select("id", weight.alias("weight"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = label_weights(docs.select(F.col("doc_id").alias("id")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, weights=weights).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH lab AS (SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
      (CAST(('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u,
      CASE WHEN t = 1 THEN 0.1 WHEN q = 0 THEN 0.25 WHEN q = 1 THEN 1.0 ELSE 0.5 END AS w FROM documents LEFT JOIN lab USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
r AS (SELECT source, n, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * n AS cap FROM s),
l AS (SELECT *, (sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
v AS (SELECT max(CASE WHEN level * w <= cap THEN level END) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, n, CASE WHEN cap < v.level * w THEN CAST(cap AS DOUBLE) ELSE v.level * w END AS target FROM l, v),
p AS (SELECT *, CASE WHEN n > 0 THEN least(CAST(floor(target / n) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CASE WHEN epochs >= 3 THEN 0 ELSE CAST(round(target - epochs * n) AS BIGINT) END AS budget FROM p),
c AS (SELECT d.doc_id, d.size, b.n AS source_size, b.target, b.epochs, b.budget,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM c
"""
