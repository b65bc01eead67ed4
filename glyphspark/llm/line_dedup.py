"""Line dedup: lines that many documents share stay in one of them.

Every text is split at \\n (null or empty: one empty line). A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at
both ends with A-Z lower-cased. Lines whose key has at least `min_chars` code points and is found in at least `min_docs`
documents go, except in the largest id that holds it.

1. Each document's keys are hashed (128 bits) and made distinct within its row; counts and largest ids are then
   pre-aggregated per task before the shuffle, so a line that every document holds is one row from each task.
2. Hashes over the threshold are written to the shared folder. Line positions meet them by (hash, salt): hot hashes are
   dealt over many salts.
3. Documents with lines to drop meet their positions by id and are put together again by position.

Edge cases: an empty table gives an empty result; a row with a null id counts as one document that never holds the
largest id unless no other document holds the line; repeated rows of one id count as one document and each gets the same
result; a very long text costs memory in proportion to its own length in one task, as each of its lines is a row; ids keep their
type; only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspark.llm.common import SPACE, add_salt, ascii_lower, hot_keys, materialise, null_safe, spread


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    """128 bits of hash: at 10 ** 13 distinct lines, two of them clash with a chance of about 10 ** -13."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: id, n_lines, dropped (positions of the lines that go, from 0), kept_text."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_enough = lambda key: F.length(key) >= min_chars
    own = F.filter(F.array_distinct(F.transform(_lines(), _key)), long_enough)
    each = texts.select("id", F.explode(F.transform(own, _hash)).alias("k"))
    seen = each.groupBy("k.h", "k.g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    # over-counting is possible only where one id has several rows, so only then are distinct ids counted
    seen = materialise(seen.filter(F.col("n") >= min_docs), "lines-seen")
    repeats = materialise(texts.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id"), "lines-repeats")
    if not repeats.isEmpty():
        again = null_safe(each, repeats, ["id"], "left_semi")
        surplus = again.groupBy("k.h", "k.g").agg((F.count(F.lit(1)) - F.count_distinct(F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("more"))
        seen = seen.join(surplus, ["h", "g"], "left").withColumn("n", F.col("n") - F.coalesce("more", F.lit(0))).filter(F.col("n") >= min_docs)
        seen = materialise(seen, "lines-common")

    hot = hot_keys(seen, "h", "n")
    keyed = F.filter(F.transform(_lines(), lambda line, i: F.struct(_key(line).alias("key"), i.alias("pos"))), lambda x: long_enough(x["key"]))
    hashed = F.transform(keyed, lambda x: F.struct(_hash(x["key"]).alias("k"), x["pos"].alias("pos")))
    places = texts.withColumn("th", F.xxhash64("text")).select("id", "th", F.explode(hashed).alias("x")).select("id", "th", "x.k.h", "x.k.g", "x.pos")
    common = spread(seen.select("h", "g", "last"), "h", hot)
    found = add_salt(places, "h", hot).join(common, ["h", "g", "__salt"])
    drops = found.filter(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "th").agg(F.collect_set("pos").alias("dropped"))
    drops = materialise(drops, "lines-dropped")

    rows = null_safe(texts.withColumn("th", F.xxhash64("text")), drops.hint("shuffle_hash"), ["id", "th"], "left")
    rows = rows.withColumn("lines", _lines()).withColumn("dropped", F.coalesce(F.array_sort("dropped"), F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    put_together = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    kept = F.when(F.size("dropped") == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(put_together)
    return rows.select("id", F.size("lines").cast("long").alias("n_lines"), "dropped", kept.alias("kept_text"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id <> c.last, FALSE) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
