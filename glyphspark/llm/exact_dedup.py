"""Exact dedup over an extendible-hash index on shared files.

Texts are equal when identical after deleting all white space of `[\\x20\\x09-\\x0D]`; null counts as empty. Of equal
texts the row with the most code points in the original text, then the smallest id (a null id comes last) stays.

1. One scan hashes every normalised text and writes narrow entries (no text) to the shared folder. Entries are pre-aggregated per
   hash, so a text that a third of all rows share is one index record.
2. A directory over hash prefixes starts with one bucket; an overfull bucket splits, and the directory doubles where the
   bucket is as deep as the directory. Buckets are numbered in key order, so each is a range of keys.
3. The bucket is the unit of all further work: partition b of every exchange is bucket b (repartitionById). Its owner task writes
   the bucket's index file, and later gets exactly that bucket's rows. A hot hash, whose copies no split can part, has overflow
   pages behind its bucket: owners of their own that share its rows.
4. Owners compare bytes: of the rows whose hash occurs more than once, those that differ from the least text of their hash are
   true collisions and form the next link of the chain, until none is left. Pages then compare their least texts.

Edge cases: an empty table gives an empty result; rows repeated with the same id and text are separate rows of which one
is kept, also where a hot text has null or equal ids only; a null id is a row like others; a very long text is one row of its
owner; ids keep their type; only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.llm.common import SPACE, add_salt, hot_keys, materialise, spread

#: Directory entries are hash prefixes of at most so many bits: what the driver sees is bounded by 2 ** MAX_DEPTH counts.
MAX_DEPTH = 18
#: Index records that a bucket holds before it splits.
BUCKET_RECORDS = 10_000


def build_directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Extendible hashing: counts by max_depth-bit prefix -> (global depth, bucket number of each directory slot).

    Buckets are numbered in key order. A bucket at max_depth stays overfull."""
    below = [0, *itertools.accumulate(counts.get(p, 0) for p in range(1 << max_depth))]
    depth, pending, buckets = 0, [(0, 0)], []
    while pending:
        local, prefix = pending.pop()
        width = 1 << (max_depth - local)
        if below[(prefix + 1) * width] - below[prefix * width] > capacity and local < max_depth:
            depth = max(depth, local + 1)  # a bucket as deep as the directory doubles it
            pending += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append(local)
    # a bucket of less depth than the directory stands in several slots
    return depth, [number for number, local in enumerate(buckets) for _ in range(1 << (depth - local))]


@dataclass
class Directory:
    """Routes hashes to their owners: buckets, and overflow pages of hot hashes."""

    slots: DataFrame  # __slot, __bucket: at most 2 ** MAX_DEPTH rows
    depth: int
    buckets: int
    hot: DataFrame | None  # __hot, __salts, __page (the first of its pages)
    pages: int

    def _bucketed(self, df: DataFrame) -> DataFrame:
        slot = F.shiftrightunsigned("key", 64 - self.depth).cast("int") if self.depth else F.lit(0)
        return df.withColumn("__slot", slot).join(F.broadcast(self.slots), "__slot").drop("__slot")

    def _owned(self, salted: DataFrame) -> DataFrame:
        owner = F.col("__bucket")
        if self.hot is not None:
            paged = salted.join(F.broadcast(self.hot.select("__hot", "__page")), F.col("key") == F.col("__hot"), "left")
            return paged.withColumn("owner", F.coalesce(F.col("__page") + F.col("__salt"), owner)).drop("__hot", "__page", "__bucket", "__salt").repartitionById(self.buckets + self.pages, F.col("owner"))
        return salted.withColumn("owner", owner).drop("__bucket", "__salt").repartitionById(self.buckets, F.col("owner"))

    def route(self, rows: DataFrame) -> DataFrame:
        """Rows to their owners (owner)."""
        return self._owned(add_salt(self._bucketed(rows), "key", self._salts()))

    def route_index(self, records: DataFrame) -> DataFrame:
        """Index records to their owners; those of hot hashes to all their pages."""
        return self._owned(spread(self._bucketed(records), "key", self._salts()))

    def _salts(self) -> DataFrame | None:
        return None if self.hot is None else self.hot.drop("__page")

    def by_bucket(self, records: DataFrame) -> DataFrame:
        return self._bucketed(records).withColumnRenamed("__bucket", "bucket").repartitionById(self.buckets, F.col("bucket"))


def open_directory(records: DataFrame, bucket_records: int) -> Directory:
    """The directory over records (key, n)."""
    spark, total = records.sparkSession, records.count()
    most = min(MAX_DEPTH, max(1, (4 * total // max(1, bucket_records)).bit_length()))
    prefix = F.shiftrightunsigned("key", 64 - most).cast("int")
    counts = {r[0]: r[1] for r in records.groupBy(prefix.alias("prefix")).count().collect()}  # at most 2 ** MAX_DEPTH rows
    depth, directory = build_directory(counts, bucket_records, most)
    buckets = directory[-1] + 1
    hot, pages = hot_keys(records, "key", "n"), 0
    if hot is not None:
        before = F.coalesce(F.sum("__salts").over(Window.orderBy("__hot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hot = materialise(hot.withColumn("__page", (before + buckets).cast("int")), "exact-pages")  # under HOT_MAX rows
        pages = hot.agg(F.sum("__salts")).first()[0]
    return Directory(spark.createDataFrame(list(enumerate(directory)), "__slot int, __bucket int"), depth, buckets, hot, pages)


def _hash(norm: Column, hash_bits: int) -> Column:
    h = F.xxhash64(norm)
    return h if hash_bits >= 64 else F.shiftleft(F.pmod(h, F.lit(1 << hash_bits)), 64 - hash_bits)


def _first() -> Column:
    """Sort key of the row that stays."""
    return F.struct((-F.col("n_cp")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("rid").alias("d"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_records: int = BUCKET_RECORDS, hash_bits: int = 64) -> DataFrame:
    """One row per input row: id, text_hash (of the original text), n_cp, keep_id, group_size, kept, text_sha256, copies.

    copies: rows with the same id and original text, in case a caller joins back on (id, text_hash).
    hash_bits: fewer bits force collisions, for tests of the chaining."""
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE, "")
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), F.xxhash64(F.col(text_col)).alias("text_hash"), norm.alias("norm")).withColumn("key", _hash(F.col("norm"), hash_bits))
    entries = materialise(rows.select("id", "n_cp", "text_hash", "key", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("rid")), "exact-entries")

    records = materialise(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(_first()).alias("best")), "exact-records")
    directory = open_directory(records, bucket_records)
    index = materialise(directory.by_bucket(records).sortWithinPartitions("key"), "exact-index", bucket_by="bucket").drop("bucket")

    shared, links, link, rest = index.filter("n > 1"), None, 0, None
    if not shared.isEmpty():
        owned = directory.route(rows.select("id", "text_hash", "key", "norm")).join(directory.route_index(shared.select("key")).hint("shuffle_hash"), ["owner", "key"])
        rest = materialise(_differing(owned, directory), "exact-chain")
    while rest is not None and not rest.isEmpty():
        link += 1
        here = rest.select("id", "text_hash", "key", F.lit(link).alias("link"))
        links = here if links is None else links.unionByName(here)
        rest = materialise(_differing(directory.route(rest), directory), "exact-chain")

    if links is None:
        out = directory.route(entries).join(directory.route_index(index), ["owner", "key"])
    else:  # collisions: a class is a hash and a link of its chain
        last = links.groupBy("id", "text_hash", "key").agg(F.max("link").alias("link")).withColumnsRenamed({"id": "i", "text_hash": "t", "key": "k"})
        held = entries.join(last, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")) & (F.col("key") == F.col("k")), "left").drop("i", "t", "k")
        held = held.withColumn("link", F.coalesce("link", F.lit(0)))
        classes = held.groupBy("key", "link").agg(F.count(F.lit(1)).alias("n"), F.min(_first()).alias("best"))
        out = directory.route(held).join(directory.route_index(classes), ["owner", "key", "link"])
    repeats = materialise(entries.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumnsRenamed({"id": "i", "text_hash": "t"}), "exact-repeats")
    if repeats.isEmpty():
        out = out.withColumn("copies", F.lit(1))
    else:
        out = out.join(repeats, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    return out.select("id", "text_hash", "n_cp", F.col("best.c").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("rid") == F.col("best.d")).alias("kept"), "text_sha256", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def _differing(owned: DataFrame, directory: Directory) -> DataFrame:
    """Rows whose bytes differ from the least text of their hash: found by each owner, then among the least texts of a hash's pages."""
    seen = owned.withColumn("first", F.first("norm").over(Window.partitionBy("owner", "key").orderBy("norm")))
    differs = F.col("norm") != F.col("first")
    if directory.hot is not None:
        heads = owned.filter(F.col("owner") >= directory.buckets).groupBy("owner", "key").agg(F.min("norm").alias("head"))
        top = F.first("head").over(Window.partitionBy("key").orderBy("head"))
        odd = heads.withColumn("top", top).filter("head != top").select("owner", "key", F.lit(True).alias("odd"))
        seen, differs = seen.join(F.broadcast(odd), ["owner", "key"], "left"), differs | F.col("odd")  # one row per page at most
    return seen.filter(differs).select("id", "text_hash", "key", "norm")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: DuckDB: sha256() gives lowercase hex.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
