"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over training token windows.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. A window is `n` consecutive words of
a test item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a window is
hit. Candidate windows (all words in the test vocabulary, rolling hash in the set) are verified word by word.

The test set is broadcast in blocks of some BLOCK_BYTES of text (one longer item is a block of its own): its size is measured first, a
larger set is scanned in several passes, one after the other: each pass writes its hits and frees its block before the next is built,
and the hits are merged per document. Documents are never shuffled in a single pass.

Edge cases: null text has no words and is never contaminated; an item without words has no window; repeated items count
once by item_id (a null item_id shows as "null"); an empty table on either side gives zero hits; repeated rows are judged
on their own in a single pass and alike in several; ids keep their type; a very long text is
scanned whole in one task; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glyphspark.llm.common import materialise, null_safe, type_of

#: Text of test items that one pass holds (the broadcast is some ten times as large in memory).
BLOCK_BYTES = 8_000_000
#: Lower-cases A-Z and turns other ASCII than letters and digits into spaces; bytes over 127 are parts of words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Rows handled at once in Python.
STEP = 128

SCHEMA = "text_hash long, n_words long, spans array<struct<first:int,end:int,start_char:int,end_char:int>>, items array<string>"
ARROW = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())]))), ("items", pa.list_(pa.string()))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of test items: vocabulary, items by window, rolling hashes by length."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[bytes, set[str]] = {}
        lengths: dict[int, set[bytes]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode() if text else None)], np.int32)
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                window = ids[i : i + size].tobytes()
                self.owners.setdefault(window, set()).add("null" if item_id is None else str(item_id))
                lengths.setdefault(size, set()).add(window)
        self.hashes = {size: np.unique(self.rolled(np.frombuffer(b"".join(ws), np.int32), np.arange(0, size * len(ws), size), size)) for size, ws in lengths.items()}

    @staticmethod
    def rolled(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64)
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (first word, word after the last) and the items found."""
        ids = np.fromiter(map(self.vocabulary.get, words, (0 for _ in words)), np.int32, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        hits, items = [], set()
        for size, known in self.hashes.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if len(starts):
                h = self.rolled(ids, starts, size)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for i in starts[known[at] == h]:
                    owners = self.owners.get(ids[i : i + size].tobytes())
                    if owners:
                        items |= owners
                        hits.append((int(i), int(i) + size))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def _chars(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    places = [m.span() for m in WORD.finditer(text)]
    out, at, chars = [], 0, 0
    for a, b in spans:
        row = {"first": a, "end": b}
        for name, to in (("start_char", places[a][0]), ("end_char", places[b - 1][1])):
            chars, at = chars + len(text[at:to].decode()), to
            row[name] = chars
        out.append(row)
    return out


def _scan(docs: DataFrame, items: list[tuple[object, str | None]], n: int) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, n))
    id_type = type_of(docs, "id")
    fields = ARROW.set(0, pa.field("id", to_arrow_type(docs.schema["id"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for off in range(0, batch.num_rows, STEP):
                part, rows = batch.slice(off, STEP), []
                for i, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    words = words_of(text)
                    spans, found = windows.scan(words) if words else ([], set())
                    rows.append({"id": i, "text_hash": h, "n_words": len(words), "spans": _chars(text, spans) if spans else [], "items": sorted(found)})
                yield pa.RecordBatch.from_pylist(rows, fields)

    return docs.mapInArrow(run, f"id {id_type}, {SCHEMA}"), shared


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, text_hash, n_words, spans (hit words and their code points in the text), items, n_hit, contaminated."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    items = benchmark.select("item_id", "text").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    parts = max(1, -(-(items.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    held = lambda k: [(r[0], r[1]) for r in items.filter(block == k).select("item_id", "text").collect()]  # noqa: E731  block_bytes of text
    if parts == 1:
        out, _ = _scan(texts, held(0), n)
    else:
        every = None
        for k in range(parts):
            found, shared = _scan(texts, held(k), n)
            found = materialise(found if k == 0 else found.filter(F.size("spans") > 0), "decontaminate-hits")
            shared.destroy()
            every = found if every is None else every.unionByName(found)
        every = every.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        out = null_safe(texts.select("id", "text_hash"), every.withColumn("spans", _merged(F.array_sort("spans"))), ["id", "text_hash"], "inner")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merged(spans):
    """Sorted spans -> disjoint spans."""
    kind = "array<struct<first:int,end:int,start_char:int,end_char:int>>"

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"), last["start_char"].alias("start_char"), F.greatest(last["end_char"], s["end_char"]).alias("end_char"))
        apart = (F.size(done) == 0) | (s["first"] > F.try_element_at(done, F.lit(-1))["end"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(spans, F.array().cast(kind), lambda a, s: add(a, s).cast(kind))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.array_join("items", ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p + 1:p + least(13, len(w))], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, p, n FROM gram JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
