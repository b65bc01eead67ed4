"""Substring dedup: repeated passages go, the earliest occurrence stays, original offsets are retained.

Units are normalised (A-Z lower-cased, white space to one space), hashed to 96 bits and grouped globally:
* lines (or paragraphs, or sentences: `unit`) of at least `min_words` words; 1 takes every one of them, whatever its length;
* with `windows`, windows of WINDOW words, wherever they stand in or across lines. Hashing each window would cost a row per word, so a text
  offers the least hash of every SPAN neighbouring windows (winnowing): two texts that share WINDOW + SPAN - 1 (48) words in
  a row always offer a common window, and windows with fewer than WINDOW words in common never meet.
Whole units miss passages that stand inside longer lines, so the windows are an addition to the unit method.

1. Units are written once and counted per hash, pre-aggregated in each task.
2. Units whose hash occurs again meet its count by (hash, salt), hot hashes over many salts; of these few the earliest
   occurrence by (id, position) is found, and all others are marked.
3. Offered windows are anchors only: a repeated passage starts up to SPAN - 1 words before its first one and ends as far
   behind its last one. Anchors with unmarked words that near are edges; wherever an edge's hash occurs, all windows
   within SPAN - 1 words are counted as in 1, and those with unmarked words are marked as in 2. So of a passage of
   WINDOW + SPAN - 1 words or more that an earlier text has, every word goes.
4. Marked units that overlap or touch are one span, and spans go.

Edge cases: null and empty texts have no units; rows repeated with one id and text count as one; a null id ranks last; a
repetition inside one document leaves its first occurrence whole; an empty table gives an empty result; a very long text is read whole
by one task; ids keep their type; only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm.common import add_salt, hot_keys, materialise, null_safe, spread, type_of

WINDOW, SPAN = 32, 17
#: Words of a line that counts as a unit by default: as many as a window has. Shorter repeated lines are headings, signatures and the like.
MIN_WORDS = WINDOW
#: Where texts are cut into units.
UNITS = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n[ \t\r\x0b\x0c]*\n"), "sentence": re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\n")}
STEP = 128
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, kept for later texts."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _rolled(words: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Hashes of all windows of WINDOW words from sums of word hashes times powers, modulo 2 ** 64."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power(inverse, n), dtype=np.uint64)])
    return _mixed((sums[WINDOW:] - sums[:-WINDOW]) * _power(base, n)[: n - WINDOW + 1])


def window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of hash of all windows; WINDOW words or more."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return _rolled(each, *_BASES[0]), (_rolled(each, *_BASES[1]) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offered windows: first word, 64 and 32 bits of hash."""
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none
    h, g = window_hashes(words)
    # equal hashes (a text that repeats itself) fall to every SPAN-th place
    ranked = (h & ~np.uint64(1)) | (np.arange(len(h)) % SPAN != 0).astype(np.uint64)
    if len(h) <= SPAN:
        at = np.array([int(np.argmin(ranked))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(ranked, SPAN)
        at = np.unique(np.concatenate([np.argmin(view[i : i + 65536], 1) + np.arange(i, min(i + 65536, len(view))) for i in range(0, len(view), 65536)]))
    return at, h[at].view(np.int64), g[at]


def units_of(text: bytes, unit: str = "line", min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """Units of min_words words or more: first word, word after the last, normalised unit."""
    found, first = [], 0
    for piece in UNITS[unit].split(text):
        words = piece.split()
        if words and len(words) >= min_words:
            found.append((first, first + len(words), b" ".join(words)))
        first += len(words)
    return found


def _units(unit: str, min_words: int, with_windows: bool):
    """Rows (id, th, first, size, room, h, g) of all units; room: words that follow, SPAN - 1 at most; g < 0: a line, paragraph or sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off in range(0, batch.num_rows, STEP):
                part = batch.slice(off, STEP)
                parts: list[tuple] = []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    text = text.translate(LOWER)
                    words = text.split()
                    at, h, g = windows(words if with_windows else [])
                    size = np.full(len(at), WINDOW)
                    if whole := units_of(text, unit, min_words):
                        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(norm) for _, _, norm in whole), "<u8").reshape(-1, 2)
                        at = np.concatenate([at, np.array([a for a, _, _ in whole], np.int64)])
                        size = np.concatenate([size, np.array([b - a for a, b, _ in whole], np.int64)])
                        h = np.concatenate([h, digests[:, 0].view(np.int64)])
                        g = np.concatenate([g, -(digests[:, 1] & np.uint64(0x7FFFFFFF)).astype(np.int64) - 1])
                    parts.append((at, size, np.minimum(len(words) - at - size, SPAN - 1), h, g))
                owner = pa.array(np.repeat(np.arange(part.num_rows), [len(p[0]) for p in parts]))
                first, size, room, h, g = (np.concatenate([p[k] for p in parts]) for k in range(5))
                columns = [part.column(0).take(owner), part.column(1).take(owner), *(pa.array(x, pa.int32()) for x in (first, size, room)), pa.array(h, pa.int64()), pa.array(g, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "pos", "size", "room", "h", "g"])

    return run


def covered(marks: list[dict]) -> list[list]:
    """Marked units that overlap or touch as one: first word, word after the last, keep_id of the first unit."""
    merged: list[list] = []
    for m in sorted(marks, key=lambda m: (m["pos"], -m["size"])):
        # own: words up to here are the occurrence that stays, in this very document
        a, b = max(m["pos"], m["own"]), m["pos"] + m["size"]
        if a >= b:
            continue
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, m["keep_id"]])
    return merged


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g) of marked windows that have unmarked words within SPAN - 1 words."""
    for batch in batches:
        for off in range(0, batch.num_rows, STEP):
            found = set()
            for marks in batch.slice(off, STEP).column(0).to_pylist():
                merged = covered(marks)
                starts = [a for a, _, _ in merged]
                for m in marks:
                    if m["g"] < 0:
                        continue
                    k = bisect_right(starts, max(0, m["pos"] - SPAN + 1)) - 1
                    if k < 0 or merged[k][1] < m["pos"] + m["size"] + m["room"]:
                        found.add((m["h"], m["g"]))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([g for _, g in found], pa.int32())], ["h", "g"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, pos, h, g, open) of all windows within SPAN - 1 words of edges; open: it has unmarked words."""
    for batch in batches:
        for off in range(0, batch.num_rows, STEP):
            part, parts, rows = batch.slice(off, STEP), [], []
            for row, (text, marks) in enumerate(zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist(), strict=True)):
                edges = np.array([m["pos"] for m in marks if m["near"]], np.int64)
                if not len(edges):
                    continue
                words = text.translate(LOWER).split()
                h, g = window_hashes(words)
                at = np.unique((edges[:, None] + np.arange(1 - SPAN, SPAN)).ravel())
                at = at[(at >= 0) & (at < len(h))]
                marked = np.zeros(len(words) + 1, np.int64)
                for a, b, _ in covered([m for m in marks if m["later"]]):
                    marked[a + 1 : b + 1] = 1
                marked = np.cumsum(marked)
                parts.append((at, h[at].view(np.int64), g[at], marked[at + WINDOW] - marked[at] < WINDOW))
                rows += [row] * len(at)
            if parts:
                at, h, g, is_open = (np.concatenate([p[k] for p in parts]) for k in range(4))
                owner = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(at, pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(is_open)], ["id", "th", "pos", "h", "g", "open"]
                )


SPANS = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for off in range(0, batch.num_rows, STEP):
            part, rows, owners, keeps = batch.slice(off, STEP), [], [], []
            for row, (text, marks) in enumerate(zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist(), strict=True)):
                merged = covered(marks)
                places = [w.span() for w in WORD.finditer(text)]
                at = chars = 0
                for a, b, keep in merged:
                    start, end = places[a][0], places[b - 1][1]
                    first = chars + len(text[at:start].decode())
                    chars, at = first + len(text[start:end].decode()), end
                    rows.append({"start": first, "end": chars, "n_words": b - a})
                    owners.append(row)
                    keeps.append(keep)
            owner, spans = pa.array(owners, pa.int64()), pa.array(rows, SPANS)
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), *spans.flatten(), pa.array(keeps, part.column(0).type)], ["id", "text_hash", "start", "end", "n_words", "keep_id"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, with_windows: bool = True) -> DataFrame:
    """One row per removed span: id, text_hash (of the text), start, end (code points), n_words, keep_id (the document
    that keeps the earliest occurrence of the span's first unit).

    unit: line, paragraph or sentence; min_words: the shortest unit (1: all); with_windows: passages inside units, too."""
    kind = type_of(docs, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).filter("text <> ''")
    each = materialise(texts.mapInArrow(_units(unit, min_words, with_windows), f"id {kind}, th long, pos int, size int, room int, h long, g int"), "units")
    met, hot = _met(each, "units")
    met = materialise(met, "units-met")
    spans = f"id {kind}, text_hash long, start long, end long, n_words long, keep_id {kind}"
    mark = F.struct("pos", "size", "own", "keep_id")
    if not with_windows:
        marks = met.filter("later").groupBy("id", "th").agg(F.collect_set(mark).alias("marks"))
        return null_safe(texts, marks.hint("shuffle_hash"), ["id", "th"], "inner").select("id", "th", "text", "marks").mapInArrow(_spans, spans)
    marks = met.filter("later").groupBy("id", "th").agg(F.collect_set(F.struct("pos", "size", "room", "own", "h", "g", F.lit(None).cast("int").alias("keep_id"))).alias("marks"))
    edges = materialise(marks.select("marks").mapInArrow(_edges, "h long, g int").distinct(), "units-edges")
    near = spread(edges.withColumn("near", F.lit(True)), "h", hot).hint("shuffle_hash")
    flagged = add_salt(met, "h", hot).join(near, ["h", "g", "__salt"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    marks = flagged.filter("later or near").groupBy("id", "th").agg(F.collect_set(F.struct("pos", "size", "own", "keep_id", "later", "near")).alias("marks"))
    held = materialise(null_safe(texts, marks.hint("shuffle_hash"), ["id", "th"], "inner").select("id", "th", "text", "marks"), "units-held")
    beside = materialise(held.filter(F.exists("marks", lambda m: m["near"])).mapInArrow(_beside, f"id {kind}, th long, pos int, h long, g int, open boolean"), "units-beside")
    more, _ = _met(beside.withColumn("size", F.lit(WINDOW)), "beside", "open")
    more = more.filter("later").groupBy("id", "th").agg(F.collect_set(mark).alias("more"))
    held = null_safe(held, more.hint("shuffle_hash"), ["id", "th"], "left")
    first = F.transform(F.filter("marks", lambda m: m["later"]), lambda m: F.struct(m["pos"].alias("pos"), m["size"].alias("size"), m["own"].alias("own"), m["keep_id"].alias("keep_id")))
    held = held.select("id", "th", "text", F.when(F.col("more").isNull(), first).otherwise(F.concat(first, "more")).alias("marks")).filter("size(marks) > 0")
    return held.mapInArrow(_spans, spans)


def _met(units: DataFrame, label: str, only: str = "true") -> tuple[DataFrame, DataFrame | None]:
    """Units (those with `only`) whose hash occurs again, with own, keep_id and later (not the earliest occurrence); hot hashes."""
    seen = units.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(only).cast("int")).alias("of_use")).filter("n > 1 and of_use = 1")
    seen = materialise(seen.select("h", "g", "n"), f"{label}-shared")
    hot = hot_keys(seen, "h", "n")
    again = add_salt(units, "h", hot).join(spread(seen.drop("n"), "h", hot).hint("shuffle_hash"), ["h", "g", "__salt"]).drop("__salt")
    again = materialise(again, f"{label}-again")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")
    firsts = again.groupBy("h", "g").agg(F.min(rank).alias("first")).select("h", "g", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"), F.col("first.pos").alias("first_pos"))
    found = add_salt(again.filter(only), "h", hot).join(spread(firsts, "h", hot).hint("shuffle_hash"), ["h", "g", "__salt"]).drop("__salt")
    here = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    own = F.when(here, F.col("first_pos") + F.col("size")).otherwise(0)
    found = found.withColumn("own", own).withColumn("later", ~(here & (F.col("pos") == F.col("first_pos")))).withColumnRenamed("first_id", "keep_id")
    return found.drop("first_th", "first_pos"), hot


def remaining_text(text, spans):
    """A text without its spans (sorted array of structs with start and end, in code points), as a Column."""
    cut = F.aggregate(spans, F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
                      lambda a, s: F.struct(F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("done"), s["end"].alias("at")))
    return F.concat(cut["done"], F.substring(text, (cut["at"] + 1).cast("int"), F.length(text)))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "start", "end", "n_words", "keep_id")
