"""Search operators over a DataFrame of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.functions import match
from glyphspark.functions.entities import enrich
from glyphspark.functions.profile import explain_selection, profile_text, select_algorithm
from glyphspark.sources.files import file_chunks

#: Matches of one text that get a snippet and entities.
ENRICH_FIRST = 50
#: Bytes of a chunk of a large text.
CHUNK_BYTES = 4 * 1024 * 1024
#: Texts that compare() accepts, in bytes, and patterns that search_multi() accepts.
COMPARE_BYTES, MAX_PATTERNS = 5_000_000, 50
ALGORITHMS = (*match.EXACT, match.MULTI, "Fuzzy")


def _checked(algorithm: str, lenient: bool) -> str:
    name = "AUTO" if algorithm.upper() == "AUTO" else algorithm
    if name not in ("AUTO", *ALGORITHMS) and not lenient:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return name


def search(texts: DataFrame, pattern: str, text_col: str = "text", algorithm: str = "AUTO", fuzzy: bool = False, max_errors: int = 1, enriched: bool = False, cap: int = match.MATCH_CAP, lenient: bool = False, stop: bool = False) -> DataFrame:
    """texts with matches (at most cap), match_count, total_count, truncated, algorithm, pattern_len [, algorithm_note] [, enriched].

    stop: a text is left at its first match beyond the cap; total_count is then cap + 1. max_errors is clamped to 0 to 5."""
    max_errors = match.clamp_errors(max_errors)
    name, size = _checked(algorithm, lenient), len(match.to_bytes(pattern))
    text = F.col(text_col)
    if fuzzy or name == "Fuzzy":
        found, label = match.find_fuzzy(text, pattern, max_errors), F.lit(match.fuzzy_label(max_errors))
        out = texts.withColumn("__all", found).withColumn("__found", F.struct(F.slice("__all", 1, cap).alias("matches"), F.size("__all").cast("bigint").alias("total"))).drop("__all")
    else:
        found, label = match.find_capped(text, pattern, cap, stop), F.lit(name)
        out = texts.withColumn("__found", found)
    note = None
    if not fuzzy and name == "AUTO":
        out = out.withColumn("__profile", profile_text(text))
        label = select_algorithm(F.lit(pattern), F.coalesce(F.col("__profile.is_monotone"), F.lit(False)))
        note = explain_selection(label, F.lit(pattern), F.col("__profile"), F.octet_length(text))
    elif not fuzzy:
        note = explain_selection(F.lit(name), F.lit(pattern))
    total = F.greatest(F.coalesce("__found.total", F.lit(0)), F.lit(0)).cast("bigint")
    out = out.withColumn("matches", F.col("__found.matches")).withColumn("total_count", total).withColumn("match_count", F.least(total, F.lit(cap).cast("bigint")))
    out = out.withColumn("truncated", F.col("total_count") > cap).withColumn("algorithm", label).withColumn("pattern_len", F.lit(size))
    if note is not None:
        out = out.withColumn("algorithm_note", note)
    if enriched:
        out = out.withColumn("enriched", enrich(text, F.slice("matches", 1, ENRICH_FIRST), size))
    return out.drop("__found", "__profile")


def positions(texts: DataFrame, pattern: str, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per match: id, pos."""
    return texts.select(id_col, F.explode(match.find_all(F.col(text_col), pattern)).alias("pos"))


def search_multi(texts: DataFrame, patterns: list[str], id_col: str, text_col: str = "text", max_patterns: int | None = None) -> DataFrame:
    """One row per text and distinct non-empty pattern: id, pattern, matches, match_count. One pass over each text for all patterns."""
    if max_patterns is not None and len(patterns) > max_patterns:
        raise ValueError(f"at most {max_patterns} patterns")
    distinct = [p for p in dict.fromkeys(patterns) if p]
    if not distinct:
        raise ValueError("at least one pattern is required")
    lists = F.coalesce(match.find_each(F.col(text_col), distinct), F.array_repeat(F.array().cast("array<bigint>"), len(distinct)))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, distinct)).alias("pattern"), lists.alias("matches")))
    rows = texts.select(id_col, each.alias("p")).select(id_col, "p.pattern", "p.matches")
    return rows.withColumn("match_count", F.size("matches").cast("bigint"))


def compare(texts: DataFrame, pattern: str, id_col: str, text_col: str = "text", max_bytes: int | None = None, with_fuzzy: bool = True) -> DataFrame:
    """One row per text and algorithm: id, algorithm, match_count, auto_selected, duration_ms, fastest, text_length (in characters).

    Each way to search is timed on each text: one walk for the exact algorithms, which are labels of it, the multi-pattern search and, unless
    with_fuzzy is off, approximate matching. The fastest is the first of the shortest. A text of over max_bytes is an error."""
    text = F.col(text_col)
    if max_bytes is not None:
        text = F.when(F.octet_length(text) <= max_bytes, text).when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"texts to compare have at most {max_bytes} bytes, not "), F.octet_length(text).cast("string"))))
    timed = match.timed_counts(F.col("__t"), pattern, with_fuzzy)
    rows = texts.select(id_col, text.alias("__t"))
    rows = rows.select(id_col, F.char_length("__t").cast("bigint").alias("text_length"), timed.alias("__runs"), select_algorithm(F.lit(pattern), F.coalesce(profile_text(F.col("__t"))["is_monotone"], F.lit(False))).alias("__auto"))
    quickest = F.array_min(F.transform("__runs", lambda r: r["duration_ms"]))
    first = F.array_position(F.transform("__runs", lambda r: r["duration_ms"]), quickest) - 1
    rows = rows.select(id_col, "text_length", "__auto", first.alias("__first"), F.posexplode("__runs").alias("__k", "__run"))
    return rows.select(id_col, "__run.algorithm", F.col("__run.match_count").alias("match_count"), (F.col("__run.algorithm") == F.col("__auto")).alias("auto_selected"), "__run.duration_ms", (F.col("__k") == F.col("__first")).alias("fastest"), "text_length")


def chunks(texts: DataFrame, id_col: str, text_col: str, overlap: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Long texts as rows id, index, start, owned, data (binary): each chunk owns `owned` bytes and reads `overlap` more."""
    data = F.col(text_col).cast("binary")
    rows = texts.select(id_col, data.alias("d"), F.octet_length(data).alias("n")).filter("n > 0")
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk_bytes))).alias("index", "start"))
    piece = F.substring("d", F.col("start") + 1, F.lit(chunk_bytes + max(0, overlap)))
    return rows.select(id_col, "index", F.col("start").cast("bigint"), F.least(F.lit(chunk_bytes), F.col("n") - F.col("start")).alias("owned"), piece.alias("data"))


def search_chunked(texts: DataFrame, pattern: str, id_col: str, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, pos of matches found chunk by chunk; a match belongs to the chunk that owns its first byte.

    Chunks are rows of their own, so one huge text is searched by many tasks after a repartition."""
    needle = match.to_bytes(pattern)
    return owned_matches(chunks(texts, id_col, text_col, len(needle) - 1, chunk_bytes), needle, id_col)


def owned_matches(parts: DataFrame, needle: bytes, id_col: str) -> DataFrame:
    """id, pos of the matches in chunks (id, start, owned, data) that start in the bytes a chunk owns."""
    found = parts.select(id_col, "start", "owned", F.explode(match.find_all(F.col("data"), needle)).alias("rel"))
    return found.filter("rel < owned").select(id_col, (F.col("start") + F.col("rel")).alias("pos"))


def search_file(spark, path: str, pattern: str | bytes, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, pos of the matches in files of any size: each task reads its chunks by offset, with the overlap a match needs."""
    needle = match.to_bytes(pattern)
    return owned_matches(file_chunks(spark, path, max(0, len(needle) - 1), chunk_bytes), needle, "path")


def new_matches(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of current that previous does not hold."""
    return current.join(previous, keys, "left_anti")
