"""Exact and approximate matching as column functions.

All offsets are 0-based UTF-8 byte offsets; exact matching reports every overlapping occurrence. The Arrow functions walk
each text with the C search of `bytes.find`; texts without the pattern never reach Python (a JVM `contains` comes first).
"""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which the exact matchers are known. They give the same matches; the name is a label.
EXACT = ("KMP", "Boyer-Moore", "Rabin-Karp", "Shift-Or")
MULTI = "Aho-Corasick"
#: Matches that one call reports at most by default; the true total is always counted.
MATCH_CAP = 200_000
#: The largest error budget of a request.
MAX_ERRORS = 5
#: Patterns from which on one automaton pass replaces one pass per pattern.
AUTOMATON_FROM = 24


def to_bytes(pattern: str | bytes) -> bytes:
    return pattern.encode() if isinstance(pattern, str) else bytes(pattern)


def occurrences(text: bytes, pattern: bytes) -> list[int]:
    """Starts of all occurrences, overlapping ones too; none for an empty pattern."""
    found: list[int] = []
    if not pattern:
        return found
    at = text.find(pattern)
    while at >= 0:
        found.append(at)
        at = text.find(pattern, at + 1)
    return found


def find_all(text: Column, pattern: str | bytes) -> Column:
    """array<bigint> of the byte offsets of a pattern in a string or binary column; null text gives null."""
    needle = to_bytes(pattern)

    @F.arrow_udf("array<bigint>")
    def search(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else occurrences(t, needle) for t in column.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    if not needle:
        return F.when(text.isNotNull(), F.array().cast("array<bigint>"))
    # Python sees null instead of a text without the pattern: a condition around the function would not spare it the text
    held = F.when(F.contains(text, F.lit(needle if isinstance(pattern, bytes) else pattern)), text)
    return F.when(text.isNotNull(), F.coalesce(search(held), F.array().cast("array<bigint>")))


def find_capped(text: Column, pattern: str | bytes, cap: int, stop: bool = False) -> Column:
    """struct<matches:array<bigint>,total:bigint>: the first cap offsets and how many there are; null for null text.

    Matches beyond the cap are counted, not kept. stop: the walk ends at the first one beyond it (total is then cap + 1)."""
    needle = to_bytes(pattern)
    kind = pa.struct([("matches", pa.list_(pa.int64())), ("total", pa.int64())])

    def walk(data: bytes) -> dict:
        kept, total, at = [], 0, data.find(needle)
        while at >= 0:
            total += 1
            if total <= cap:
                kept.append(at)
            elif stop:
                break
            at = data.find(needle, at + 1)
        return {"matches": kept, "total": total}

    @F.arrow_udf("struct<matches:array<bigint>,total:bigint>")
    def search(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else walk(t) for t in column.cast(pa.binary()).to_pylist()], kind)

    none = F.struct(F.array().cast("array<bigint>").alias("matches"), F.lit(0).cast("bigint").alias("total"))
    if not needle:
        return F.when(text.isNotNull(), none)
    held = F.when(F.contains(text, F.lit(needle if isinstance(pattern, bytes) else pattern)), text)
    return F.when(text.isNotNull(), F.coalesce(search(held), none))


def timed_counts(text: Column, pattern: str, with_fuzzy: bool = True) -> Column:
    """array<struct<algorithm,match_count,duration_ms>>: every algorithm on each text, timed; null text counts as empty."""
    needle = to_bytes(pattern)
    kind = pa.list_(pa.struct([("algorithm", pa.string()), ("match_count", pa.int64()), ("duration_ms", pa.float64())]))
    near = compat_ends if len(needle) <= 64 else edit_ends
    ways = [(EXACT, lambda t: occurrences(t, needle)), ((MULTI,), lambda t: _finder([needle])(t))]
    if with_fuzzy:
        ways.append((("Fuzzy (k=1)",), lambda t: near(t, needle, 1) if t and needle else []))

    def runs(data: bytes) -> list[dict]:
        out = []
        for names, way in ways:
            began = time.perf_counter()
            count = len(way(data))
            ms = (time.perf_counter() - began) * 1000
            out += [{"algorithm": name, "match_count": count, "duration_ms": ms} for name in names]
        return out

    @F.arrow_udf("array<struct<algorithm:string,match_count:bigint,duration_ms:double>>")
    def search(column: pa.Array) -> pa.Array:
        return pa.array([runs(t or b"") for t in column.cast(pa.binary()).to_pylist()], kind)

    return search(text)


def find_all_native(text: Column, pattern: str) -> Column:
    """The same without Python, for short texts: each start is tested on the text's bytes."""
    data, size = F.encode(text, "UTF-8"), len(to_bytes(pattern))
    starts = F.sequence(F.lit(0).cast("bigint"), (F.octet_length(text) - size).cast("bigint"))
    hits = F.filter(starts, lambda i: F.substring(data, (i + 1).cast("int"), F.lit(size)) == F.encode(F.lit(pattern), "UTF-8"))
    fits = (F.octet_length(text) >= size) & F.lit(size > 0)
    return F.when(text.isNull(), F.lit(None)).when(fits, hits).otherwise(F.array().cast("array<bigint>"))


def count_all(text: Column, pattern: str) -> Column:
    """Number of occurrences, overlapping ones too, inside the JVM: a look-ahead keeps the overlaps."""
    if not pattern:
        return F.lit(0).cast("bigint")
    return F.regexp_count(text, F.lit(f"(?={quoted(pattern)})")).cast("bigint")


def quoted(pattern: str) -> str:
    """A pattern as a literal of Java regular expressions."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def find_many(text: Column, patterns: list[str | bytes]) -> Column:
    """array<struct<pattern_id:int,pos:bigint>>, ids from 0 in list order; empty patterns never match."""
    needles = [to_bytes(p) for p in patterns]

    @F.arrow_udf("array<struct<pattern_id:int,pos:bigint>>")
    def search(column: pa.Array) -> pa.Array:
        finder = _finder(needles)
        rows = [None if t is None else [{"pattern_id": k, "pos": p} for k, p in finder(t)] for t in column.cast(pa.binary()).to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("pattern_id", pa.int32()), ("pos", pa.int64())])))

    return search(text)


def find_each(text: Column, patterns: list[str | bytes]) -> Column:
    """array<array<bigint>>: the offsets of each pattern, in list order."""
    needles = [to_bytes(p) for p in patterns]

    @F.arrow_udf("array<array<bigint>>")
    def search(column: pa.Array) -> pa.Array:
        finder, rows = _finder(needles), []
        for t in column.cast(pa.binary()).to_pylist():
            if t is None:
                rows.append(None)
                continue
            lists: list[list[int]] = [[] for _ in needles]
            for k, p in finder(t):
                lists[k].append(p)
            rows.append(lists)
        return pa.array(rows, pa.list_(pa.list_(pa.int64())))

    return search(text)


def _finder(needles: list[bytes]):
    if sum(bool(n) for n in needles) < AUTOMATON_FROM:
        return lambda text: [(k, p) for k, n in enumerate(needles) for p in occurrences(text, n)]
    import ahocorasick  # only for many patterns, so that others need not have it

    automaton = ahocorasick.Automaton()
    for n in {n for n in needles if n}:
        automaton.add_word(n.decode("latin-1"), ([k for k, other in enumerate(needles) if other == n], len(n)))
    automaton.make_automaton()
    return lambda text: sorted((k, end - size + 1) for end, (ids, size) in automaton.iter(text.decode("latin-1")) for k in ids)


def compat_ends(text: bytes, pattern: bytes, k: int) -> list[int]:
    """End offsets by the engine's short approximate matcher (patterns of up to 64 bytes).

    Level e holds a set of pattern places reached with at most e errors, as the bits of a word. On each byte, level 0 is entered from the start
    and level e from what level e - 1 held before the byte: entered places must fit the byte, and for e > 0 the place behind each entering one
    is reached besides. The first level that holds the last place reports the byte, and those above are left as they were: that makes it
    neither Hamming nor edit distance. From empty levels only the pattern's first byte leads anywhere, so the scan jumps to it."""
    last, word = len(pattern) - 1, (1 << 64) - 1
    places: dict[int, int] = {}
    for place, byte in enumerate(pattern):
        places[byte] = places.get(byte, 0) + (1 << place)
    held, ends, at = [0] * (k + 1), [], -1
    while True:
        at = at + 1 if any(held) else text.find(pattern[:1], at + 1)
        if at < 0 or at >= len(text):
            return ends
        fitting, entering = places.get(text[at], 0), [1, *held]
        for level, source in zip(range(k + 1), entering, strict=False):
            reached = (2 * held[level] | source) & fitting
            if level:
                reached |= 2 * source
            held[level] = reached & word
            if reached >> last & 1:
                ends.append(at)
                break


def edit_ends(text: bytes, pattern: bytes, k: int) -> list[int]:
    """End offsets of substrings within k insertions, deletions and substitutions (bit-parallel column updates)."""
    size = len(pattern)
    full, goal = (1 << size) - 1, 1 << (size - 1)
    fits: dict[int, int] = {}
    for i, b in enumerate(pattern):
        fits[b] = fits.get(b, 0) | 1 << i
    up, down, distance, found = full, 0, size, []
    for at, byte in enumerate(text):
        same = fits.get(byte, 0)
        diagonal = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (~(across | up) & full)
        minus = up & across
        distance += bool(plus & goal) - bool(minus & goal)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if distance <= k:
            found.append(at)
    return found


def hamming_starts(text: bytes, pattern: bytes, k: int) -> list[int]:
    """Start offsets of windows that differ from the pattern in at most k bytes."""
    import numpy as np

    data, size = np.frombuffer(text, np.uint8), len(pattern)
    if len(data) < size:
        return []
    wrong = np.zeros(len(data) - size + 1, np.int32)
    for i, b in enumerate(pattern):
        wrong += data[i : len(data) - size + 1 + i] != b
    return np.flatnonzero(wrong <= k).tolist()


MODES = {"edit": edit_ends, "hamming": hamming_starts}


def find_fuzzy(text: Column, pattern: str | bytes, max_errors: int = 1, mode: str = "compat") -> Column:
    """array<bigint>: end offsets (compat, edit) or start offsets (hamming). compat uses edit distance beyond 64 bytes."""
    needle, k = to_bytes(pattern), max(0, max_errors)
    if mode not in ("compat", *MODES):
        raise ValueError(f"unknown mode {mode!r}")
    match = MODES.get(mode) or (compat_ends if len(needle) <= 64 else edit_ends)

    @F.arrow_udf("array<bigint>")
    def search(column: pa.Array) -> pa.Array:
        found = [None if t is None else match(t, needle, k) if t and needle else [] for t in column.cast(pa.binary()).to_pylist()]
        return pa.array(found, pa.list_(pa.int64()))

    return search(text)


def clamp_errors(max_errors: int) -> int:
    """The error budget of a request: 0 to MAX_ERRORS."""
    return min(MAX_ERRORS, max(0, max_errors))


def fuzzy_label(max_errors: int) -> str:
    return f"FUZZY(k={max(0, max_errors)})"


def similar_words(text: Column, word: str, max_errors: int = 1) -> Column:
    """array<string>: the text's words (ASCII letters) within an edit distance of a word, in order, inside the JVM."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1))
    return F.filter(words, lambda w: F.levenshtein(w, F.lit(word), max_errors) >= 0)
