"""Text and pattern profiles, the rule-based choice of a matcher and its explanation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphspark.schema import PROFILE

# Limits of the profile flags and of the choice.
SAMPLE_BYTES = 65_536
MONOTONE_ENTROPY, MONOTONE_BYTES = 2.0, 20
NATURAL_ENTROPY, NATURAL_BYTES = 4.5, 60
SHORT_PATTERN = 4
BIT_PATTERN = 64

_TYPE = pa.struct([("length", pa.int64()), ("unique_bytes", pa.int32()), ("entropy", pa.float64()), ("is_monotone", pa.bool_()), ("is_natural", pa.bool_()), ("has_non_ascii", pa.bool_()), ("top_byte_freq", pa.float64())])


def profile_of(sample: bytes) -> dict:
    """Shannon entropy and byte statistics of a sample; an empty one counts as monotone and natural."""
    size = len(sample)
    if not size:
        return {"length": 0, "unique_bytes": 0, "entropy": 0.0, "is_monotone": True, "is_natural": False, "has_non_ascii": False, "top_byte_freq": 0.0}
    counts = np.bincount(np.frombuffer(sample, np.uint8), minlength=256)
    used = counts[counts > 0]
    share = used / size
    entropy, unique = float(0.0 - (share * np.log2(share)).sum()), len(used)  # one byte value only: 0.0, not -0.0
    return {
        "length": size,
        "unique_bytes": unique,
        "entropy": entropy,
        "is_monotone": entropy < MONOTONE_ENTROPY or unique < MONOTONE_BYTES,
        "is_natural": entropy > NATURAL_ENTROPY and unique > NATURAL_BYTES,
        "has_non_ascii": bool(counts[128:].any()),
        "top_byte_freq": float(used.max() / size),
    }


def sample_of(text: Column) -> Column:
    """The first SAMPLE_BYTES bytes of a text."""
    return F.substring(F.encode(text, "UTF-8"), 1, SAMPLE_BYTES)


def profile_text(text: Column) -> Column:
    """struct<length,unique_bytes,entropy,is_monotone,is_natural,has_non_ascii,top_byte_freq> of a text's sample."""

    @F.arrow_udf(PROFILE)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else profile_of(t) for t in column.to_pylist()], _TYPE)

    return run(sample_of(text))


def byte_histogram(text: Column) -> Column:
    """map<int,bigint>: how often each byte value occurs in the whole text."""

    @F.arrow_udf("map<int,bigint>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.cast(pa.binary()).to_pylist():
            counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256) if t is not None else None
            rows.append(None if counts is None else [(int(b), int(counts[b])) for b in np.flatnonzero(counts)])
        return pa.array(rows, pa.map_(pa.int32(), pa.int64()))

    return run(text)


def profile_pattern(pattern: Column) -> Column:
    size, ascii_only = F.octet_length(pattern), F.octet_length(pattern) == F.char_length(pattern)
    return F.struct(size.alias("length"), (~ascii_only).alias("has_non_ascii"), ascii_only.alias("is_ascii_only"))


def select_algorithm(pattern: Column, is_monotone: Column | bool = False, multi: bool = False) -> Column:
    """The name of the matcher for a pattern; is_monotone comes from the text's profile (none: not monotone)."""
    if multi:
        return F.lit("Aho-Corasick")
    size, flat = F.octet_length(pattern), F.lit(is_monotone) if isinstance(is_monotone, bool) else is_monotone
    plain = (size <= SHORT_PATTERN) | (size != F.char_length(pattern)) | flat
    return F.when(plain, "KMP").when(size <= BIT_PATTERN, "Shift-Or").otherwise("Boyer-Moore")


# The wording of the explanations; %s stands for the pattern's bytes or the text's entropy.
REASONS = {
    "Aho-Corasick": "multiple patterns → Aho-Corasick simultaneous search",
    "KMP non-ASCII": "non-ASCII pattern (Hebrew/Unicode) → KMP byte-level scan",
    "KMP short": "very short pattern (%sB) → KMP avoids BM table overhead",
    "KMP monotone": "monotone text (entropy=%sb) → KMP guaranteed O(n+m)",
    "KMP": "KMP: safe linear-time guarantee",
    "Shift-Or": "ASCII pattern ≤64B (%sB) → bit-parallel Shift-Or",
    "Boyer-Moore": "natural/varied text, long pattern (%sB) → BM sub-linear skips",
    "Rabin-Karp": "rolling-hash path selected",
    "Fuzzy": "approximate matching requested",
}
PROFILE_REASON = "text profile: len=%sB entropy=%sb unique_bytes=%s non_ascii=%s"


def explain_selection(algorithm: Column, pattern: Column, profile: Column | None = None, text_bytes: Column | None = None) -> Column:
    """Why a matcher was chosen, with the text's profile where there is one."""
    size = F.octet_length(pattern)
    # format_number rounds the exact value half to even, as SQL does; format_string rounds 3.125 up.
    entropy = F.lit(None).cast("string") if profile is None else F.format_number(profile["entropy"], 2)
    monotone = F.lit(False) if profile is None else F.coalesce(profile["is_monotone"], F.lit(False))

    def say(key: str, *values: Column) -> Column:
        return F.format_string(REASONS[key], *values) if values else F.lit(REASONS[key])

    kmp = F.when(size != F.char_length(pattern), say("KMP non-ASCII")).when(size <= SHORT_PATTERN, say("KMP short", size)).when(monotone, say("KMP monotone", entropy)).otherwise(say("KMP"))
    reason = F.when(algorithm == "KMP", kmp).when(algorithm.isin("Shift-Or"), say("Shift-Or", size)).when(algorithm == "Boyer-Moore", say("Boyer-Moore", size))
    for name in ("Aho-Corasick", "Rabin-Karp", "Fuzzy"):
        reason = reason.when(algorithm == name, say(name))
    if profile is None:
        return F.coalesce(reason, F.lit(""))
    flag = F.when(profile["has_non_ascii"], "True").otherwise("False")
    described = F.when(profile["length"] > 0, F.format_string(PROFILE_REASON, text_bytes, entropy, profile["unique_bytes"], flag))
    return F.concat_ws("; ", reason, described)
