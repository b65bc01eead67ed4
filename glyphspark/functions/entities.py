"""Rule-based entity extraction: values and counts inside the JVM, offsets by an Arrow function."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphspark.functions.names import ENGLISH_FIRST, ENGLISH_LAST, ENGLISH_MONTHS, HEBREW_FIRST, HEBREW_IN, HEBREW_LAST, HEBREW_MONTHS
from glyphspark.functions.text import CONTEXT_CHARS, char_offset, snippet
from glyphspark.schema import ENTITY

_MONTHS = "|".join(ENGLISH_MONTHS + HEBREW_MONTHS + [HEBREW_IN + m for m in HEBREW_MONTHS])
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_AREA = r"(?:[23489]|5[0-9]|77)[-\s]?\d{3}[-\s]?\d{4}"
# The grammar of each entity type, in the order of the types.
PATTERNS = {
    "DATE": rf"\b(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{1,2}}\s+(?:{_MONTHS})(?:\s+\d{{2,4}})?)\b",
    "TIME": r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s?[AaPp][Mm])?\b",
    "EMAIL": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
    "PHONE": rf"(?:\+972[-\s]?{_AREA}|0{_AREA}|\+[1-9]\d{{1,3}}[-\s]?\(?\d+\)?[-\s]?\d+[-\s]?\d+)",
    "IP_ADDRESS": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "IP_ADDRESS v6": r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b",
    "URL": r"\bhttps?://[^\s\"'<>]+|\bftp://[^\s\"'<>]+",
    "HASHTAG": r"(?<!\w)#[\w֐-׿]+",
    "MENTION": r"(?<!\w)@[\w֐-׿]+",
    "ISRAELI_ID": r"\b\d{9}\b",
}
#: Names stand between line ends, white space and these.
NAME_BREAK = r"[\s,.()\[\]\"']"
NAME_TOKENS = {"HEBREW_NAME": ("[֐-׿]{2,}", HEBREW_FIRST | HEBREW_LAST), "ENGLISH_NAME": ("[A-Z][a-z]+", ENGLISH_FIRST | ENGLISH_LAST)}
TYPES = ["DATE", "TIME", "EMAIL", "PHONE", "IP_ADDRESS", "URL", "HASHTAG", "MENTION", "ISRAELI_ID", "HEBREW_NAME", "ENGLISH_NAME"]


def values(text: Column, kind: str) -> Column:
    """array<string> of the values of one type ("IP_ADDRESS v6" for the second address form), left to right."""
    if kind in NAME_TOKENS:
        shape, names = NAME_TOKENS[kind]
        tokens = F.split(text, f"(?U){NAME_BREAK}", -1)
        return F.filter(tokens, lambda t: t.isin(sorted(n for n in names if re.fullmatch(shape, n))))
    found = F.regexp_extract_all(text, F.lit(f"(?U){PATTERNS[kind]}"), F.lit(0))
    return F.filter(found, valid_check_digit) if kind == "ISRAELI_ID" else found


def valid_check_digit(value: Column) -> Column:
    return (F.length(value) == 9) & F.call_function("luhn_check", value)


def counts(text: Column) -> Column:
    """map<string,int>: entities of each type."""
    parts = {kind: F.size(values(text, kind)) for kind in TYPES}
    parts["IP_ADDRESS"] = parts["IP_ADDRESS"] + F.size(values(text, "IP_ADDRESS v6"))
    return F.create_map(*[x for kind in TYPES for x in (F.lit(kind), parts[kind])])


@cache
def _compiled() -> list[tuple[str, re.Pattern]]:
    return [(kind.split()[0], re.compile(rx)) for kind, rx in PATTERNS.items()]


@cache
def _name_runs() -> re.Pattern:
    return re.compile(NAME_BREAK[:1] + "^" + NAME_BREAK[1:] + "+")


def _checks(value: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(value)]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def entities_of(text: str) -> list[dict]:
    """All entities of a text by start; types keep their order where they start together."""
    found = []
    for kind, rx in _compiled():
        found += [{"type": kind, "value": m[0], "start": m.start(), "end": m.end()} for m in rx.finditer(text) if kind != "ISRAELI_ID" or _checks(m[0])]
    for kind, (shape, names) in NAME_TOKENS.items():
        found += [{"type": kind, "value": m[0], "start": m.start(), "end": m.end()} for m in _name_runs().finditer(text) if m[0] in names and re.fullmatch(shape, m[0])]
    return sorted(found, key=lambda e: e["start"])


_ENTITY = pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def extract_entities(text: Column) -> Column:
    """array<struct<type,value,start,end>> with character offsets."""

    @F.arrow_udf(f"array<{ENTITY}>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else entities_of(t) for t in column.to_pylist()], pa.list_(_ENTITY))

    return run(text)


def enrich(text: Column, offsets: Column, pattern_bytes: int, context: int = CONTEXT_CHARS) -> Column:
    """array<struct<byte_offset,char_offset,snippet,entities>> of matches at byte offsets.

    Offsets and snippets are column expressions; only the entities of the snippets need Python, and are shifted to the whole text after."""
    places = F.transform(offsets, lambda at: F.struct(at.alias("byte"), char_offset(text, at).cast("bigint").alias("char")))
    snippets = F.transform(places, lambda x: snippet(text, x["char"], pattern_bytes, context))

    @F.arrow_udf(f"array<array<{ENTITY}>>")
    def inside(column: pa.Array) -> pa.Array:
        return pa.array([None if row is None else list(map(entities_of, row)) for row in column.to_pylist()], pa.list_(pa.list_(_ENTITY)))

    def shifted(entity: Column, by: Column) -> Column:
        return F.struct(entity["type"].alias("type"), entity["value"].alias("value"), (entity["start"] + by).cast("int").alias("start"), (entity["end"] + by).cast("int").alias("end"))

    def one(x: Column) -> Column:
        by = F.greatest(x["p"]["char"] - context, F.lit(0))
        return F.struct(x["p"]["byte"].alias("byte_offset"), x["p"]["char"].alias("char_offset"), x["s"].alias("snippet"), F.transform(x["e"], lambda e: shifted(e, by)).alias("entities"))

    return F.transform(F.arrays_zip(places.alias("p"), snippets.alias("s"), inside(snippets).alias("e")), one)
