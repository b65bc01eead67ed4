"""Queries of profiles, matcher choice, entities, snippets and display functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from glyphspark.functions import entities, match, profile
from glyphspark.functions import text as tx
from glyphspark.operators.analytics import grouped_entities
from glyphspark.plans.registering import collector
from glyphspark.plans.views import notes, notes_sql, spread_out, table

QUERIES, ORACLES, query = collector()

_PROFILE = f"""
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')[1:{profile.SAMPLE_BYTES}]) AS x FROM documents),
c AS (SELECT doc_id, x, count(*) AS c FROM b GROUP BY doc_id, x),
p AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS length, count(*) AS unique_bytes, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy, max(x >= '80') AS has_non_ascii, max(c) / CAST(sum(c) AS DOUBLE) AS top_byte_freq FROM c GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(length, 0) AS length, coalesce(unique_bytes, 0) AS unique_bytes, coalesce(entropy, 0) AS entropy, coalesce(entropy, 0) < 2.0 OR coalesce(unique_bytes, 0) < 20 AS is_monotone,
      coalesce(entropy, 0) > 4.5 AND coalesce(unique_bytes, 0) > 60 AS is_natural, coalesce(has_non_ascii, FALSE) AS has_non_ascii, coalesce(top_byte_freq, 0) AS top_byte_freq FROM documents d LEFT JOIN p USING (doc_id))
"""


@query(_PROFILE + "SELECT doc_id, length, CAST(unique_bytes AS INTEGER) AS unique_bytes, round(entropy, 6) AS entropy, is_monotone, is_natural, has_non_ascii, round(top_byte_freq, 6) AS top_byte_freq FROM f")
def text_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", profile.profile_text(F.col("text")).alias("p")).select("doc_id", "p.*")
    return rows.withColumn("entropy", F.round("entropy", 6)).withColumn("top_byte_freq", F.round("top_byte_freq", 6))


@query("SELECT doc_id, ('0x' || x)::INTEGER AS byte, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY doc_id, x")
def byte_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(profile.byte_histogram(F.col("text"))).alias("byte", "n"))


def _choice(pattern: str, flat: str) -> str:
    size = f"strlen({pattern})"
    return f"CASE WHEN {size} <= 4 OR {size} <> length({pattern}) OR {flat} THEN 'KMP' WHEN {size} <= 64 THEN 'Shift-Or' ELSE 'Boyer-Moore' END"


_FIRST_WORDS = "coalesce(nullif(left(text, 1 + CAST(doc_id % 90 AS INTEGER)), ''), 'x')"


def _pattern():
    """A pattern per document: its first 1 to 90 characters."""
    return F.coalesce(F.nullif(F.substring("text", F.lit(1), (F.col("doc_id") % 90 + 1).cast("int")), F.lit("")), F.lit("x"))


@query(_PROFILE + f"SELECT doc_id, {_choice('pattern', 'is_monotone')} AS algorithm FROM (SELECT doc_id, {_FIRST_WORDS} AS pattern FROM documents) JOIN f USING (doc_id)")
def select_algorithm(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _pattern().alias("pattern"), profile.profile_text(F.col("text")).alias("p"))
    return rows.select("doc_id", profile.select_algorithm(F.col("pattern"), F.col("p.is_monotone")).alias("algorithm"))


_SAID = {k: "'" + r.replace("%s", "' || {} || '") + "'" for k, r in profile.REASONS.items()}
_BITS = "format('{{:.2f}}', entropy)"


@query(_PROFILE + f"""
SELECT doc_id, concat_ws('; ', CASE algorithm
  WHEN 'KMP' THEN CASE WHEN n <> length(pattern) THEN {_SAID['KMP non-ASCII']} WHEN n <= 4 THEN {_SAID['KMP short'].format('n')} ELSE {_SAID['KMP monotone'].format(_BITS)} END
  WHEN 'Shift-Or' THEN {_SAID['Shift-Or'].format('n')} ELSE {_SAID['Boyer-Moore'].format('n')} END,
  CASE WHEN size > 0 THEN concat('text profile: len=', size, 'B entropy=', {_BITS}, 'b unique_bytes=', unique_bytes, ' non_ascii=', CASE WHEN has_non_ascii THEN 'True' ELSE 'False' END) END) AS reason
FROM (SELECT doc_id, pattern, strlen(pattern) AS n, size, entropy, unique_bytes, has_non_ascii, {_choice('pattern', 'is_monotone')} AS algorithm FROM (SELECT doc_id, {_FIRST_WORDS} AS pattern, strlen(text) AS size FROM documents) JOIN f USING (doc_id))""".replace("{{:.2f}}", "{:.2f}"))
def explain_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _pattern().alias("pattern"), profile.profile_text(F.col("text")).alias("p"), F.octet_length("text").alias("n"))
    why = profile.explain_selection(profile.select_algorithm(F.col("pattern"), F.col("p.is_monotone")), F.col("pattern"), F.col("p"), F.col("n"))
    return rows.select("doc_id", why.alias("reason"))


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS length, strlen(text) <> length(text) AS has_non_ascii, strlen(text) = length(text) AS is_ascii_only FROM documents WHERE text IS NOT NULL")
def pattern_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", profile.profile_pattern(F.col("text")).alias("p")).select("doc_id", "p.*")


#: Types whose grammar both engines read as it is.
_SQL_PATTERNS = {k: v for k, v in entities.PATTERNS.items() if k not in ("HASHTAG", "MENTION")}
#: Where the entities are looked for: (key, text) of three tables.
_TEXTS_SQL = f"(SELECT page_id AS id, html AS t FROM pages UNION ALL SELECT doc_id, text FROM documents UNION ALL SELECT note_id, text FROM ({notes_sql()}))"


def _texts(spark, sf_dir):
    pages, documents = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("t")).unionAll(documents.select("doc_id", "text")).unionAll(notes(spark, sf_dir).select("note_id", "text"))


def _names_of(kind: str) -> str:
    shape, names = entities.NAME_TOKENS[kind]
    return ", ".join("'" + n.replace("'", "''") + "'" for n in sorted(names) if re.fullmatch(shape, n))


_CHECKED = " + ".join(f"(CASE WHEN {w} * d[{i}] > 9 THEN {w} * d[{i}] - 9 ELSE {w} * d[{i}] END)" for i, w in enumerate((1, 2) * 4 + (1,), 1))


def _found_sql(kind: str, t: str = "t") -> str:
    """The list of the values of one type in a text, as SQL."""
    if kind in entities.NAME_TOKENS:
        return f"list_filter(string_split_regex({t}, '[\\s,.()\\[\\]\"'']'), lambda x: x IN ({_names_of(kind)}))"
    if kind in ("HASHTAG", "MENTION"):  # no look-behind in SQL: the character before is read, too
        mark = "#" if kind == "HASHTAG" else "@"
        return f"regexp_extract_all({t}, '(?:^|[^\\w\\x{{0080}}-\\x{{10FFFF}}])({mark}[\\w\\x{{00AA}}-\\x{{10FFFF}}]+)', 1)"
    rx = _SQL_PATTERNS[kind].replace("'", "''")
    found = f"regexp_extract_all({t}, '{rx}')"
    if kind == "ISRAELI_ID":
        digits = _CHECKED.replace("d[", "CAST(string_split(x, '') AS INTEGER[])[")
        return f"list_filter({found}, lambda x: ({digits}) % 10 = 0)"
    return found


def _register_values(name: str, kind: str) -> None:
    def values(spark, sf_dir):
        return _texts(spark, sf_dir).select("id", F.explode(entities.values(F.col("t"), kind)).alias("value"))

    QUERIES[name] = values
    ORACLES[name] = f"SELECT id, unnest({_found_sql(kind)}) AS value FROM {_TEXTS_SQL}"


for _name, _kind in (
    ("entity_date", "DATE"), ("entity_time", "TIME"), ("entity_email", "EMAIL"), ("entity_phone", "PHONE"), ("entity_ipv4", "IP_ADDRESS"), ("entity_ipv6", "IP_ADDRESS v6"), ("entity_url", "URL"),
    ("entity_id_number", "ISRAELI_ID"), ("entity_hashtag", "HASHTAG"), ("entity_mention", "MENTION"), ("entity_english_name", "ENGLISH_NAME"), ("entity_hebrew_name", "HEBREW_NAME"),
):
    _register_values(_name, _kind)


def _lengths_sql(kind: str) -> str:
    return " + ".join(f"len({_found_sql(k)})" for k in ([kind, "IP_ADDRESS v6"] if kind == "IP_ADDRESS" else [kind]))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS type, CAST(sum({_lengths_sql(k)}) AS BIGINT) AS n FROM {_TEXTS_SQL}" for k in entities.TYPES) + ")")
def entity_counts_by_type(spark, sf_dir):
    each = _texts(spark, sf_dir).select(F.explode(entities.counts(F.col("t"))).alias("type", "n"))
    return each.groupBy("type").agg(F.sum("n").cast("bigint").alias("n"))


@query()
def entity_full(spark, sf_dir):
    """All entities with offsets (Python's regular expressions, so no SQL)."""
    rows = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(entities.extract_entities(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.*")


_GROUPED = ("EMAIL", "URL", "HASHTAG", "ENGLISH_NAME")


@query(" UNION ALL ".join(f"SELECT id, '{k}' AS type, array_to_string(list_sort(list_distinct(v)), ',') AS vals, CAST(len(list_distinct(v)) AS BIGINT) AS n FROM (SELECT id, flatten(list(v)) AS v FROM (SELECT id, {_found_sql(k)} AS v FROM {_TEXTS_SQL}) GROUP BY id) WHERE len(v) > 0" for k in _GROUPED))
def entity_groups(spark, sf_dir):
    def typed(kind):
        return F.transform(entities.values(F.col("t"), kind), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    found = F.explode(F.concat(*map(typed, _GROUPED)))
    rows = _texts(spark, sf_dir).select("id", found.alias("e")).select("id", "e.*")
    return grouped_entities(rows, "id").withColumn("vals", F.array_join("vals", ","))


@query("""
SELECT doc_id, CAST(p AS INTEGER) AS char_offset, CAST(strlen(left(text, p)) AS INTEGER) AS byte_offset, substr(text, greatest(p - 120, 0) + 1, p + 3 + 120 - greatest(p - 120, 0)) AS snippet
FROM (SELECT doc_id, text, strpos(text, 'the') - 1 AS p FROM documents) WHERE p >= 0""")
def snippet_context(spark, sf_dir):
    """The surroundings of each text's first match, from its byte offset."""
    first = table(spark, sf_dir, "documents").withColumn("byte_offset", F.get(match.find_all(F.col("text"), "the"), F.lit(0))).filter("byte_offset IS NOT NULL")
    at = first.withColumn("char_offset", tx.char_offset(F.col("text"), F.col("byte_offset")))
    return at.select("doc_id", "char_offset", F.col("byte_offset").cast("int").alias("byte_offset"), tx.snippet(F.col("text"), F.col("char_offset"), 3).alias("snippet"))


@query("""
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 'the', '<mark class="match-highlight">the</mark>')) AS html FROM documents""")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.highlight(F.col("text"), "the").cast("binary")).alias("html"))


@query("""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))) AS patterns, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')) AS INTEGER) AS n FROM documents""")
def parse_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.parse_patterns(F.col("text")).alias("p"))
    return rows.select("doc_id", F.md5(F.array_join("p", "\n").cast("binary")).alias("patterns"), F.size("p").alias("n"))


@query("SELECT page_id, lower(coalesce(regexp_extract(url, '(\\.[^./\\\\]+)$', 1), '')) AS suffix, string_split(url, '/')[-1] AS basename FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.suffix(F.col("url")).alias("suffix"), tx.basename(F.col("url")).alias("basename"))
