"""Queries of the exact and approximate search operators over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphspark.functions import match
from glyphspark.operators import search
from glyphspark.plans.registering import collector
from glyphspark.plans.views import spread_out, table

QUERIES, ORACLES, query = collector()

#: No proper prefix of these is also a suffix, so non-overlapping SQL splitting finds the same matches.
WORD, WORDS = "the", ["the", "and", "tion", "que"]


def _positions_sql(source: str, key: str, word: str) -> str:
    """Byte offsets by splitting: the k-th match starts after the first k pieces and k - 1 words."""
    size = len(word.encode())
    return f"""
SELECT {key}, CAST(before + (ix - 1) * {size} AS BIGINT) AS pos FROM (
  SELECT {key}, ix, n, sum(strlen(piece)) OVER (PARTITION BY {key} ORDER BY ix) AS before
  FROM (SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS ix, len(p) AS n FROM (SELECT {key}, string_split(text, '{word}') AS p FROM {source})))
WHERE ix < n"""


def _count(word: str) -> str:
    return f"CAST(len(string_split(text, '{word}')) - 1 AS BIGINT)"


@query(_positions_sql("documents", "doc_id", WORD))
def search_exact(spark, sf_dir):
    return search.positions(table(spark, sf_dir, "documents"), WORD, "doc_id")


@query(f"SELECT doc_id, {_count(WORD)} AS hits FROM documents")
def search_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", match.count_all(F.col("text"), WORD).alias("hits"))


@query(f"SELECT doc_id, {_count(WORD)} AS hits FROM documents ORDER BY hits DESC, doc_id LIMIT 20")
def search_top(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", match.count_all(F.col("text"), WORD).alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(20)


@query(f"SELECT doc_id, hits AS match_count, hits AS total_count, FALSE AS truncated, CAST({len(WORD)} AS INTEGER) AS pattern_len, 'KMP' AS algorithm FROM (SELECT doc_id, {_count(WORD)} AS hits FROM documents)")
def search_auto(spark, sf_dir):
    found = search.search(table(spark, sf_dir, "documents"), WORD)
    return found.select("doc_id", "match_count", "total_count", "truncated", "pattern_len", "algorithm")


@query(f"SELECT doc_id, least(hits, 10) AS match_count, hits AS total_count, hits > 10 AS truncated FROM (SELECT doc_id, {_count(WORD)} AS hits FROM documents)")
def search_capped(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), WORD, algorithm="Boyer-Moore", cap=10).select("doc_id", "match_count", "total_count", "truncated")


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{w}' AS pattern, {_count(w)} AS match_count FROM conversations" for w in WORDS))
def search_multi(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    found = search.search_multi(rows, WORDS, "key")
    return found.select("key.conv_id", "key.turn", "pattern", "match_count")


@query(" UNION ALL ".join(f"SELECT pattern_id, doc_id, pos FROM (SELECT {k} AS pattern_id, * FROM ({_positions_sql('documents', 'doc_id', w)}))" for k, w in enumerate(WORDS)))
def search_multi_positions(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(match.find_many(F.col("text"), WORDS)).alias("h"))
    return hits.select("h.pattern_id", "doc_id", "h.pos")


@query(" UNION ALL ".join(f"SELECT '{w}' AS pattern, sum({_count(w)}) AS total FROM documents" for w in WORDS))
def search_multi_total(spark, sf_dir):
    found = search.search_multi(table(spark, sf_dir, "documents"), WORDS, "doc_id")
    return found.groupBy("pattern").agg(F.sum("match_count").alias("total"))


#: More patterns than are searched one by one; none has a prefix that is also its suffix.
MANY = [*WORDS, "for", "with", "der", "die", "und", "les", "des", "dans", "los", "por", "con", "ing", "ment", "ver", "sch", "ung", "oul", "ous", "est", "her", "ation", "ight", "able", "por el", "ñ", "ß"]


@query(" UNION ALL ".join(f"SELECT doc_id, '{w}' AS pattern, {_count(w)} AS match_count FROM documents" for w in MANY))
def search_many(spark, sf_dir):
    """Many patterns by one automaton pass."""
    return search.search_multi(table(spark, sf_dir, "documents"), MANY, "doc_id").select("doc_id", "pattern", "match_count")


@query(f"SELECT doc_id, least(hits, 3) AS match_count, least(hits, 4) AS total_count, hits > 3 AS truncated FROM (SELECT doc_id, {_count(WORD)} AS hits FROM documents)")
def search_stopped(spark, sf_dir):
    """Texts are left at their fourth match."""
    return search.search(table(spark, sf_dir, "documents"), WORD, algorithm="KMP", cap=3, stop=True).select("doc_id", "match_count", "total_count", "truncated")


@query(" UNION ALL ".join(f"SELECT doc_id, '{name}' AS algorithm, {_count(WORD)} AS match_count, {'TRUE' if name == 'KMP' else 'FALSE'} AS auto_selected, length(text) AS text_length FROM documents" for name in (*match.EXACT, match.MULTI)))
def search_compare(spark, sf_dir):
    """The exact algorithms; durations and the fastest differ from run to run."""
    rows = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search.compare(rows, WORD, "doc_id", with_fuzzy=False).select("doc_id", "algorithm", "match_count", "auto_selected", "text_length")


@query(_positions_sql("documents", "doc_id", WORD))
def search_chunked(spark, sf_dir):
    return search.search_chunked(table(spark, sf_dir, "documents"), WORD, "doc_id", chunk_bytes=1000)


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS index, CAST(i * 1000 AS BIGINT) AS start, CAST(least(1000, n - i * 1000) AS INTEGER) AS owned
FROM (SELECT doc_id, strlen(text) AS n, unnest(range(0, CAST(ceil(strlen(text) / 1000.0) AS BIGINT))) AS i FROM documents)""")
def chunk_layout(spark, sf_dir):
    return search.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 2, 1000).select("doc_id", "index", "start", "owned")


@query()
def search_enriched(spark, sf_dir):
    """Snippets and entities around the first matches; offsets of entities need Python, so there is no SQL."""
    found = search.search(spread_out(table(spark, sf_dir, "documents").select("doc_id", "text")), "@", enriched=True)
    return found.select("doc_id", F.explode("enriched").alias("e")).select("doc_id", "e.byte_offset", "e.char_offset", "e.snippet", F.to_json("e.entities").alias("entities"))


@query()
def fuzzy_compat(spark, sf_dir):
    """The engine's own approximate matching; bit vectors have no SQL form."""
    found = search.search(spread_out(table(spark, sf_dir, "documents").select("doc_id", "text")), "there", fuzzy=True)
    return found.select("doc_id", "match_count", F.array_join(F.transform("matches", lambda p: p.cast("string")), ",").alias("ends"))


#: The bytes of each text as characters (one that no pattern holds for those beyond ASCII), with the five before each.
_BYTES = """
WITH b AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents)),
c AS (SELECT doc_id, i, CASE WHEN x < '80' THEN chr(CAST('0x' || x AS INTEGER)) ELSE '*' END AS c FROM b),
w AS (SELECT doc_id, lag(c, 3) OVER o || lag(c, 2) OVER o || lag(c, 1) OVER o || c AS s4, lag(c, 4) OVER o AS c5, lag(c, 5) OVER o AS c6 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS ({count})
SELECT doc_id, CAST(coalesce(hits, 0) AS INTEGER) AS hits FROM documents LEFT JOIN n USING (doc_id)"""
_NEAR = " OR ".join(f"coalesce(levenshtein({s}, 'there') <= 1, FALSE)" for s in ("s4", "c5 || s4", "c6 || c5 || s4"))


@query(_BYTES.format(count=f"SELECT doc_id, count(*) AS hits FROM w WHERE {_NEAR} GROUP BY doc_id"))
def fuzzy_edit(spark, sf_dir):
    rows = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size(match.find_fuzzy(F.col("text"), "there", 1, "edit")).alias("hits"))


@query(_BYTES.format(count="SELECT doc_id, count(*) AS hits FROM w WHERE CASE WHEN length(c5 || s4) = 5 THEN hamming(c5 || s4, 'there') <= 1 ELSE FALSE END GROUP BY doc_id"))
def fuzzy_hamming(spark, sf_dir):
    rows = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size(match.find_fuzzy(F.col("text"), "there", 1, "hamming")).alias("hits"))


@query("""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: levenshtein(w, 'there') <= 1), ',') AS words FROM documents""")
def fuzzy_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(match.similar_words(F.col("text"), "there"), ",").alias("words"))


@query(f"WITH cur AS ({_positions_sql('documents', 'doc_id', WORD)}), prev AS ({_positions_sql('documents', 'doc_id', 'then')}) SELECT doc_id, pos FROM cur ANTI JOIN prev USING (doc_id, pos)")
def monitor_new_matches(spark, sf_dir):
    """What a watch reports when its pattern is shortened: matches whose offsets were not known before."""
    rows = table(spark, sf_dir, "documents")
    return search.new_matches(search.positions(rows, WORD, "doc_id"), search.positions(rows, "then", "doc_id"), ["doc_id", "pos"])


@query(f"SELECT page_id, {_count('the').replace('text', 'html')} AS hits FROM pages WHERE lower(coalesce(nullif(regexp_extract(url, '(\\.[^./\\\\]+)$', 1), ''), '')) IN ('.html', '.txt', '.xml')")
def search_by_suffix(spark, sf_dir):
    """Only pages whose URL ends in an accepted extension."""
    from glyphspark.functions.text import suffix

    pages = table(spark, sf_dir, "pages").filter(suffix(F.col("url")).isin(".html", ".txt", ".xml"))
    return pages.select("page_id", match.count_all(F.col("html"), "the").alias("hits"))
