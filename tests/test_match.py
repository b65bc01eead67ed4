import random

import pytest
from pyspark.sql import functions as F

from glyphspark.functions import match
from glyphspark.operators import search

SENTENCE = "the cat sat on the mat and the cat ate"


def column(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")


def naive(text, pattern):
    t, p = text.encode(), pattern.encode()
    return [i for i in range(len(t) - len(p) + 1) if p and t[i : i + len(p)] == p]


def test_exact_goldens(spark):
    rows = column(spark, ["The cat sat on the mat.  A cat ate the rat!", "שלום עולם שלום", "aaaa", "", None])
    got = rows.select(match.find_all(F.col("text"), "cat").alias("cat"), match.find_all(F.col("text"), "שלום").alias("he"), match.find_all(F.col("text"), "aa").alias("aa"), match.find_all(F.col("text"), "").alias("none")).collect()
    assert got[0]["cat"] == [4, 27]
    assert got[1]["he"] == [0, len("שלום עולם ".encode())]
    assert got[2]["aa"] == [0, 1, 2]
    assert [r["none"] for r in got] == [[], [], [], [], None]
    assert got[4]["cat"] is None


def test_implementations_agree(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abש.") for _ in range(rng.randrange(13))) for _ in range(400)]
    for pattern in ("a", "aa", "aba", "ש", "שא", ".", "abab", "\\E", "a."):
        got = column(spark, texts).select("text", match.find_all(F.col("text"), pattern).alias("x"), match.find_all_native(F.col("text"), pattern).alias("y"), match.count_all(F.col("text"), pattern).alias("n")).collect()
        for r in got:
            assert r["x"] == r["y"] == naive(r["text"], pattern), (r, pattern)
            assert r["n"] == len(r["x"])


def test_quoted_patterns(spark):
    got = column(spark, ["a\\Eb\\Q\\E"]).select(match.count_all(F.col("text"), "\\E").alias("n"), match.find_all(F.col("text"), "\\E").alias("x")).first()
    assert got["n"] == 2 and len(got["x"]) == 2


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 100])
def test_chunked_equals_whole(spark, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(5)]
    rows = column(spark, texts)
    got = search.search_chunked(rows, "aba", "id", chunk_bytes=chunk).collect()
    assert sorted((r["id"], r["pos"]) for r in got) == [(k, p) for k, t in enumerate(texts) for p in naive(t, "aba")]


def test_needles_in_a_large_text(spark):
    places = [0, 1_000_000, 3_000_000, 5_000_000]
    data = bytearray(b"x" * 6_000_000)
    for p in places:
        data[p : p + 6] = b"NEEDLE"
    got = search.search_chunked(column(spark, [data.decode()]), "NEEDLE", "id", chunk_bytes=2_000_000)
    assert sorted(r["pos"] for r in got.collect()) == places


def test_multi(spark):
    found = search.search_multi(column(spark, [SENTENCE]), ["cat", "rat", "mat", "cat", ""], "id").collect()
    assert {r["pattern"]: r["match_count"] for r in found} == {"cat": 2, "rat": 0, "mat": 1}
    many = ["cat", "at", "a", *[f"zz{k}" for k in range(40)]]
    one_pass = search.search_multi(column(spark, [SENTENCE]), many, "id").collect()
    assert all(r["matches"] == naive(SENTENCE, r["pattern"]) for r in one_pass)
    with pytest.raises(ValueError):
        search.search_multi(column(spark, ["x"]), [str(k) for k in range(60)], "id", max_patterns=50)


def test_search_result(spark):
    rows = column(spark, [SENTENCE * 1000, None, "no"])
    got = search.search(rows, "cat", cap=10).orderBy("id").collect()
    assert (got[0]["match_count"], got[0]["total_count"], got[0]["truncated"], got[0]["algorithm"]) == (10, 2000, True, "KMP")
    assert got[1]["total_count"] == 0 and not got[2]["truncated"]
    with pytest.raises(ValueError):
        search.search(rows, "cat", algorithm="nonsense")
    assert search.search(rows, "cat", algorithm="nonsense", lenient=True).first()["algorithm"] == "nonsense"


def test_compare(spark):
    rows = column(spark, ["the quick brown fox jumps over the lazy dog. " * 10_000])
    got = {r["algorithm"]: r for r in search.compare(rows, "fox", "id").collect()}
    assert len(got) == 6
    assert all(got[a]["match_count"] == 10_000 for a in match.EXACT)
    assert [a for a in got if got[a]["auto_selected"]] == ["KMP"]
    assert sum(r["fastest"] for r in got.values()) == 1 and all(r["duration_ms"] > 0 for r in got.values())
    assert min(got.values(), key=lambda r: r["duration_ms"])["duration_ms"] == next(r["duration_ms"] for r in got.values() if r["fastest"])
    assert {r["text_length"] for r in got.values()} == {450_000}
    assert len(search.compare(rows, "fox", "id", with_fuzzy=False).collect()) == 5
    with pytest.raises(Exception, match="at most 1000 bytes"):
        search.compare(rows, "fox", "id", max_bytes=1000).collect()


def test_a_text_is_left_beyond_the_cap(spark):
    rows = column(spark, ["aaaaaa", "aa", "", None])
    got = search.search(rows, "a", cap=2, stop=True).orderBy("id").collect()
    assert [(r["matches"], r["total_count"], r["truncated"]) for r in got[:3]] == [([0, 1], 3, True), ([0, 1], 2, False), ([], 0, False)]
    whole = search.search(rows, "a", cap=2).orderBy("id").first()
    assert (whole["matches"], whole["total_count"], whole["truncated"]) == ([0, 1], 6, True)
    assert search.search(rows, "a", fuzzy=True, max_errors=99).first()["algorithm"] == "FUZZY(k=5)"


def test_fuzzy_compat_goldens():
    text = b"The cat sat on the mat.    A cat ate the rat!"
    assert match.compat_ends(b"bat", b"cat", 1) == []
    assert match.compat_ends(b"ct", b"cat", 1) == []
    assert match.compat_ends(b"catt", b"cat", 1) == [2, 3]
    assert match.compat_ends(text, b"cat", 0) == [p + 2 for p in naive(text.decode(), "cat")]
    assert set(match.compat_ends(text, b"cot", 1)) >= {p + 2 for p in naive(text.decode(), "cat")}


def slow_compat(text, pattern, k):
    """Every byte from the definition, without the jump over empty states."""
    reach, out = [0] * (k + 1), []
    for i, c in enumerate(text):
        fits = sum(1 << j for j, b in enumerate(pattern) if b == c)
        below = None
        for e in range(k + 1):
            was = reach[e]
            taken = 1 if e == 0 else below
            reach[e] = ((was << 1) | taken) & fits
            if e:
                reach[e] |= taken << 1
            reach[e] &= (1 << 64) - 1
            below = was
            if reach[e] >> (len(pattern) - 1) & 1:
                out.append(i)
                break
    return out


def sellers(text, pattern, k):
    column, out = list(range(len(pattern) + 1)), []
    for i, c in enumerate(text):
        last, column[0] = column[:], 0
        for j, b in enumerate(pattern, 1):
            column[j] = min(last[j - 1] + (b != c), last[j] + 1, column[j - 1] + 1)
        if column[-1] <= k:
            out.append(i)
    return out


def test_fuzzy_modes_against_definitions():
    rng = random.Random(3)
    for _ in range(1500):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 24)))
        pattern = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
        k = rng.randrange(3)
        assert match.compat_ends(text, pattern, k) == slow_compat(text, pattern, k)
        assert match.edit_ends(text, pattern, k) == sellers(text, pattern, k)
        assert match.hamming_starts(text, pattern, k) == [i for i in range(len(text) - len(pattern) + 1) if sum(a != b for a, b in zip(text[i:], pattern, strict=False)) <= k]


def test_fuzzy_columns(spark):
    rows = column(spark, ["catt", "", None])
    got = rows.select(match.find_fuzzy(F.col("text"), "cat", 1).alias("x"), match.find_fuzzy(F.col("text"), "z" * 70, 1).alias("y")).collect()
    assert [r["x"] for r in got] == [[2, 3], [], None] and [r["y"] for r in got] == [[], [], None]
    with pytest.raises(ValueError):
        match.find_fuzzy(F.col("text"), "x", 1, "other")
    found = search.search(rows, "cat", fuzzy=True)
    assert found.first()["algorithm"] == "FUZZY(k=1)" and "algorithm_note" not in found.columns


def test_new_matches(spark):
    now, before = spark.createDataFrame([(1, 5), (1, 9)], "d int, pos int"), spark.createDataFrame([(1, 5), (2, 9)], "d int, pos int")
    assert [tuple(r) for r in search.new_matches(now, before, ["d", "pos"]).collect()] == [(1, 9)]
