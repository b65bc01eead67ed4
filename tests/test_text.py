from datetime import datetime

from pyspark.sql import functions as F

from glyphspark.functions import entities, profile
from glyphspark.functions import text as tx

MIXED = "On 2024-05-01 at 14:30 mail john.doe@example.com or call +972-52-123-4567; host 192.168.0.1, https://example.com/x #spark @team John Smith id 123456782"


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_profile():
    p = profile.profile_of(b"a" * 1000)
    assert p["entropy"] == 0 and p["is_monotone"] and not p["is_natural"] and p["unique_bytes"] == 1
    p = profile.profile_of(bytes(range(256)) * 4)
    assert p["entropy"] == 8 and p["is_natural"] and p["has_non_ascii"]
    assert profile.profile_of(b"")["is_monotone"]


def test_profile_reads_the_sample_only(spark):
    text = "a" * profile.SAMPLE_BYTES + "bcdef"
    assert one(spark, profile.profile_text(F.col("t")), t=text)["length"] == profile.SAMPLE_BYTES


def choose(spark, pattern, text):
    return one(spark, profile.select_algorithm(F.col("p"), profile.profile_text(F.col("t"))["is_monotone"]), p=pattern, t=text)


def test_selector(spark):
    varied = "".join(map(chr, range(32, 127))) * 20
    assert choose(spark, "hello", varied) == "Shift-Or"
    assert choose(spark, "שלום", varied) == "KMP"
    assert choose(spark, "abcd", "a" * 100_000) == "KMP"
    assert choose(spark, "abcde", "a" * 100_000) == "KMP"
    assert choose(spark, "x" * 65, varied) == "Boyer-Moore"
    assert choose(spark, "", varied) == "KMP"
    assert one(spark, profile.select_algorithm(F.col("p"), multi=True), p="a") == "Aho-Corasick"


def test_explanation(spark):
    why = profile.explain_selection(F.lit("Shift-Or"), F.col("p"), profile.profile_text(F.col("t")), F.octet_length("t"))
    assert one(spark, why, p="hello", t="aab") == "ASCII pattern ≤64B (5B) → bit-parallel Shift-Or; text profile: len=3B entropy=0.92b unique_bytes=2 non_ascii=False"
    assert one(spark, profile.explain_selection(F.lit("KMP"), F.col("p")), p="ab").startswith("very short pattern (2B)")


def test_explanation_rounds_entropy_half_to_even(spark):
    why = profile.explain_selection(F.lit("KMP"), F.col("p"), profile.profile_text(F.col("t")), F.octet_length("t"))
    for text, exact, shown in (("aaaabbccddefghij", 3.125, "3.12"), ("aaaaaaaabbccddef", 2.125, "2.12"), ("aaaaaaaabbbbccde", 1.875, "1.88"), ("a" * 10, 0.0, "0.00")):
        assert profile.profile_of(text.encode())["entropy"] == exact
        got = one(spark, why, p="abcde", t=text)
        assert got.startswith(f"monotone text (entropy={shown}b)") and f"B entropy={shown}b unique" in got


def test_entities():
    found = entities.entities_of(MIXED)
    assert {e["type"] for e in found} >= {"DATE", "TIME", "EMAIL", "PHONE", "IP_ADDRESS", "URL", "HASHTAG", "MENTION", "ENGLISH_NAME", "ISRAELI_ID"}
    assert all(MIXED[e["start"] : e["end"]] == e["value"] for e in found)
    assert [e["start"] for e in found] == sorted(e["start"] for e in found)
    assert [e["value"] for e in entities.entities_of("דן כהן ו-123456782, 012345678")] == ["דן", "כהן", "123456782"]
    assert [e["value"] for e in entities.entities_of("1 May 2024, 3 במאי 2024 fe80:0:0:1") if e["type"] == "DATE"] == ["1 May 2024", "3 במאי 2024"]


def test_jvm_values_equal_python(spark):
    texts = [MIXED, "דן כהן 01.05.2024 Anna,Lee (Bob) x@y.co", "#tag a#b @m a@b 1:2:3:4", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind in [*entities.PATTERNS, *entities.NAME_TOKENS]:
        got = [r["v"] for r in rows.select(entities.values(F.col("text"), kind).alias("v")).collect()]
        name = kind.split()[0]
        for text, values in zip(texts, got, strict=True):
            want = [e["value"] for e in entities.entities_of(text) if e["type"] == name]
            if name == "IP_ADDRESS":
                want = [v for v in want if (":" in v) == kind.endswith("v6")]
            assert values == want, kind
    totals = rows.select(entities.counts(F.col("text")).alias("c")).first()["c"]
    assert totals["EMAIL"] == 1 and set(totals) == set(entities.TYPES)


def test_enrichment(spark):
    text = "é" * 150 + " John mat " + "x" * 300
    at = len(text[:156].encode())
    got = one(spark, entities.enrich(F.col("t"), F.array(F.lit(at).cast("bigint")), 3), t=text)[0]
    assert got["char_offset"] == 156 and got["snippet"] == text[36 : 156 + 3 + 120]
    assert [(e["value"], text[e["start"] : e["end"]]) for e in got["entities"]] == [("John", "John")]


def test_offsets_and_snippets(spark):
    assert one(spark, tx.char_offset(F.col("t"), F.lit(4)), t="שלום") == 2
    assert one(spark, tx.char_offset(F.col("t"), F.lit(3)), t="שלום") == 2
    assert one(spark, tx.snippet(F.col("t"), F.lit(2), 1, 1), t="abcdef") == "bcd"


def test_highlight(spark):
    assert one(spark, tx.highlight(F.col("t"), "a"), t="<a>&") == '&lt;<mark class="match-highlight">a</mark>&gt;&amp;'
    assert one(spark, tx.highlight(F.col("t"), ""), t='"') == "&quot;"


def test_formats(spark):
    assert one(spark, tx.format_duration(F.col("v")), v=0.5) == "500 µs"
    assert one(spark, tx.format_duration(F.col("v")), v=12.345) == "12.35 ms"
    assert one(spark, tx.format_duration(F.col("v")), v=2500.0) == "2.50 s"
    assert one(spark, tx.format_duration(F.col("v").cast("double")), v=None) == "—"
    now = F.lit(datetime(2024, 1, 2))
    for then, shown in ((datetime(2024, 1, 1, 23, 59, 30), "30s ago"), (datetime(2024, 1, 1, 23, 50), "10m ago"), (datetime(2024, 1, 1, 3), "21h ago"), (datetime(2023, 12, 30), "2023-12-30")):
        assert one(spark, tx.relative_time(F.lit(then), now), v=1.0) == shown
    assert one(spark, tx.parse_patterns(F.col("t")), t=" a \n\nb") == ["a", "b"]
    assert one(spark, tx.suffix(F.col("t")), t="/x/photo.EXE") == ".exe"


def test_validators(spark):
    assert one(spark, tx.valid_email(F.col("t")), t=" a.b@c.de ") and not one(spark, tx.valid_email(F.col("t")), t="a@b")
    assert one(spark, tx.password_problem(F.col("t")), t="Passw0rd") == "" and "digit" in one(spark, tx.password_problem(F.col("t")), t="Password")
    assert one(spark, tx.username_problem(F.col("t")), t="ab") == "too_short" and one(spark, tx.username_problem(F.col("t")), t="a b c") == "characters" and one(spark, tx.username_problem(F.col("t")), t="a_b") == ""
