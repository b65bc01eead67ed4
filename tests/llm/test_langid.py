"""Language ID: many alphabets, long texts, small samples, and the parse against its definition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphspark.llm import langid


def alphabet(first, n):
    return [c for c in map(chr, range(first, first + 4 * n)) if c.isalpha() and c == c.lower()][:n]


def words(rng, letters, n):
    """Words of a language: its letters are used unevenly and in habitual pairs."""
    return " ".join("".join(rng.choice(letters[: 2 + len(letters) // (1 + k)]) for k in range(rng.randrange(2, 7))) for _ in range(n))


def cost(text, sample):
    flat, inside = re.sub(r"[^a-z]+", " ", text), re.sub(r"[^a-z]+", " ", sample)
    phrases, current = 1, ""
    for c in flat:
        if current + c in inside:
            current += c
        else:
            phrases, current = phrases + 1, c if c in inside else ""
    return phrases


@pytest.mark.parametrize("dense", [0, 10**7])
@pytest.mark.parametrize("lane", [3, 16, 4096])
def test_whole_texts_are_parsed_as_defined(monkeypatch, lane, dense):
    """Lanes leave no trace: texts past many borders, texts that repeat a period, and pieces of the samples themselves."""
    monkeypatch.setattr(langid, "LANE", lane)
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(lane)
    samples = [(c, "".join(rng.choice("abcd " if c == "x" else "abde ") for _ in range(400)).strip()) for c in "xy"]
    parser = langid.Parser(samples)
    texts = ["".join(rng.choice("abcdez ") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts += ["ab" * 200, samples[0][1] * 3, samples[1][1], "z" * 90, "a", samples[0][1][7:300] + "z" + samples[1][1]]
    got = parser.phrases([parser.encode(t) for t in texts])
    assert got.T.tolist() == [[cost(t, sample) for _, sample in samples] for t in texts]


def test_small_alphabets_beside_large_ones(spark):
    """Four languages of 300 letters with full samples do not crowd out four alphabetic ones with small samples."""
    rng = random.Random(1)
    letters = {f"big{k}": alphabet(0x4E00 + 2000 * k, 300) for k in range(4)} | {"el": alphabet(0x3B1, 24), "ru": alphabet(0x430, 32), "he": alphabet(0x5D0, 27), "dsrt": alphabet(0x10428, 40)}
    rows = [(len(letters) * k + j, words(rng, own, 60), name) for j, (name, own) in enumerate(letters.items()) for k in range(40 if name.startswith("big") else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.samples(docs)
    assert {name for name, _ in learned} == set(letters)
    parser = langid.Parser(learned)
    asked = [(name, words(rng, own, 8)) for name, own in letters.items() for _ in range(25)]
    found = [name for name, _ in parser.predict([t for _, t in asked])]
    assert sum(a == b for a, (b, _) in zip(found, asked, strict=True)) >= 0.98 * len(asked)


def test_no_language_is_lost(spark, monkeypatch):
    """Languages whose texts are all longer than the sample, and more languages than the sum of the samples allows."""
    rng = random.Random(2)
    long = spark.createDataFrame([(k, words(rng, alphabet(97 if k % 2 else 0x430, 20), 20_000), "xy"[k % 2]) for k in range(6)], "doc_id long, text string, lang string")
    learned = langid.samples(long)
    assert [name for name, _ in learned] == ["x", "y"] and all(langid.LEAST_CHARS <= len(t) <= langid.SAMPLE_CHARS + langid.SAMPLE_DOCS for _, t in learned)
    monkeypatch.setattr(langid, "TOTAL_CHARS", 3000)
    many = spark.createDataFrame([(k, words(rng, "abcdefghij", 30), f"l{k % 40}") for k in range(400)], "doc_id long, text string, lang string")
    assert len(langid.samples(many)) == 40


def test_repeated_rows_and_types_of_ids(spark):
    docs = spark.createDataFrame([(f"d{k}", "some words of a language" if k % 2 else "иные слова языка", "a" if k % 2 else "b") for k in range(40)], "doc_id string, text string, lang string")
    learned = langid.samples(docs.unionByName(docs))
    got = langid.langid(docs.unionByName(docs), learned).collect()
    assert len(got) == 80 and {(r["id"], r["lang_pred"]) for r in got} == {(f"d{k}", "a" if k % 2 else "b") for k in range(40)}
    assert langid.langid(docs.withColumn("score", F.lit("x")).limit(0), learned).schema["id"].dataType.simpleString() == "string"
