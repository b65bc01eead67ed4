"""Each stage of the pipeline against a brute-force version on its own input."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import exact_brute, near_roots
from tests.llm.test_text_ops import contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}))
        docs = after
    return out


def test_columns_and_texts(spark, steps):
    for docs, after, before_rows, after_rows in steps[:-1]:
        assert docs.schema.simpleString() == after.schema.simpleString()
        assert all(before_rows[i] == r for i, r in after_rows.items())
        assert after.count() == len(after_rows)


def test_quality_keeps_clean_documents(spark, steps):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    _, _, before, after = steps[0]
    assert all(i in after for i in before if labels.get(i) == (1, 0))
    assert not any(i in after for i in before if labels.get(i, (1, 0))[0] == 0)


def test_exact_dedup(steps):
    _, _, before, after = steps[1]
    assert set(after) == {keep for keep, _, _ in exact_brute([(i, r["text"]) for i, r in before.items()]).values()}


def test_near_dedup(steps):
    """One of each component by brute force stays; whoever goes is similar to a document that was there before, and no similar pair stays."""
    _, _, before, after = steps[2]
    ids = sorted(before)
    assert set(after) == {ids[k] for k in near_roots([before[i]["text"] for i in ids])}
    words = {i: before[i]["text"].lower().split() for i in ids}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    for i in set(before) - set(after):
        assert any(j != i and alike(i, j) >= 0.6 for j in ids)
    left = [(i, j) for i in after for j in ids if j < i and len(words[i]) >= 60 and alike(i, j) >= 0.85]
    assert not left


def test_decontamination(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _, _, before, after = steps[3]
    hits = contamination([(i, r["text"]) for i, r in before.items()], items)
    assert set(after) == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}


def test_mixing(steps):
    _, _, before, after = steps[4]
    taken, target = {}, {}
    for i, r in after.items():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", before[i]["text"]))
        assert r["text"] == before[i]["text"] and 0 < r["mix_taken"] <= 3 * size == 3 * r["mix_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_taken"]
        target[r["source"]] = r["mix_target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_run_equals_the_stages(spark, steps):
    whole = {r["doc_id"]: r["mix_taken"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: r["mix_taken"] for i, r in steps[4][3].items()}


def test_odd_documents(spark):
    """Nulls, empty and blank texts, repeated rows and extra columns with clashing names through every stage."""
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, " \n", "en", "s", 2, "x"), (4, "some words here", "en", "s", 15, "x"), (4, "some words here", "en", "s", 15, "x"), (None, "other words there", None, "t", 17, "x"), (5, "long words " * 20_000, "en", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken string").withColumn("kept", F.lit("k")).withColumn("id", F.lit("i"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.exact_dedup_stage(spark, docs, SF).count() == 4
    assert corpus_pipeline.near_dedup_stage(spark, docs, SF).filter("doc_id = 4").count() == 1
    assert corpus_pipeline.mixing_stage(spark, docs, SF).filter("mix_taken <= 0").count() == 0


def test_near_dedup_of_null_and_repeated_ids(spark):
    """Different texts stay, whether their ids are null or equal; of near copies with null ids one stays."""
    texts = [" ".join(f"{word}{k * k}" for k in range(80)) for word in ("a", "b", "c", "d", "e")]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (None, texts[4].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()
    assert sorted(r["text"].lower() for r in kept) == sorted(texts)
