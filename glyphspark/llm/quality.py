"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

Document evidence. Two classifiers are fitted on a bounded sample of labelled rows (SAMPLE_ROWS, the smallest hashes of
their ids; equal and nearly equal texts count once, else the invented words of one copied text would look toxic):
* toxic words: each word's rate of toxic documents, shrunk by a Beta prior at the global rate; a word is kept when its
  rate is well above one half and too high to be chance among all words tested. A document's evidence is that of its STRONGEST (three) strongest words
  (noisy or), so length alone never adds up to a rejection.
* low quality: logistic regression on shape figures (capitals, symbols, bars, repeated words, distinct words, ...).
p = 1 - (1 - p_toxic) * (1 - p_low) is the probability that a document is bad.

Sites. Over all documents, grouped sums of p per host and per path give posteriors: a Beta prior for hosts is fitted to the
spread between hosts by moments, a host's rate shrinks to it; a path's rate shrinks to its host's with a strength
fitted to the spread between paths. Sparse sites thus keep the global prior. The log-odds shift of the path against the
global rate, at most `site_shift` either way (infinity: unbounded), is added to the document's log-odds; above one half a document is rejected.

Scale: texts are scored in place and only (id, host, path, p) is written; site tables are grouped sums, pre-aggregated per
task, and meet the narrow scores by (site, salt), sites of many documents being dealt over many salts.

Hosts and paths are columns of the caller's choice. `of_pages` takes them from URLs. A documents table has no URLs; there (`documents_quality`)
the source stands for the host, and the language, the only other grouping the table has, for a section of it: it is not a path.

Edge cases: null and empty texts have no evidence, p is the global rate (they are kept unless most documents are bad); a null host or path is a site of
its own; without labels both classifiers are silent; repeated rows are scored alike; an empty table gives an empty result;
a very long text
is scored whole by one task; ids keep their type; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspark.llm.common import add_salt, hot_keys, materialise, null_safe, spread, type_of

#: Labelled rows that the document classifiers are fitted on at most.
SAMPLE_ROWS = 6000
#: Documents of the sample that must hold a word before it counts.
WORD_SUPPORT = 4
#: Largest log-odds shift by which a site may move a document: without a bound, clean documents of bad sites go (see README).
SITE_SHIFT = 1.0
#: Toxic words of a document that count as evidence.
STRONGEST = 3
#: Shingle hashes that describe a sampled text, and how many shared ones make two texts near copies.
SKETCH, SKETCH_SHARED = 24, 8
STEP = 64
SHAPES = 10
#: Byte classes for the shape figures: 1 upper case, 2 other letters, 3 digits, 4 white space, 5 common punctuation, 6 bar, 7 other symbols.
CLASS = np.array([1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c > 127 else 3 if 48 <= c <= 57 else 4 if c in b" \t\n\x0b\x0c\r" else 5 if c in b".,;:'\"()-?" else 6 if c == 124 else 7 for c in range(256)], np.uint8)
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """SHAPES figures of a text's form, each of about unit size."""
    counts = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    letters, n = max(1, counts[1] + counts[2]), max(1, len(words))
    tokens = text.split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    distinct = len(set(words)) / n ** 0.8
    return [counts[1] / letters, counts[7] / letters, counts[6] / n, same, min(distinct, 2.0), counts[3] / letters, counts[5] / n, min(3.0, letters / n / 6), max(Counter(words).values(), default=0) / n, min(3.0, len(tokens) / n)]


def chance(b: int, n: int, rate: float) -> float:
    """Chance of b or more toxic documents among n at the global rate."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)) for k in range(b, n + 1))


def sketch_of(words: list[bytes]) -> list[int]:
    """The SKETCH least hashes of a text's three-word shingles."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    each = np.concatenate([each, np.zeros(2, np.uint64)])
    h = each[:-2] * np.uint64(0x9E3779B97F4A7C15) + each[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + each[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))[:SKETCH].view(np.int64).tolist()


def distinct_texts(sketches: list[list[int]]) -> list[int]:
    """Places of the texts that are no near copy of an earlier one."""
    holders: dict[int, list[int]] = {}
    kept = []
    for k, sketch in enumerate(sketches):
        shared = Counter(leader for x in sketch for leader in holders.get(x, ()))
        if sketch and any(n >= min(SKETCH_SHARED, len(sketch)) for n in shared.values()):
            continue
        kept.append(k)
        for x in sketch:
            holders.setdefault(x, []).append(k)
    return kept


class Model:
    """Toxic word rates and a logistic regression on shapes."""

    def __init__(self, rows: list[tuple[int | None, int | None, list[str], list[float]]], strongest: int = STRONGEST):
        """rows: quality, toxic, distinct words, shape."""
        self.strongest = strongest
        known = [(t, words) for _, t, words, _ in rows if t is not None]
        self.toxic_rate = (sum(t for t, _ in known) + 0.5) / (len(known) + 10)
        bad, seen = Counter(), Counter()
        for t, words in known:
            seen.update(words)
            if t:
                bad.update(words)
        self.words: dict[bytes, float] = {}
        tests = max(100, sum(n >= WORD_SUPPORT for n in seen.values()))
        for w, b in bad.items():
            rate = (b + 2 * self.toxic_rate) / (seen[w] + 2)
            if b >= WORD_SUPPORT and rate > 0.6 and chance(b, seen[w], self.toxic_rate) < 0.05 / tests:
                self.words[w.encode()] = rate
        graded = [(1 - q, s) for q, _, _, s in rows if q is not None]
        self.low_rate = (sum(y for y, _ in graded) + 0.5) / (len(graded) + 10)
        self.mean, self.scale, self.weights = np.zeros(SHAPES), np.ones(SHAPES), np.zeros(SHAPES + 1)
        if {y for y, _ in graded} == {0, 1}:
            x, y = np.array([s for _, s in graded]), np.array([y for y, _ in graded], float)
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
            x = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
            ridge = np.eye(SHAPES + 1) * 0.1
            for _ in range(30):  # Newton steps
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ self.weights)
                self.weights = self.weights + np.clip(step, -3, 3)
        else:
            self.weights[0] = math.log(self.low_rate / (1 - self.low_rate))

    def score(self, text: bytes | None) -> tuple[float, float]:
        """Probabilities that the text is toxic and of low quality."""
        words = text.translate(WORD_BYTES).split() if text else []
        if not words:
            return self.toxic_rate, self.low_rate
        found = sorted((self.words[w] for w in self.words.keys() & set(words)), reverse=True)
        clean = 1 - self.toxic_rate if not found else math.prod(1 - r for r in found[: self.strongest])
        x = (np.array(shape(text, words)) - self.mean) / self.scale
        z = float(self.weights[0] + x @ self.weights[1:])
        return 1 - clean, 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


FEATURES = pa.schema([("quality", pa.int32()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), ("shape", pa.list_(pa.float64())), ("sketch", pa.list_(pa.int64()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for off in range(0, batch.num_rows, STEP):
            part, rows = batch.slice(off, STEP), []
            for q, t, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = text.translate(WORD_BYTES).split() if text else []
                if words:
                    rows.append({"quality": q, "toxic": t, "words": [w.decode() for w in set(words)], "shape": shape(text, words), "sketch": sketch_of(words)})
            yield pa.RecordBatch.from_pylist(rows, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, strongest: int = STRONGEST) -> Model:
    """Fit both classifiers on at most sample_rows labelled documents; the word lists stay on executors but for words seen WORD_SUPPORT times."""
    each = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    known = texts.select("id", "th").join(each, "id").groupBy("th").agg(F.min("id").alias("id"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = materialise(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "quality-sample")
    rows = texts.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th"]).select("quality", "toxic", "text").mapInArrow(_features, "quality int, toxic int, words array<string>, shape array<double>, sketch array<long>")
    rows = materialise(rows, "quality-features")
    common = rows.select(F.explode("words").alias("w"), "toxic").groupBy("w").agg(F.sum("toxic").alias("n")).filter(F.col("n") >= WORD_SUPPORT).select("w")
    words = [r[0] for r in common.collect()]  # words of the bounded sample that WORD_SUPPORT toxic documents share
    kept = F.filter("words", lambda w: w.isin(words)) if words else F.array().cast("array<string>")
    found = sorted(tuple(r) for r in rows.select("sketch", F.coalesce("quality", F.lit(-1)), F.coalesce("toxic", F.lit(-1)), kept.alias("words"), "shape").toLocalIterator())
    known = lambda x: None if x < 0 else x
    return Model([(known(q), known(t), words, figures) for _, q, t, words, figures in (found[k] for k in distinct_texts([r[0] for r in found]))], strongest)


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _prior(groups: DataFrame, rate: Column, size: Column) -> tuple[float, float]:
    """Mean and strength of a Beta prior from the spread of group rates, by moments; one row comes to the driver."""
    n, s, q, inv = groups.agg(F.sum(size), F.sum(rate * size), F.sum(rate * rate * size), F.sum(F.lit(1.0))).first()
    if not n:
        return 0.5, 100.0
    mean = min(max(s / n, 1e-4), 1 - 1e-4)
    between = max(q / n - mean * mean - mean * (1 - mean) * inv / n, 1e-6)  # less the spread that sampling alone gives
    return mean, min(max(mean * (1 - mean) / between - 1, 2.0), 10_000.0)


def quality(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", site_shift: float = SITE_SHIFT) -> DataFrame:
    """One row per input row: id, text_hash, p_toxic, p_low, host_rate, path_rate, score (bad, 0 to 1), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off in range(0, batch.num_rows, STEP):
                part = batch.slice(off, STEP)
                scores = [shared.value.score(t) for t in part.column(4).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array([a for a, _ in scores], pa.float64()), pa.array([b for _, b in scores], pa.float64())], ["id", "text_hash", "host", "path", "p_toxic", "p_low"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = texts.mapInArrow(run, f"id {type_of(docs, id_col)}, text_hash long, host string, path string, p_toxic double, p_low double")
    scored = materialise(scored.withColumn("p", 1 - (1 - F.col("p_toxic")) * (1 - F.col("p_low"))), "quality-scores")

    paths = materialise(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    mean, strength = _prior(hosts, F.col("hs") / F.col("hn"), F.col("hn"))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + mean * strength) / (F.col("hn") + strength))
    sites = null_safe(paths, hosts, ["host"], "inner")
    _, within = _prior(sites, F.least(F.greatest(F.col("s") / F.col("n") - F.col("host_rate") + mean, F.lit(0.0)), F.lit(1.0)), F.col("n"))
    sites = materialise(sites.select("host", "path", "host_rate", ((F.col("s") + F.col("host_rate") * within) / (F.col("n") + within)).alias("path_rate")), "quality-sites")

    site = F.xxhash64("host", "path")
    hot = hot_keys(paths.withColumn("site", site), "site", "n")
    out = null_safe(add_salt(scored.withColumn("site", site), "site", hot), spread(sites.withColumn("site", site), "site", hot), ["site", "__salt", "host", "path"], "inner")
    shift = F.least(F.greatest(_odds(F.col("path_rate")) - _odds(F.lit(mean)), F.lit(-float(site_shift))), F.lit(float(site_shift)))
    score = 1 / (1 + F.exp(-(_odds(F.col("p")) + shift)))
    return out.select("id", "text_hash", "p_toxic", "p_low", "host_rate", "path_rate", score.alias("score"), (score <= 0.5).alias("kept"))


def of_pages(url: Column) -> tuple[Column, Column]:
    """Host and first directory of the path of a URL; empty where there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return host, F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([^/?#]+)/", 1)


def documents_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator over a documents table: the source stands for the host, the language for a section of it."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, model, F.col("source"), F.col("lang"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    out = documents_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    return out.select(F.col("id").alias("doc_id"), "p_toxic", "p_low", "host_rate", "path_rate", "score", "kept")
