"""Line, exact, near and substring dedup against brute force, with odd inputs."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphspark.llm import common, exact_dedup, line_dedup, simhash, substring_dedup
from glyphspark.llm.common import add_salt, hot_keys, spread

SCHEMA = "doc_id long, text string, source string, n_dropped string, kept string, id string, key string"


def docs(spark, rows):
    """(doc_id, text) rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "s", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def odd_rows(rng):
    rows = [(k, " ".join(rng.choice(["the", "cat", "Émile", "x"]) for _ in range(rng.randrange(6)))) for k in range(60)]
    return [*rows, (100, None), (101, ""), (102, " \t\n\x0b\x0c\r"), (103, "word " * 30_000), (104, "word " * 30_000 + " "), (105, "wo rd"), (106, "word"), (107, " word")]


@pytest.fixture
def few_rows(monkeypatch):
    """Keys of over 50 rows are hot."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)


# exact


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        for _, i in members:
            out[i] = (min(members)[1], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, bits):
    rows = odd_rows(random.Random(1))
    got = exact_dedup.exact_dedup(docs(spark, rows), hash_bits=bits, bucket_records=3).collect()
    want = exact_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["id"]]
        assert r["kept"] == (r["id"] == r["keep_id"])


def test_exact_dedup_hot_key_and_repeats(spark, few_rows):
    rows = [(k, "the same text") for k in range(600)] + [(k, f"text {k}") for k in range(600, 700)] + [(650, "text 650"), (650, "text 650"), (None, "lone"), (None, "the same text")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == 1 + 100 + 1
    hot = [r for r in got if r["group_size"] == 601]
    assert len(hot) == 601 and {r["keep_id"] for r in hot} == {0}
    assert sum(r["kept"] for r in got if r["id"] == 650) == 1 and {r["copies"] for r in got if r["id"] == 650} == {3}


def test_exact_dedup_hot_collisions(spark, few_rows):
    """Different texts under one hot hash, dealt over salts."""
    rows = [(k, f"text {k % 7}") for k in range(700)]
    got = exact_dedup.exact_dedup(docs(spark, rows), hash_bits=1).collect()
    want = exact_brute(rows)
    assert all((r["keep_id"], r["group_size"]) == want[r["id"]][:2] for r in got)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_directory():
    counts = {0: 10, 1: 10, 5: 1, 7: 30}
    depth, slots = exact_dedup.build_directory(counts, 12, max_depth=3)
    assert len(slots) == 1 << depth == 8
    assert slots == sorted(slots)
    load = {}
    for prefix, n in counts.items():
        load[slots[prefix]] = load.get(slots[prefix], 0) + n
    assert all(n <= 12 for b, n in load.items() if b != slots[7])
    assert exact_dedup.build_directory({}, 12, 4) == (0, [0])


def test_buckets_own_the_work(spark, tmp_path):
    """A bucket's rows, and no others, are in its owner's partition; no owner gets more than HOT_ROWS rows of one hash."""
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("key"), "id")
    directory = exact_dedup.open_directory(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), 100)
    assert directory.buckets >= 30 and directory.pages == 3 == -(-3000 // common.HOT_ROWS)
    routed = directory.route(rows).withColumn("at", F.spark_partition_id())
    assert routed.filter("at != owner").count() == 0
    assert routed.groupBy("owner", "key").count().agg(F.max("count")).first()[0] <= 1.2 * common.HOT_ROWS
    ranges = routed.filter(f"owner < {directory.buckets}").select("owner", F.shiftrightunsigned("key", 1).alias("k")).groupBy("owner").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("owner").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:], strict=False))


# lines


def lines_brute(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    common = ["A line that many documents share", "  a LINE that many documents share\r", "Übung macht den Meister, immer!", "short", "", "exactly twenty chars", "nineteen characters"]
    rows = [(k, "\n".join(rng.choice([*common, f"only in {k} and in no other"]) for _ in range(rng.randrange(7)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(["A line that many documents share"] * 20_000))]
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    want = lines_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_lines"], len(r["dropped"]), r["kept_text"]) == want[r["id"]]


def test_line_dedup_repeated_and_null_ids(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line), (1, line), (1, line), (2, "x\n" + line)]
    assert all(not r["dropped"] for r in line_dedup.line_dedup(docs(spark, rows)).collect())
    rows += [(None, line), (None, line)]
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert sum(len(r["dropped"]) for r in got) == 5 and [r["dropped"] for r in got if r["id"] == 2] == [[]]
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_hot_line(spark, few_rows):
    line = "the one line that every document holds"
    rows = [(k, f"{line}\nand a line of number {k} alone") for k in range(500)]
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert sum(len(r["dropped"]) for r in got) == 499


def test_hot_keys_by_rows(spark):
    counts = spark.range(5000).select((F.col("id") % 7).alias("k"), F.lit(1).alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
    assert hot_keys(counts, "k", "n") is None
    counts = counts.withColumn("n", F.col("n") * 10)
    assert {(r["__hot"], r["__salts"]) for r in hot_keys(counts, "k", "n").collect()} == {(k, 8) for k in range(7)}


def test_salted_rows_meet_their_record_once(spark):
    """Rows of a hot key meet their one record under every salt; no salt has more than its share."""
    rows = spark.range(9000).select((F.col("id") % 3).alias("k"), F.lit(None).cast("long").alias("id"))
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(one, "k", "n")
    dealt = add_salt(rows, "k", hot)
    assert dealt.groupBy("k", "__salt").count().agg(F.max("count")).first()[0] <= 1.2 * common.HOT_ROWS
    assert dealt.join(spread(one, "k", hot), ["k", "__salt"]).count() == 9000


# near


def naive_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, limit=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= limit):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_simhash(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400)]
    rows = []
    for k in range(120):
        words = base[:]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = "new"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, " \n"), (202, "One"), (203, "one two"), (204, "ONE  TWO"), (205, "w " * 100_000), (206, "É a b"), (207, "é a b")]
    got = {r["id"]: r for r in simhash.simhash_dedup(docs(spark, rows)).collect()}
    prints = [naive_print(t) for _, t in rows]
    want = roots(prints)
    for (i, _), p, w in zip(rows, prints, want, strict=True):
        assert got[i]["fp"] % (1 << 64) == p
        assert got[i]["component_id"] == rows[w][0]
    assert len(set(want)) < len(rows) - 5
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0


def test_simhash_repeats_and_nulls(spark):
    got = simhash.simhash_dedup(docs(spark, [(3, "x y z"), (3, "x y z"), (None, "x y z"), (None, "alone here now")])).collect()
    assert sorted((str(r["id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def near_roots(texts):
    """Components by comparing all vectors of near_prints with all."""
    prints = [simhash.near_prints((t or "").encode()) for t in texts]
    find, confirm = (np.array([p[k] for p in prints], np.uint64) for k in (0, 1))
    most, root = int(simhash.NEAR * 64 * simhash.SEEDS), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        alike = (np.bitwise_count(find ^ find[i]).min(1) <= 3) & (np.bitwise_count(confirm ^ confirm[i]).sum(1, dtype=int) <= most)
        for j in np.flatnonzero(alike):
            x, y = top(i), top(int(j))
            root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def edited(rng, words, n):
    words = words[:]
    for k in rng.sample(range(len(words)), n):
        words[k] = f"n{rng.randrange(10**6)}"
    return words


def jaccard(a, b, width=5):
    x, y = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies_by_similarity():
    """Direct links of edited copies: 0.9 and more of those at 0.8 and above, next to none below 0.7."""
    rng, met = random.Random(9), {}
    most = int(simhash.NEAR * 64 * simhash.SEEDS)
    for _ in range(700):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([120, 250, 400]))]
        copy = edited(rng, base, rng.randrange(1, len(base) // 14))
        (fa, ca), (fb, cb) = (simhash.near_prints(" ".join(w).encode()) for w in (base, copy))
        far = lambda x, y: np.bitwise_count(np.array(x, np.uint64) ^ np.array(y, np.uint64))
        met.setdefault(int(jaccard(base, copy) * 20 + 1e-9) / 20, []).append(far(fa, fb).min() <= 3 and far(ca, cb).sum() <= most)
    share = {band: sum(x) / len(x) for band, x in met.items() if len(x) >= 20}
    assert all(share[band] >= 0.9 for band in share if band >= 0.8) and {0.8, 0.85, 0.9} <= share.keys()
    assert all(share[band] <= 0.1 for band in share if band < 0.7)


def test_near_copies_against_brute_force(spark, few_rows):
    """No link is lost or added: chains of copies of copies, copies by the hundred, odd texts, repeated and null ids."""
    rng = random.Random(10)
    rows = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.randrange(1, 6)):
            rows.append((len(rows), " ".join(words)))
            words = edited(rng, words, max(1, len(words) // 45))
    base = [f"v{rng.randrange(3000)}" for _ in range(200)]
    rows += [(1000 + k, " ".join(edited(rng, base, rng.randrange(6)))) for k in range(150)]
    rows += [(2000, None), (2001, " "), (2002, "one"), (2003, "ONE"), (2004, "w " * 50_000), (2005, "w " * 50_000 + "x")]
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert got == {i: rows[w][0] for (i, _), w in zip(rows, near_roots([t for _, t in rows]), strict=True)}
    assert simhash.near_copies(docs(spark, [])).count() == 0
    odd = simhash.near_copies(docs(spark, [(3, rows[0][1]), (3, rows[0][1]), (None, rows[0][1].upper()), (None, "alone here now")])).collect()
    assert sorted((str(r["id"]), str(r["component_id"])) for r in odd) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_each_pair_of_a_key_meets_the_bound():
    """Whatever node comes first in a key: nodes within the bound of each other are linked, a dissimilar one is not."""
    rng = np.random.default_rng(7)
    one, far = rng.integers(0, 1 << 63, (2, 12)).astype(np.uint64)
    far[0] = one[0]
    for first in (0, 3, 5):
        vectors = np.tile(one, (6, 1))
        vectors[:, 1] ^= np.arange(6, dtype=np.uint64)
        vectors[3:, 0] ^= np.uint64(1 << 63)
        vectors[first] = far
        root = simhash.linked(vectors[:, 0], simhash.ANY_START, vectors, 90)
        assert len(set(np.delete(root, first))) == 1 and root[first] == first


@pytest.mark.parametrize("pivots", [64, 2])
def test_links_of_a_key(monkeypatch, pivots):
    """The chains of all 10 keys find every pair within three bits, also where few members are compared with all."""
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rng = np.random.default_rng(4)
    prints = {int(rng.integers(0, 1 << 63))}
    while len(prints) < 250:
        x = list(prints)[int(rng.integers(len(prints)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            x ^= 1 << int(b)
        prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    index, root = {p: k for k, p in enumerate(prints.tolist())}, list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for start in range(5):
        for out in (1, 2):
            keys = {}
            for p in prints.tolist():
                keys.setdefault(tuple(p >> simhash.AT[s % 5] & (1 << simhash.RING[s % 5]) - 1 for s in (start, start + 3 - out)), []).append(p)
            for group in keys.values():
                for k, r in enumerate(simhash.key_components((start * 2 + out - 1) << 26, np.array(group, np.uint64).view(np.int64))):
                    x, y = find(index[group[k]]), find(index[group[r]])
                    root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == roots(prints.tolist())


def test_dense_groups_take_little_time():
    """60,000 fingerprints of one key, near a common one: about 64 comparisons each."""
    rng = np.random.default_rng(1)
    prints = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(26, 64, (60_000, 4)).astype(np.uint64), axis=1))
    began = time.process_time()
    assert len(set(simhash.linked(prints, simhash.BUDGETS[0]).tolist())) < len(prints) / 2
    assert time.process_time() - began < 30


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# substrings


def passage(rng, n):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(7, n, 9):
        words[k] += "."
    return " ".join(words)


def test_substring_dedup(spark):
    rng = random.Random(5)
    shared = passage(rng, 60)
    rows = [(k, f"{passage(rng, 40)} Été. {shared if k in (4, 9, 17) else ''} {passage(rng, 30)}\n{passage(rng, 12)}") for k in range(20)]
    rows += [(50, None), (51, ""), (52, shared.upper()), (53, "same few words"), (54, "same few words")]
    got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    texts = dict(rows)
    assert {r["id"] for r in got} == {9, 17, 52}
    for r in got:
        removed = texts[r["id"]][r["start"] : r["end"]]
        assert r["keep_id"] < r["id"] and removed.lower().split(". ", 1)[-1] in shared.lower() and r["n_words"] == len(removed.split()) >= 32


def test_every_passage_of_fifty_words_is_found(spark):
    """Against brute force: whoever repeats 50 words of an earlier document loses words, who repeats under 32 loses none."""
    rng = random.Random(8)
    sources = [passage(rng, rng.choice([20, 31, 32, 47, 48, 50, 51, 70, 200])) for _ in range(40)]
    rows = [(k, " ".join([passage(rng, rng.randrange(40)), *rng.sample(sources, rng.randrange(3)), passage(rng, rng.randrange(40))])) for k in range(150)]
    found = {r["id"] for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    longest, seen = {}, {}
    for n in (substring_dedup.WINDOW, substring_dedup.WINDOW + substring_dedup.SPAN - 1):
        for i, t in rows:
            words = t.split()
            for k in range(len(words) - n + 1):
                w = tuple(words[k : k + n])
                if seen.setdefault(w, i) != i:
                    longest[i] = n
    assert {i for i, n in longest.items() if n > substring_dedup.WINDOW} <= found <= set(longest)


def repeats_brute(rows, window=substring_dedup.WINDOW):
    """Words (id, place) of windows that occurred before, by (id, place)."""
    seen, gone = set(), set()
    for i, t in sorted(rows):
        words = t.lower().split()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone |= {(i, k + j) for j in range(window)}
            seen.add(w)
    return gone


def removed_words(rows, spans):
    texts, gone = dict(rows), set()
    for r in spans:
        first = len(texts[r["id"]][: r["start"]].split())
        gone |= {(r["id"], first + j) for j in range(len(texts[r["id"]][r["start"] : r["end"]].split()))}
    return gone


def test_whole_repeats_go(spark):
    """Passages of 48 words or more within longer lines lose every word that repeats, also if a third text has only a part of them."""
    rng = random.Random(12)
    sources = [passage(rng, n) for n in (48, 50, 51, 55, 60, 64, 90, 120, 200) for _ in range(6)]
    rows = []
    for k in range(160):
        part = rng.choice(sources).split()
        if len(part) > 100 and rng.random() < 0.5:  # a piece of a longer passage
            at = rng.randrange(len(part) - 60)
            part = part[at : at + rng.randrange(48, 61)]
        rows.append((k, " ".join([passage(rng, rng.randrange(5, 40)), *part, passage(rng, rng.randrange(5, 40)), rng.choice(sources), passage(rng, rng.randrange(5, 40))])))
    got = removed_words(rows, substring_dedup.substring_dedup(docs(spark, rows)).collect())
    assert got == repeats_brute(rows)


def units_brute(rows, split, min_words):
    """Places (id, word) of units that occurred before."""
    seen, gone = set(), set()
    for i, t in sorted(rows):
        at = 0
        for piece in re.split(split, t or ""):
            words = piece.lower().split()
            if len(words) >= max(1, min_words):
                if tuple(words) in seen:
                    gone |= {(i, at + k) for k in range(len(words))}
                seen.add(tuple(words))
            at += len(words)
    return gone


@pytest.mark.parametrize("unit, split", [("line", r"\n"), ("paragraph", r"\n[ \t]*\n"), ("sentence", r"(?<=[.!?])[ \t]+|\n")])
@pytest.mark.parametrize("min_words", [1, 6])
def test_units_of_any_length(spark, few_rows, unit, split, min_words):
    """Units alone, exactly: each occurrence but the first goes, however short; a line that all hold, and a very long text."""
    rng = random.Random(13)
    common = [passage(rng, n) for n in (1, 2, 5, 6, 8, 12, 40)]
    rows = [(k, rng.choice(["\n", "\n \n", " "]).join(["A line of all documents here.", *(rng.choice(common) if rng.random() < 0.5 else passage(rng, 9) for _ in range(6))])) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "\n".join(f"{common[2]}\nline {k} of one very long text" for k in range(4000)))]
    got = removed_words([(i, t or "") for i, t in rows], substring_dedup.substring_dedup(docs(spark, rows), unit=unit, min_words=min_words, with_windows=False).collect())
    assert got == units_brute(rows, split, min_words) and got


def test_windows_and_short_lines_together(spark):
    """Lines of eight words or more go where they repeat, between texts of their own; shorter ones stay."""
    rng = random.Random(13)
    long, short = passage(rng, 8), passage(rng, 7)
    rows = [(k, "\n".join([passage(rng, 20), long, passage(rng, 15), short, passage(rng, 15)])) for k in range(30)]
    got = substring_dedup.substring_dedup(docs(spark, rows), min_words=8).collect()
    texts = dict(rows)
    assert sorted((r["id"], texts[r["id"]][r["start"] : r["end"]], r["n_words"], r["keep_id"]) for r in got) == [(k, long, 8, 0) for k in range(1, 30)]
    assert substring_dedup.substring_dedup(docs(spark, rows)).count() == 0


def test_hashes_of_windows():
    words = [f"w{k % 50}".encode() for k in range(500)]
    at, h, g = substring_dedup.windows(words)
    assert len(set(zip(h.tolist(), g.tolist(), strict=True))) == len({p % 50 for p in at.tolist()})
    assert max(b - a for a, b in zip(at, at[1:], strict=False)) <= substring_dedup.SPAN
    same = substring_dedup.windows([b"x"] * 1000)[0]
    assert len(same) <= 1000 // substring_dedup.SPAN + 2


def test_substring_dedup_within_a_document_and_repeats(spark):
    rng = random.Random(6)
    p = passage(rng, 55)
    got = substring_dedup.substring_dedup(docs(spark, [(1, p + "\n" + p), (1, p + "\n" + p), (2, "other words here")])).collect()
    assert {(r["id"], r["keep_id"]) for r in got} == {(1, 1)}
    assert all(r["start"] >= len(p) for r in got)
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0
    named = docs(spark, [(1, p), (2, f"x {p}")]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert [(r["id"], r["keep_id"], r["n_words"]) for r in substring_dedup.substring_dedup(named).collect()] == [("d2", "d1", 55)]


def test_remaining_text(spark):
    row = spark.sql("select 'abcdéfgh' as t, array(named_struct('start', 1L, 'end', 3L), named_struct('start', 4L, 'end', 6L)) as s")
    assert row.select(substring_dedup.remaining_text(F.col("t"), F.col("s")).alias("x")).first()["x"] == "adgh"
