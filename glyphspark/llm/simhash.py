"""SimHash near-dedup with pigeonring filtering.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, 3-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42; a bit is 1 if it is set in over half the hashes. Fingerprints that
differ in MAX_BITS (3) or fewer bits are linked; components are what links reach.

Pigeonring: the fingerprint is a ring of 5 segments of 13, 13, 13, 13 and 12 bits. Two fingerprints within 3 bits have a start from
which, for every length l, the differences of the first l segments sum to at most 3 * l / 5: 0, 1, 1, 2, 3. So for that start
the first segment agrees and one of the next two does. Each distinct fingerprint is filed under those two segments for each
of 5 starts and 2 left-out segments (10 keys of 25 or 26 bits); fingerprints that share a key must stay within the chain's budgets before
the full Hamming check.

Scale: copies collapse to distinct fingerprints first. A key's fingerprints stream through one task in sorted order and leave as a
spanning forest (fewer links than members), never as all pairs: each is compared with those not linked to it yet, and once a
large component has formed only fingerprints outside of it are, so a dense group of n costs about 64 * n comparisons and not n * n.
Components come from alternating large-star and small-star rounds over tables in the shared folder; hubs and roots of many rows are
dealt over salts.

Near copies: 64 bits of 3-word shingles within 3 find few copies below 0.95 in similarity. `near_copies` finds those of a similarity of
about 0.8 of five-word shingles and more: a text has SEEDS fingerprints of 2-word shingles, which an edit disturbs less, and as many of
5-word shingles. Texts are linked when their 2-word fingerprints of any seed are within 3 bits and all 5-word bits of all seeds differ in at
most NEAR of them. Both bounds are held against each pair of a key before any forest is built, and a node is the whole of both vectors,
so no link depends on the order of rows and none within the bounds is lost.

Edge cases: null or blank texts have fingerprint zero and link like any other; repeated rows share a class; a null id is
never the smallest; an empty table gives an empty result; a very long text is read whole, in pieces of CHUNK shingles; ids keep their type;
only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm.common import add_salt, hot_keys, materialise, scratch, spread, type_of

MAX_BITS = 3
#: Near copies: fingerprints per text, and the largest share of differing 5-word bits of linked texts. A similarity of 0.8 is 0.1515; the
#: rest is one and a half standard deviations of 1,024 bits.
SEEDS = 16
NEAR = 0.168
#: Shingles of the fingerprints that find near copies, and of those that confirm them.
FIND_WORDS, CONFIRM_WORDS = 2, 5
#: Bits of the ring's segments, and where each starts.
RING = (13, 13, 13, 13, 12)
AT = (0, 13, 26, 39, 52)
#: Keys of a fingerprint.
TAGS = 2 * len(RING)
#: Filed rows that a task sorts, as long as that takes no more than MAX_TASKS tasks.
TASK_ROWS, MAX_TASKS = 500_000, 100_000
#: Members of a key that are compared with all others before only those outside the largest component are.
PIVOTS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = 128
#: Bits of each byte value, for counting set bits by byte histograms.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
#: Shingles hashed at once for one text.
CHUNK = 1 << 13
_SEED_OF = np.array([seed * 0x9E3779B97F4A7C15 % (1 << 64) for seed in range(64)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for each row of hashes."""
    columns = np.ascontiguousarray(hashes.T).view(np.uint8)  # a row per shingle, eight columns per seed
    n = columns.shape[1]
    places = columns + np.arange(n, dtype=np.int64) * 256
    return (np.bincount(places.ravel(), minlength=256 * n).reshape(n, 256) @ BITS).reshape(len(hashes), 64)


def _prints(counts: np.ndarray, total: int) -> list[int]:
    set_bits = (2 * counts > total).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of a text's shingles by XXH64; zero for a text without words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    size = min(width, len(words))
    total, counts = len(words) - size + 1, np.zeros((1, 64))
    for at in range(0, total, CHUNK):
        to = min(total, at + CHUNK)
        spans = zip(starts[at:to].tolist(), (ends[at + size - 1 : to + size - 1] - 1).tolist(), strict=True)
        counts += _set_bits(np.array([[xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans]], "<u8"))
    return _prints(counts, total)[0]


def near_prints(text: bytes | None, seeds: int = SEEDS) -> tuple[list[int], list[int]]:
    """`seeds` fingerprints of FIND_WORDS-word shingles and as many of CONFIRM_WORDS-word shingles; zeros for a text without words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return [0] * seeds, [0] * seeds
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = []
    for width in (FIND_WORDS, CONFIRM_WORDS):
        size = min(width, len(words))
        total, counts = len(words) - size + 1, np.zeros((seeds, 64))
        h = np.zeros(total, np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + each[k : k + total]
        for at in range(0, total, CHUNK):
            counts += _set_bits(_mixed(h[None, at : at + CHUNK] ^ _SEED_OF[:seeds, None]))
        out.append(_prints(counts, total))
    return out[0], out[1]


def _lists(rows: list[list[int]], seeds: int) -> pa.ListArray:
    flat = np.array(rows, np.uint64).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, seeds), pa.int32()), pa.array(flat))


def _printer(width: int, seeds: int):
    """Rows (id, text_hash, text) -> (id, text_hash, fp) or, with several seeds, (id, text_hash, fp, fps, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off in range(0, batch.num_rows, STEP):
                part = batch.slice(off, STEP)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                if not seeds:
                    prints = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints)], ["id", "text_hash", "fp"])
                    continue
                pairs = [near_prints(t, seeds) for t in texts]
                first = np.array([a[0] for a, _ in pairs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(first), _lists([a for a, _ in pairs], seeds), _lists([b for _, b in pairs], seeds)], ["id", "text_hash", "fp", "fps", "vector"])

    return run


def _budgets(start: int) -> list[tuple[np.uint64, int]]:
    """Masks of the first three, four and five segments from a start, and the differences that they may hold."""
    sizes = [RING[(start + k) % 5] for k in range(5)]
    return [(np.uint64((1 << sum(sizes[:length])) - 1), MAX_BITS * length // 5) for length in (3, 4, 5)]


BUDGETS = [_budgets(start) for start in range(5)]
ANY_START = [(np.uint64((1 << 64) - 1), MAX_BITS)]


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints with segment `start` in the lowest bits."""
    turn = np.uint64(AT[start])
    return fp if start == 0 else (fp >> turn) | (fp << np.uint64(64 - AT[start]))


def linked(fp: np.ndarray, budgets: list[tuple[np.uint64, int]], vectors: np.ndarray | None = None, most: int = 0) -> np.ndarray:
    """For each fingerprint the least place of its component: links are within all budgets, and vectors within `most` bits."""
    label = np.arange(len(fp))

    def meet(i: int) -> np.ndarray | None:
        """Join the components that i has links to."""
        other = np.flatnonzero(label != label[i])
        differs = fp[other] ^ fp[i]
        for mask, budget in budgets:
            ok = np.bitwise_count(differs & mask) <= budget
            other, differs = other[ok], differs[ok]
        if vectors is not None and len(other):
            other = other[np.bitwise_count(vectors[other] ^ vectors[i]).sum(1, dtype=np.int64) <= most]
        if not len(other):
            return None
        joined = np.unique(np.append(label[other], label[i]))
        label[np.isin(label, joined)] = joined[0]
        return joined

    for i in range(min(len(fp), PIVOTS)):
        meet(i)
        if not label.any():
            return label
    # of two that are not linked yet, one at least is outside this component
    large = int(np.argmax(np.bincount(label)))
    for i in range(PIVOTS, len(fp)):
        if label[i] != large:
            joined = meet(i)
            if joined is not None and large in joined:
                large = int(joined[0])
    return label


def _by_key(batches: Iterator[pa.RecordBatch], of_group, of_pairs, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, ...) -> rows of of_group(key, columns...) for keys of three rows or more, and of of_pairs(keys, first rows, second
    rows) for all keys of two at once; the last key of a batch waits for the next batch."""
    held: list[list[np.ndarray]] = []

    def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        columns = []
        for column in batch.columns:
            if pa.types.is_list(column.type):
                columns.append(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1))
            else:
                columns.append(column.to_numpy(zero_copy_only=False))
        return columns

    def finish(parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        keys, *columns = (np.concatenate([p[k] for p in parts]) for k in range(len(parts[0])))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        found = [of_pairs(keys[two], [c[two] for c in columns], [c[two + 1] for c in columns])] if len(two) else []
        for g in np.flatnonzero(sizes > 2):
            own = slice(cuts[g], cuts[g + 1])
            found.append(of_group(int(keys[cuts[g]]), *(c[own] for c in columns)))
        found = [f for f in found if len(f)]
        if not found:
            return None
        rows = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(len(names))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = columns_of(batch)
        keys = columns[0]
        if held and held[0][0][0] == keys[-1]:  # one key spans the whole batch
            held.append(columns)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        done = [*held, [c[:cut] for c in columns]]
        held = [[c[cut:] for c in columns]]
        if (rows := finish(done)) is not None:
            yield rows
    if held and (rows := finish(held)) is not None:
        yield rows


def _start_of(key):
    return ((key >> 26) % TAGS) // 2


def _near_pairs(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For fingerprints that are alone under a key, whether their chain stays within its budgets."""
    a, b, start = a.view(np.uint64), b.view(np.uint64), _start_of(keys)
    ok = np.zeros(len(keys), bool)
    for s in range(5):
        mine = start == s
        differs = _rotated(a[mine] ^ b[mine], s)
        ok[mine] = np.all([np.bitwise_count(differs & mask) <= budget for mask, budget in BUDGETS[s]], axis=0)
    return ok


def key_components(key: int, fp: np.ndarray) -> np.ndarray:
    """For each fingerprint of a key the least place of its component there."""
    distinct, place = np.unique(fp.view(np.uint64), return_inverse=True)
    start = _start_of(key)
    first = np.full(len(distinct), len(fp))
    np.minimum.at(first, place, np.arange(len(fp)))
    root = linked(_rotated(distinct, start), BUDGETS[start])
    least = np.full(len(distinct), len(fp))
    np.minimum.at(least, root, first)
    return least[root][place]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) -> links of each key."""

    def of_group(key: int, fp: np.ndarray) -> np.ndarray:
        root = key_components(key, fp)
        far = np.flatnonzero(root != np.arange(len(fp)))
        return np.column_stack([fp[far], fp[root[far]]])

    def of_pairs(keys: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        ok = _near_pairs(keys, a[0], b[0])
        return np.column_stack([a[0][ok], b[0][ok]])

    return _by_key(batches, of_group, of_pairs, ["a", "b"])


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) -> members of each component of fingerprints of each key, under a hash of all of them: many keys have the same.

    Members of a pair have fingerprint zero: that they are near is known, whatever the seed."""

    def of_group(key: int, fp: np.ndarray, node: np.ndarray) -> np.ndarray:
        root, rows = key_components(key, fp), []
        order = np.argsort(root, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            if len(part) > 2:
                own = part[np.lexsort((node[part], fp[part]))]
                name = xxhash.xxh3_64_intdigest(fp[own].tobytes() + node[own].tobytes())
                rows.append(np.column_stack([np.full(len(own), name - ((name >> 63) << 64)), fp[own], node[own]]))
            elif len(part) == 2:
                rows.append(pairs(node[part[:1]], node[part[1:]]))
        return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        name = _mixed(_mixed(low.view(np.uint64)) + high.view(np.uint64)).view(np.int64)
        zero = np.zeros(len(a), np.int64)
        return np.concatenate([np.column_stack([name, zero, low]), np.column_stack([name, zero, high])])

    def of_pairs(keys: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        ok = _near_pairs(keys, a[0], b[0])
        return pairs(a[1][ok], b[1][ok])

    return _by_key(batches, of_group, of_pairs, ["key", "fp", "node"])


def _confirmed(groups: DataFrame, vectors: DataFrame, parts: int, most: int) -> DataFrame:
    """Links of members of groups (key, fp, node) whose vectors differ in at most `most` bits, held against each pair."""

    def of_group(key: int, fp: np.ndarray, node: np.ndarray, vector: np.ndarray) -> np.ndarray:
        root = linked(fp.view(np.uint64), ANY_START, vector, most)
        far = np.flatnonzero(root != np.arange(len(fp)))
        return np.column_stack([node[far], node[root[far]]])

    def of_pairs(keys: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        ok = np.bitwise_count(a[2] ^ b[2]).sum(1, dtype=np.int64) <= most
        ok &= np.bitwise_count((a[0] ^ b[0]).view(np.uint64)) <= MAX_BITS
        return np.column_stack([a[1][ok], b[1][ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_key(batches, of_group, of_pairs, ["a", "b"])

    each = groups.join(vectors, "node").select("key", "fp", "node", "vector")
    return each.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _keys(prints: DataFrame) -> DataFrame:
    """Each (seed, fp, node) under 10 keys: the tag (seed, start, left-out segment) above the two agreeing segments."""
    segment = lambda k: F.shiftrightunsigned("fp", AT[k % 5]).bitwiseAND(F.lit((1 << RING[k % 5]) - 1))
    keys = []
    for start in range(5):
        for out in (1, 2):
            tag = F.shiftleft((F.col("seed") * TAGS + start * 2 + out - 1).cast("bigint"), 26)
            keys.append(tag.bitwiseOR(F.shiftleft(segment(start), 13)).bitwiseOR(segment(start + 3 - out)))
    return prints.withColumn("key", F.explode(F.array(*keys)))


def _filed(filed: DataFrame) -> DataFrame:
    """Rows with their keys, dealt by key and sorted; tasks get some TASK_ROWS."""
    rows = TAGS * filed.count()
    parts = max(int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows // TASK_ROWS, MAX_TASKS), 1)
    return _keys(filed).repartition(parts, "key").sortWithinPartitions("key")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected links -> (node, root), root the least node reached, for all nodes with links."""
    spark = links.sparkSession
    edges = materialise(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    state = None
    while True:
        with scratch(spark):
            # large star: the larger neighbours of a node move to its least neighbour
            both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = _starred(both, "large").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
            large = materialise(large, "star")
            # small star: a node and its smaller neighbours move to the least of them
            joined = _starred(large, "small")
            least = joined.select("a", "m").distinct()
            small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
            after = materialise(small, "links", lasting=True)
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(now)


def _starred(edges: DataFrame, kind: str) -> DataFrame:
    """Edges (a, b) with m, the least of a and its neighbours; the many edges of a hub are dealt over salts."""
    least = F.least(F.min("b"), F.first("a")) if kind == "large" else F.min("b")
    hubs = materialise(edges.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("n")), "hubs")
    hot = hot_keys(hubs, "a", "n")
    return add_salt(edges, "a", hot, F.col("b")).join(spread(hubs.drop("n"), "a", hot), ["a", "__salt"]).drop("__salt")


def _named(prints: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Prints with root and component_id of their node. classes: (node, least, n)."""
    rooted = classes.join(components(links), "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    ends = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-ends")
    many = hot_keys(ends, "root", "n")
    named = add_salt(rooted, "root", many, F.col("node")).join(spread(ends.drop("n"), "root", many), ["root", "__salt"], "left").select("node", "root", F.coalesce("component_id", "least").alias("component_id"))
    hot = hot_keys(classes, "node", "n")
    return add_salt(prints, "node", hot).join(spread(named, "node", hot), ["node", "__salt"]).select("id", "text_hash", "fp", "component_id", "root")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: id, text_hash (of the text), fp (signed), component_id (smallest id reachable), root
    (names the component, also where ids are null or repeated). Links are fingerprints of `width`-word shingles within MAX_BITS."""
    prints = _texts(docs, id_col, text_col).mapInArrow(_printer(width, 0), f"id {type_of(docs, id_col)}, text_hash long, fp long")
    prints = materialise(prints, "simhash-prints").withColumn("node", F.col("fp"))
    classes = materialise(prints.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    keyed = _filed(classes.select(F.lit(0).alias("seed"), F.col("node").alias("fp"))).select("key", "fp")
    return _named(prints, classes, keyed.mapInArrow(_bucket_links, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, near: float = NEAR) -> DataFrame:
    """As simhash_dedup, but components of texts whose 5-word shingles are about 0.8 alike or more; fp is the first 2-word fingerprint."""
    prints = _texts(docs, id_col, text_col).mapInArrow(_printer(0, seeds), f"id {type_of(docs, id_col)}, text_hash long, fp long, fps array<long>, vector array<long>")
    prints = materialise(prints, "simhash-prints").withColumn("node", F.xxhash64("fps", "vector"))
    classes = materialise(prints.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("fps").alias("fps"), F.first("vector").alias("vector")), "simhash-classes")
    keyed = _filed(classes.select("node", F.posexplode("fps").alias("seed", "fp"))).select("key", "fp", "node")
    groups = materialise(keyed.mapInArrow(_bucket_groups, "key long, fp long, node long").distinct(), "simhash-groups")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups.count() // TASK_ROWS, MAX_TASKS))
    links = _confirmed(groups, classes.select("node", "vector"), parts, int(near * 64 * seeds))
    return _named(prints.drop("fps", "vector"), classes.select("node", "least", "n"), links)


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
