"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed greedily against each of
them: a phrase is the longest match from the current place, and the next phrase starts where it ends. A phrase costs about
log2(symbols of the sample) bits, so phrase counts are normalised by that; a letter that the sample lacks is a phrase and has to be
named besides, which costs log2(symbols) bits. The language whose parse costs least wins, equal costs fall to the language name that
sorts first.

Learning reads only text and language of documents whose crc32(id as text) mod 5 is not 0; predictions see the text only.
The sample: of the SAMPLE_DOCS documents per language with the smallest hashes, the first PIECE_CHARS characters of each, until
a language has SAMPLE_CHARS characters, or its even share of TOTAL_CHARS but LEAST_CHARS at least. So every language that
has a text to learn from is learned, however long its texts and however many languages there are; the model's size is
bounded by TOTAL_CHARS, or by LEAST_CHARS per language where there are more than 200.

Symbols: every lower-case letter (with combining marks) of any sample is a symbol of its own, without a bound on the alphabet;
a letter that a language's sample lacks has no transition in its automaton; everything else is one blank. Transitions are
one array over states and symbols while that has DENSE entries at most, and a hash table beyond (many letters).

Whole texts are parsed. To share numpy's overhead, long texts are parsed in lanes of LANE symbols side by side, each as if a
phrase started there; then each lane is entered with the true state of the lane before and followed until both parses start
a phrase at the same symbol, from where they are the same. The result is that of parsing the text from end to end.

Edge cases: null texts and texts without letters are `und` with score 0, as is everything when nothing was learned; a null id
is never held out and never learned from; repeated rows get the same answer; an empty table gives an empty result; very
long texts cost the same per character; ids keep their type; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.llm.common import materialise, type_of

SAMPLE_DOCS = 64
SAMPLE_CHARS = 40_000
PIECE_CHARS = 8_000
TOTAL_CHARS = 400_000
LEAST_CHARS = 2_000
LANE = 1024
#: Symbols times languages parsed side by side at most.
BLOCK = 4_000_000
STEP = 512
#: Entries of a transition array (four bytes each) up to which there is one.
DENSE = 24_000_000
_automata: dict[tuple, Parser] = {}


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter or a combining mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


class Transitions:
    """Transitions (state * width + symbol) -> state, looked up for whole arrays: one array over all keys while that is small (few
    letters), else an open-addressing table."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, size: int):
        self.all = None
        if size <= DENSE:
            self.all = np.full(size, -1, np.int32)
            self.all[keys] = to
            return
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, -1, np.int32)
        place, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]  # of several for one place the last stays
            stays = self.keys[place[left]] == keys[left]
            self.to[place[left[stays]]] = to[left[stays]]
            left = left[~stays]
            place[left] = (place[left] + 1) & self.mask
        self._map: dict[int, int] | None = None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The state of each key, -1 without one."""
        if self.all is not None:
            return self.all[keys]
        place = self._home(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.to[place], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            held = self.keys[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.to[place[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def get(self, key: int) -> int:
        """The state of one key, for parses of a few symbols."""
        if self.all is not None:
            return int(self.all[key])
        if self._map is None:
            used = self.keys >= 0
            self._map = dict(zip(self.keys[used].tolist(), self.to[used].tolist(), strict=True))
        return self._map.get(key, -1)


class Parser:
    """Suffix automata of several languages over one set of sparse transitions."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.names = [name for name, _ in samples]
        letters = _letters()
        points = np.unique(np.concatenate([np.zeros(0, np.uint32), *(self.points(text) for _, text in samples)]))
        known = points[letters[points]]
        # symbols: 0 blank, 1.. letters of the samples, last: any other letter, which no automaton holds
        self.width = len(known) + 2
        self.symbols = np.where(letters, self.width - 1, 0).astype(np.int32)
        self.symbols[known] = np.arange(1, len(known) + 1)
        keys, to, self.roots, self.bits, base = [], [], [], [], 0
        for _, text in samples:
            coded = self.encode(text)
            state, symbol, target = suffix_automaton(coded)
            self.roots.append(base)
            self.bits.append(float(np.log2(len(coded) + 2)))
            keys.append((state + base) * self.width + symbol)
            to.append(target + base)
            base += int(target.max(initial=0)) + 1
        self.moves = Transitions(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *to]), base * self.width)
        every = np.arange(self.width)
        self.starts = np.stack([self.moves.find(root * self.width + every) for root in self.roots]) if samples else np.zeros((0, 2), np.int32)

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of blanks as one."""
        out = self.symbols[self.points(text)]
        return out[(out != 0) | (np.concatenate([[1], out[:-1]]) != 0)].astype(np.int64)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language."""
        lanes = [max(1, -(-len(t) // LANE)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.cumsum([0, *lanes[:-1]])
        grid = np.full((len(owner), LANE), -1, np.int64)
        for row, t in zip(first.tolist(), texts, strict=True):
            grid[row:].reshape(-1)[: len(t)] = t
        live = (grid >= 0).sum(1)
        order = np.argsort(-live, kind="stable")
        grid, live = grid[order].T.copy(), live[order]
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        count = np.zeros((len(self.names), len(owner)), np.int64)
        several = len(texts) < len(owner)
        cuts = np.zeros((int(live.max(initial=0)) if several else 0, *count.shape), bool)
        for j in range(int(live.max(initial=0))):
            n = int(np.searchsorted(-live, -j))  # lanes longer than j
            symbol = grid[j, :n]
            to = self.moves.find((state[:, :n] * self.width + symbol).ravel()).reshape(-1, n)
            miss = to < 0
            count[:, :n] += miss
            if several:
                cuts[j, :, :n] = miss
            again = self.starts[:, symbol]
            state[:, :n] = np.where(miss, np.where(again < 0, roots, again), to)
        place = np.empty(len(owner), np.int64)
        place[order] = np.arange(len(owner))
        out = count[:, place[first]] + (live[place[first]] > 0)
        for k in np.flatnonzero(np.array(lanes) > 1):
            mine = place[first[k] : first[k] + lanes[k]]
            for lang in range(len(self.names)):
                out[lang, k] += self._joined(lang, mine, grid, live, cuts, count, state)
        return out

    def _joined(self, lang: int, mine: np.ndarray, grid: np.ndarray, live: np.ndarray, cuts: np.ndarray, count: np.ndarray, ends: np.ndarray) -> int:
        """Phrases that start in the lanes of a text after its first one, each entered with the true state."""
        root, width, get, total = self.roots[lang], self.width, self.moves.get, 0
        state = int(ends[lang, mine[0]])
        for lane in mine[1:].tolist():
            seen = 0  # phrases that the lane's own parse has started so far
            for j in range(int(live[lane])):
                symbol, own = int(grid[j, lane]), bool(cuts[j, lang, lane])
                seen += own
                to = get(state * width + symbol)
                if to >= 0:
                    state = to
                    continue
                total += 1
                if own:  # both start a phrase here: the same from now on
                    total += int(count[lang, lane]) - seen
                    state = int(ends[lang, lane])
                    break
                to = get(root * width + symbol)
                state = root if to < 0 else to
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        coded = [(k, self.encode(t)) for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        bits, most = np.array(self.bits), BLOCK // len(self.names)
        while coded:
            take, size = 0, 0
            while take < len(coded) and (take == 0 or size + len(coded[take][1]) <= most):
                size += max(LANE, len(coded[take][1]))
                take += 1
            part, coded = coded[:take], coded[take:]
            counts = self.phrases([t for _, t in part])
            for column, (k, symbols) in enumerate(part):
                unseen = (self.starts[:, symbols] < 0).sum(1)
                cost = counts[:, column] * bits + unseen * np.log2(self.width)
                best = int(np.argmin(cost))
                # tempered, as phrases are not independent
                weights = np.exp(-(cost - cost[best]) / 8)
                out[k] = (self.names[best], float(1 / weights.sum()))
        return out


def suffix_automaton(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, symbol, to) of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    state = np.repeat(np.arange(len(step)), [len(moves) for moves in step])
    symbol = np.array([c for moves in step for c in moves], np.int64)
    to = np.array([t for moves in step for t in moves.values()], np.int64)
    return state, symbol, to


def parser_of(learned: list[tuple[str, str]]) -> Parser:
    """The parser of the samples, built once in each Python worker."""
    key = tuple(learned)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Parser(learned)
    return _automata[key]


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Per language, sorted by name, the bounded sample of its texts joined by line breaks."""
    use = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    use = use.filter((F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & (F.col("text") != ""))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "th")
    chosen = use.select("id", "lang", "th").withColumn("no", F.row_number().over(first)).filter(F.col("no") <= SAMPLE_DOCS)
    chosen = materialise(chosen, "langid-chosen")
    languages = max(1, chosen.select("lang").distinct().count())
    share = max(LEAST_CHARS, min(SAMPLE_CHARS, TOTAL_CHARS // languages))
    pieces = use.join(chosen.select("id", "th", "lang").distinct(), ["id", "th", "lang"]).select("id", "th", "lang", F.substring("text", 1, min(PIECE_CHARS, share)).alias("piece"))
    pieces = pieces.groupBy("lang", "id", "th").agg(F.first("piece").alias("piece"))
    by_no = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "th")
    before = F.coalesce(F.sum(F.length("piece")).over(by_no.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("no", F.row_number().over(by_no)).withColumn("room", F.lit(share) - before).filter("room > 0")
    got: dict[str, list[str]] = {}
    taken = pieces.select("lang", "no", F.substring(F.col("piece"), F.lit(1), F.col("room").cast("int")).alias("piece"))
    for r in taken.orderBy("lang", "no").collect():  # `share` characters per language
        got.setdefault(r["lang"], []).append(r["piece"])
    return [(name, "\n".join(texts)) for name, texts in sorted(got.items())]


def langid(docs: DataFrame, learned: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glyphspark.llm.langid import parser_of

        parser = parser_of(shared.value)
        for batch in batches:
            for off in range(0, batch.num_rows, STEP):
                part = batch.slice(off, STEP)
                found = parser.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {type_of(docs, id_col)}, lang_pred string, score double")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return langid(docs, samples(docs)).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")
