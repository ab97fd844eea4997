"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``SHARD_WORDS`` words inside one input partition, so nothing is shuffled. Its words
become symbols, its suffixes are sorted (prefix doubling that goes on only where suffixes are still tied), and the index
keeps the Burrows-Wheeler transform as a wavelet matrix, symbol totals and every ``SAMPLE``-th suffix position. All test
windows go through backward search at once, one word a step, by wavelet ranks; occurrences are located by walking to the
next sampled position; overlapping windows merge into removal spans.

Windows are the 10-word windows of the benchmark items (shorter items: the whole item). They are sent to the tasks in blocks
of at most ``BLOCK_WINDOWS``; a larger benchmark takes several passes, each adding to the spans found so far.

Null and empty texts have no words, an item without words no window. A null item id marks its hits but is not listed.
Repeated documents are reported each; repeated items count once. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import ALNUM_LOWER, DOCUMENT, by_batch, pick, table, utf8, written

WINDOW = 10
SHARD_WORDS, SHARD_BYTES, SAMPLE = 1 << 19, 4 << 20, 16
BLOCK_WINDOWS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM_LOWER).split()


def suffix_array(symbols: np.ndarray, count: int) -> np.ndarray:
    """Start positions of all suffixes in order; symbols lie in 1..count and the end sorts before everything."""
    n = len(symbols)
    bits = max(1, int(count).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(h, np.int64)])
    for k in range(h):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + 1, np.int64)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads, sizes) + 1
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(tied):
        at = order[tied]
        first = rank[at]
        both = first << 32 | rank[np.minimum(at + h, n)]
        turn = np.argsort(both, kind="stable")
        at, both = at[turn], both[turn]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = both[1:] != both[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(tied)))
        rank[at] = np.repeat(tied[heads], sizes) + 1
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[Bits, int]] = []
        for level in range(bits - 1, -1, -1):
            up = (values >> level & 1).astype(bool)
            self.levels.append((Bits(up), int(len(values) - up.sum())))
            values = np.concatenate([values[~up], values[up]])

    def down(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Each place followed through the levels along its symbol's bits."""
        out = list(places)
        for k, (bits, zeros) in enumerate(self.levels):
            up = (symbol >> (len(self.levels) - 1 - k) & 1).astype(bool)
            for j, p in enumerate(out):
                ones = bits.ones(p)
                out[j] = np.where(up, zeros + ones, p - ones)
        return out

    def read(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where the place ends after the last level."""
        symbol = np.zeros(len(place), np.int64)
        for bits, zeros in self.levels:
            up, ones = bits.at(place), bits.ones(place)
            symbol = symbol << 1 | up
            place = np.where(up, zeros + ones, place - ones)
        return symbol, place


class FmIndex:
    """Counts and locates symbol sequences in one sequence of symbols 1..count."""

    def __init__(self, symbols: np.ndarray, count: int):
        text = np.concatenate([symbols, [0]])  # 0 ends it
        order = np.concatenate([[len(symbols)], suffix_array(symbols, count)])
        last = text[order - 1]
        self.n, bits = len(text), max(1, int(count).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=count + 1))])
        self.matrix = WaveletMatrix(last, bits)
        self.origin = self.matrix.down(np.arange(count + 1), np.zeros(count + 1, np.int64))[0]
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def count(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of right-aligned patterns (rows of symbols)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((sizes > k) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - k]
            a, b = self.matrix.down(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a - self.origin[symbol], self.first[symbol] + b - self.origin[symbol]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        where, steps, open_ = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            done = self.sampled.at(at)
            ended = open_[done]
            where[ended] = self.samples[self.sampled.ones(at[done])] + steps[ended]
            open_ = open_[~done]
            symbol, place = self.matrix.read(rows[open_])
            rows[open_] = self.first[symbol] + place - self.origin[symbol]
            steps[open_] += 1
        return where


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers in [low, high) of each row, and the row of each."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return low[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of


def search(texts: list[list[bytes]], windows: list[tuple[bytes, ...]]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """For each list of words: merged spans of windows that occur, and the windows' numbers."""
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number) + 2) for words in texts for w in [*words, b""]]  # b"" keeps documents apart
    symbols = np.array(flat, np.int64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[list[int]] = [[] for _ in texts]
    known = [k for k, w in enumerate(windows) if all(x in number for x in w)]
    if not known:
        return spans, found
    width = max(len(windows[k]) for k in known)
    patterns = np.array([[0] * (width - len(windows[k])) + [number[x] for x in windows[k]] for k in known], np.int64)
    lengths = np.array([len(windows[k]) for k in known], np.int64)
    index = FmIndex(symbols, len(number) + 1)
    low, high = index.count(patterns, lengths)
    rows, of = ranges(low, np.maximum(low, high))
    if not len(rows):
        return spans, found
    at = index.locate(rows)
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + lengths[of], -1)
    hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    document = np.searchsorted(starts, edges[::2], "right") - 1
    for d, a, b in zip(document.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    pairs = np.unique((np.searchsorted(starts, at, "right") - 1) * len(known) + of)
    for p in pairs.tolist():
        found[p // len(known)].append(known[p % len(known)])
    return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(carried: int, block: tuple[list, list], keys: list, texts: list, *more: list):
    """One chunk of documents, cut into shards; equal texts of a shard are indexed once."""
    windows, items = block
    carry, earlier = more[:carried], more[carried:]
    shard: dict[str | None, list[int]] = {}
    words: list[list[bytes]] = []
    size = 0
    for i in range(len(keys) + 1):
        if i == len(keys) or size > SHARD_WORDS:
            for (text, own), spans, found in zip(shard.items(), *search(words, windows), strict=True):
                ids = sorted({x for k in found for x in items[k]})
                for j in own:
                    both = merged([*spans, *((s["start"], s["stop"]) for s in earlier[0][j])]) if earlier else spans
                    yield keys[j], text, len(words[list_at[text]]), [{"start": a, "stop": b} for a, b in both], sorted({*ids, *earlier[1][j]}) if earlier else ids, *(c[j] for c in carry)
            shard, words, size = {}, [], 0
            if i == len(keys):
                return
        if not size and not words:
            list_at: dict[str | None, int] = {}
        if texts[i] not in shard:
            list_at[texts[i]] = len(words)
            words.append(words_of(texts[i]))
            size += len(words[-1])
        shard.setdefault(texts[i], []).append(i)


def item_windows(_, ids: list, texts: list):
    for item, text in zip(ids, texts, strict=True):
        words = words_of(text)
        for k in range(max(1, len(words) - WINDOW + 1) if words else 0):
            yield item, b" ".join(words[k : k + WINDOW]).decode("utf-8")


FOUND = "doc_id long, text string, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, carry: str = "") -> DataFrame:
    """For every document: ``n_words``, merged ``spans`` of its words inside any test window, and the ``items`` they are of.

    ``carry`` declares further columns ("name type, ...") that come along unchanged.
    """
    return passes(docs, benchmark, carry, scan, FOUND + (f", {carry}" if carry else ""))


def passes(docs: DataFrame, benchmark: DataFrame, carry: str, last: Callable, schema: str) -> DataFrame:
    """The documents against all blocks of windows; ``last`` does the last pass in place of ``scan`` and makes rows of ``schema``."""
    spark = docs.sparkSession
    rows = pick(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("string"))
    tests = by_batch(rows, item_windows, "item string, window string", "item_id", "text").distinct()
    blocks = max(1, -(-tests.count() // BLOCK_WINDOWS))
    others = [c.split()[0] for c in carry.split(",") if c]
    out = pick(docs, "doc_id", "text", *others)
    for b in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()  # of bounded size
        of: dict[str, list[str]] = {}
        for r in sorted(own, key=lambda r: (r["window"], r["item"] or "")):
            of.setdefault(r["window"], []).extend([r["item"]] if r["item"] is not None else [])
        shipped = spark.sparkContext.broadcast(([tuple(w.encode("utf-8").split()) for w in of], list(of.values())))
        columns = ["doc_id", "text", *others] + (["spans", "items"] if b else [])
        step, made = (last, schema) if b + 1 == blocks else (scan, FOUND + (f", {carry}" if carry else ""))
        out = by_batch(out, partial(step, len(others)), made, *columns, ready=lambda shipped=shipped: shipped.value, chunk_bytes=SHARD_BYTES)
        if b + 1 < blocks:
            out = written(out, "decontaminated")
    return out


def cut(text: str, spans: list[dict]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    data = utf8(text)
    word = np.concatenate([[False], np.frombuffer(data.translate(ALNUM_LOWER), np.uint8) != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edges[::2], edges[1::2]
    left, done = [], 0
    for s in spans:
        left.append(data[done : starts[s["start"]]])
        done = int(stops[s["stop"] - 1])
    return b"".join([*left, data[done:]]).decode("utf-8")


def cleaned(carried: int, block: tuple[list, list], *columns: list):
    """As ``scan``, but yields documents: in the same worker, so that texts cross to Python once and a task has one worker."""
    for key, text, n, spans, _, lang, source, size in scan(carried, block, *columns):
        if n and sum(s["stop"] - s["start"] for s in spans) == n:
            continue
        new = cut(text, spans) if spans else text
        yield key, new, lang, source, size if new == text or new is None else len(new)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without their spans; those of which no word is left go."""
    return passes(docs, benchmark, "lang string, source string, n_chars long", cleaned, DOCUMENT)


def report(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, x AS size, array_to_string(w[k:k + x - 1], ' ') AS window FROM (SELECT item_id, w, least(len(w), 10) AS x, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM t),
p AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS window FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s WHERE len(w) >= size)),
h AS (SELECT DISTINCT r, k, p.size, item_id FROM p JOIN t ON p.window = t.window AND p.size = t.size),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS k FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
