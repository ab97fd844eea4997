r"""Exact substring dedup by a logarithmic family of suffix arrays: every byte of a repeated 100-byte string but the first goes.

Stretches around anchors that occur twice (see ``stretches``) are routed by anchor, so each task keeps index families of its own
that see all strings that can be equal. Inside a family stretches come in document order, in batches. A new batch gets a suffix
array (its window starts, sorted by their next 100 bytes); merge-scans against the existing levels find those that occurred
before; what is new becomes a level, and levels of equal generation merge, so a family of b batches has at most log2(b) + 1
levels. A family holds about ``stretches.FLUSH`` windows: memory is bounded and families multiply with the data. Strings of crowded
anchors are counted as rows instead, with the first place of each.

Texts are UTF-8 bytes; a string must lie in one document. A string is removed if it also starts earlier: in a document of
smaller doc_id, or in the same one further left (equal ids: by a hash of the text; a row given twice counts once). Removal is
judged on the input and may cut a character, so remaining texts are bytes. Null texts are empty. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import BASE, mix, released, sha, table, utf8, written
from tickloom.llm.stretches import Scheme, candidates, judged, merged, numbered, with_spans, windows

DEPTH, GRAM = 100, 24
#: Windows in a batch. Small ones cost more scans: a numpy call works on few places.
BATCH = 1 << 15
OFFSETS = (*range(0, DEPTH - 8, 8), DEPTH - 8)
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def byte_values(_, text: str | None) -> np.ndarray:
    return BYTES[np.frombuffer(utf8(text), np.uint8)]


def byte_grams(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values, a multiple of 8, by doubling."""
    power = lambda k: np.uint64(pow(int(BASE), k, 1 << 64))
    out = values
    for have in (1, 2, 4):
        out = out[:-have] * power(have) + out[have:]
    n = len(values) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(0, size, 8):
        total = total * power(8) + out[k : k + n]
    return mix(total)


SCHEME = Scheme(DEPTH, GRAM, 1 << 16, lambda: None, byte_values, byte_grams, utf8, bytes, bytes, lone=False)


class Family:
    """Suffix arrays over one growing text; add() tells which suffixes of a batch occurred before."""

    def __init__(self) -> None:
        self.text = np.zeros(0, np.uint8)
        self.levels: list[tuple[int, np.ndarray]] = []

    def words(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The eight bytes at each place as one number that sorts like them."""
        view = np.ndarray((len(self.text) - 7,), ">u8", self.text.data, 0, (1,))
        return view[at + offset].astype(np.uint64)

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places by their next DEPTH bytes, equals by place; and for each whether it equals the one before."""
        key = self.words(at, 0)
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        for offset in OFFSETS[1:]:
            group = np.cumsum(new)
            tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))
            if not len(tied):
                break
            key = self.words(at[tied], offset)
            turn = np.lexsort((key, group[tied]))
            at[tied], key = at[tied][turn], key[turn]
            own = group[tied]
            new[tied] = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        return at, ~new

    def scan(self, level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places in order: where they go in the level, and whether their DEPTH bytes stand there already."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(level), np.int64)
        for k, offset in enumerate(OFFSETS):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            key = self.words(at[live], offset)
            if not k:
                have = self.words(level, 0)
                low[live], high[live] = np.searchsorted(have, key, "left"), np.searchsorted(have, key, "right")
                continue
            for right in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := np.flatnonzero(a < b)).size:
                    mid = (a[open_] + b[open_]) >> 1
                    have = self.words(level[mid], offset)
                    up = have <= key[open_] if right else have < key[open_]
                    a[open_[up]] = mid[up] + 1
                    b[open_[~up]] = mid[~up]
                if right:
                    high[live] = a
                else:
                    first = a
            low[live] = first
        return low, low < high

    def add(self, text: bytes, at: np.ndarray) -> np.ndarray:
        """Append a batch whose window starts are ``at``; True for those seen before, here or in earlier batches."""
        base = len(self.text)
        self.text = np.concatenate([self.text, np.frombuffer(text, np.uint8)])
        order, before = self.sort(at + base)
        for _, level in self.levels:
            rest = np.flatnonzero(~before)
            before[rest[self.scan(level, order[rest])[1]]] = True
        fresh, generation = order[~before], 0
        while self.levels and self.levels[-1][0] == generation:
            _, level = self.levels.pop()
            places, _ = self.scan(level, fresh)
            fresh, generation = np.insert(level, places, fresh), generation + 1
        self.levels.append((generation, fresh))
        seen = np.zeros(len(at), bool)
        seen[np.searchsorted(at, order - base)] = before
        return seen


def repeated(rows: list[dict]) -> list[list[tuple[int, int]]]:
    """For each piece, the bytes inside windows that also occur in an earlier piece or further left."""
    place = lambda i: (rows[i]["doc_id"], rows[i]["v"], rows[i]["start"], rows[i]["anchor"])
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    first: dict[tuple, int] = {}
    for i in range(len(rows)):
        if first.setdefault(place(i), i) != i:  # of a row given twice
            out[i] = out[first[place(i)]]
    order = [first[p] for p in sorted(first)]
    family, k = Family(), 0
    while k < len(order):
        own, size = [], 0
        while k < len(order) and (not own or size < BATCH):
            own.append(order[k])
            size += rows[order[k]]["n"]
            k += 1
        lengths = np.array([len(rows[i]["piece"]) for i in own], np.int64)
        counts = np.array([rows[i]["n"] for i in own], np.int64)
        begin = np.cumsum(lengths) - lengths
        first = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(own)), counts)
        inside = np.arange(len(of)) - first[of]
        seen = family.add(b"".join(rows[i]["piece"] for i in own), begin[of] + inside)
        of, inside = of[seen], inside[seen]
        cut = (of[1:] != of[:-1]) | (inside[1:] > inside[:-1] + DEPTH)  # windows that neither meet nor touch
        heads, tails = np.flatnonzero(np.concatenate([[True], cut])[: len(of)]), np.flatnonzero(np.concatenate([cut, [True]])[: len(of)])
        for j, a, b in zip(of[heads].tolist(), inside[heads].tolist(), inside[tails].tolist(), strict=True):
            out[own[j]].append((a, b + DEPTH))
    return out


def spans(rows: DataFrame) -> DataFrame:
    """(doc_id, v, a, b): ranges of bytes to remove; they may overlap."""
    occ, distinct, pieces = candidates(SCHEME, rows)
    crowded = windows(SCHEME, pieces)
    found = judged(pieces, repeated)
    firsts = found.select("doc_id", "v", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    if crowded is not None:
        at = F.col("start") + F.col("first")
        firsts = firsts.union(crowded.filter("struct(doc_id, v, start + first) <> least").select("doc_id", "v", at.alias("a"), (at + DEPTH).alias("b")))
    first = distinct.filter("copies > 1").select("anchor", "stretch", F.col("doc_id").alias("d1"), F.col("v").alias("v1"), F.col("start").alias("s1"))
    later = occ.join(first, ["anchor", "stretch"]).filter("doc_id <> d1 OR v <> v1 OR start <> s1")
    out = written(firsts.union(later.select("doc_id", "v", F.col("start").alias("a"), (F.col("start") + F.col("n") + DEPTH - 1).alias("b"))), "spans")
    released(occ, distinct, found)
    return out


def kept(text: str | None, found: list | None) -> tuple[bytes, int, int, int]:
    """(remaining bytes, number of bytes, number removed, number of removed runs)."""
    data = utf8(text)
    left, done, gone, runs = [], 0, 0, merged(found)
    for a, b in runs:
        left.append(data[done:a])
        done, gone = b, gone + b - a
    return b"".join([*left, data[done:]]), len(data), gone, len(runs)


def digests(_, keys: list, texts: list, found: list):
    for key, text, own in zip(keys, texts, found, strict=True):
        left, n, gone, runs = kept(text, own)
        yield key, n, gone, runs, sha(left)


def cleaned(_, keys: list, texts: list, found: list):
    for key, text, own in zip(keys, texts, found, strict=True):
        yield key, kept(text, own)[0]


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, data binary``: the remaining bytes of every text."""
    rows = numbered(docs)
    return with_spans(rows, spans(rows), cleaned, "doc_id long, data binary")


def report(docs: DataFrame) -> DataFrame:
    rows = numbered(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_spans(rows, spans(rows), digests, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(1, length(x) // 2 + 1)) AS k FROM d),
w AS (SELECT doc_id, k, substr(x, 2 * k - 1, 2) AS b, CASE WHEN 2 * k + 198 <= length(x) THEN md5(substr(x, 2 * k - 1, 200)) END AS h FROM p),
r AS (SELECT doc_id, k, b, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1 AS again FROM w),
g AS (SELECT doc_id, k, b, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone FROM r),
s AS (SELECT doc_id, k, b, gone, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM g),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, count(*) FILTER (gone = 1 AND before = 0) AS spans, string_agg(b, '' ORDER BY k) FILTER (gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
