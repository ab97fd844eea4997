"""SimHash near-duplicates: 64-bit fingerprints that differ in at most three bits, found by tables of pivot distances.

A table holds a fingerprint's Hamming distances to 64 reference fingerprints (the rows of a Walsh matrix, which lie 32 bits
from one another and therefore tell different things). By the triangle inequality two fingerprints that differ in at most
three bits differ by at most three in every column, so the largest difference over the columns discards a pair without a look
at the fingerprints; survivors are verified by exact distance. Rows are sorted by the first column, which leaves a window of
partners; the next columns are compared as whole arrays, the rest only for pairs that are left.

Pairs are sought in cells that linked fingerprints must share: the 64 bits are cut into four runs, of which one at least is
equal, and each fingerprint is filed under its four (run, value). A cell with more than ``CROWD`` fingerprints is filed again,
its unequal bits cut into four once more, and so on until it is small or has so few free bits that it cannot be large. Cells
are dealt to buckets of about ``BUCKET`` filings; a bucket's table serves all of its cells. So no step grows with the square
of a family of near copies, and no pair is lost. A bucket gives a spanning forest of its links, not the links themselves.

Equal fingerprints are one node. Fingerprints with their smallest doc_id are aggregated before anything is compared, so a
family of exact copies costs one filing. Null and empty texts have fingerprint zero and are linked like all others; texts
under three words are one shingle; texts of any length are read whole, in runs of ``RUN`` shingles. Rows that share a doc_id
are rows of their own; null doc_ids count in no minimum, and a component without any other has a null component_id. An empty
table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import LOWER, by_batch, pick, table, utf8, written
from tickloom.llm.components import labels

SHINGLE, SEED = 3, 42
#: Fingerprints of a cell above which it is filed again; filings of a bucket; free bits below which a cell is never split.
CROWD, BUCKET, FREE = 2048, 4096, 11
#: Shingles counted at a time, rows of a bucket compared at a time.
RUN, ROWS = 1 << 14, 256
BITS = np.arange(64, dtype=np.uint64)
#: Reference fingerprints: bit c of row r is the parity of r & c.
PIVOTS = ((np.bitwise_count(BITS[:, None] & BITS[None, :]) & np.uint8(1)).astype(np.uint64) << BITS[None, :]).sum(1, dtype=np.uint64)
#: The columns in the order of use; row 0 is a plain count of bits.
STEPS = (slice(0, 4), slice(4, 16), slice(16, 64))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    total, n = np.zeros(64, np.int64), max(len(words) - SHINGLE + 1, 1)
    digest, grams = xxhash.xxh64_intdigest, iter(grams)
    for at in range(0, n, RUN):
        size = min(RUN, n - at)
        hashes = np.fromiter((digest(next(grams), SEED) for _ in range(size)), np.uint64, size)
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rows_of(_, ids: list, texts: list):
    own = {t: signed(fingerprint(t)) for t in set(texts)}
    for i, t in zip(ids, texts, strict=True):
        yield i, own[t]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row."""
    return by_batch(pick(docs, "doc_id", "text"), rows_of, "doc_id long, fp long", "doc_id", "text")


def finer(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in runs; ``mask`` with each of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:])]


def filed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """``fp, mask, cell`` for each finer mask; ``masks`` leads from a row's mask to its finer ones."""
    choice = F.create_map(*[x for old, new in masks.items() for x in (F.lit(signed(old)), F.array(*[F.lit(signed(m)) for m in new]))])
    out = rows.select("fp", F.explode(choice[F.col("mask")]).alias("mask"))
    return out.withColumn("cell", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "mask"))


def dealt(filings: DataFrame, count: int) -> DataFrame:
    """``bucket, fp``: cells to buckets."""
    return filings.select(F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-count // BUCKET)))).alias("bucket"), "fp")


def table_of(fps: np.ndarray) -> np.ndarray:
    """Distances to the pivots: one column for each."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :])


def close(distances: np.ndarray, bits: int) -> np.ndarray:
    """Whether unsigned bytes are differences of -bits to bits."""
    return (distances + np.uint8(bits)) <= 2 * bits


def linked_pairs(fps: np.ndarray, bits: int):
    """Pairs of rows of at most ``bits`` differing bits, block by block; ``fps`` are sorted by their first column."""
    columns = np.ascontiguousarray(table_of(fps).T)
    lead = columns[0].astype(np.int64)
    for at in range(0, len(fps), ROWS):
        end = min(at + ROWS, len(fps))
        stop = int(np.searchsorted(lead, lead[end - 1] + bits, "right"))
        alive = np.arange(at, stop)[None, :] > np.arange(at, end)[:, None]
        for c in range(STEPS[0].stop):
            alive &= close(columns[c, None, at:stop] - columns[c, at:end, None], bits)
        i, j = np.nonzero(alive)
        i, j = i + at, j + at
        for step in STEPS[1:]:
            keep = close(columns[step, j] - columns[step, i], bits).all(0)
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        yield i[keep], j[keep]


def joined(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of linked rows, in place: a row's root is the smallest of its tree."""
    while len(i):
        a, b = roots[i], roots[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def forest(bits: int):
    """A function over one bucket: each fingerprint with the first one of its tree, where that is another."""

    def run(part: pa.Table) -> pa.Table:
        fps = np.unique(part["fp"].to_numpy()).view(np.uint64)
        fps = fps[np.argsort(np.bitwise_count(fps ^ PIVOTS[0]), kind="stable")]
        roots = np.arange(len(fps))
        for i, j in linked_pairs(fps, bits):
            joined(roots, i, j)
        hung = np.flatnonzero(roots != np.arange(len(fps)))
        return pa.table({"a": fps[hung].view(np.int64), "b": fps[roots[hung]].view(np.int64)})

    return run


def links(kinds: DataFrame, bits: int = 3) -> DataFrame:
    """``a, b``: enough pairs of fingerprints (column ``fp``, distinct) to connect all that links connect."""
    count, parts = kinds.count() * (bits + 1), []
    masks = {0: finer(0, bits + 1)}
    rows = filed(kinds.select("fp", F.lit(0).cast("long").alias("mask")), masks)
    while True:
        open_ = [m for new in masks.values() for m in new if 64 - m.bit_count() > FREE]
        split = F.col("mask").isin([signed(m) for m in open_]) if open_ else F.lit(False)
        crowds = written(rows.filter(split).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("cell"), "crowds")
        if crowds.isEmpty():
            parts.append(dealt(rows, count))
            break
        parts.append(dealt(rows.join(crowds, "cell", "left_anti"), count))
        again = written(rows.join(crowds, "cell", "left_semi").select("fp", "mask"), "crowded")
        masks = {m: finer(m, bits + 1) for m in open_}
        count = again.count() * (bits + 1)
        rows = filed(again, masks)
    out = parts[0].withColumn("level", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.union(part.withColumn("level", F.lit(k)))
    return out.groupBy("level", "bucket").applyInArrow(forest(bits), "a long, b long")


def join(docs: DataFrame, bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; a component has the name of its smallest doc_id."""
    own = written(fingerprints(docs), "fingerprints")
    kinds = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    found = written(links(kinds, bits), "links")
    roots = labels(found)
    kinds = kinds.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = kinds.join(kinds.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """XXH64 over bytes in SQL: lanes of little-endian numbers from the hexadecimal text, products modulo 2**64."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    mod = "18446744073709551616::UHUGEINT"
    mul = lambda a, b: f"(({a}) * {b}::UHUGEINT % {mod})"
    add = lambda *x: f"(({' + '.join(x)}) % {mod})"
    rot = lambda a, r: f"({mul(a, 1 << r)} + ({a}) // {1 << (64 - r)}::UHUGEINT)"
    num = lambda at, size: "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"
    # Each step is a subquery column, so that an expression that uses a value twice does not repeat its whole history.
    v0 = [(42 + p1 + p2) % (1 << 64), (42 + p2) % (1 << 64), 42, (42 - p1) % (1 << 64)]
    stripe = lambda k: f"list_reduce(list_transform(range(n // 32), lambda s: {num(f'(32 * s + {8 * k})', 8)}), lambda acc, lane: {mul('list_transform([' + add('acc', mul('lane', p2)) + '], lambda y: ' + rot('y', 31) + ')[1]', p1)}, {v0[k]}::UHUGEINT)"
    rounded = lambda lane: mul(f"list_transform([{mul(lane, p2)}], lambda y: {rot('y', 31)})[1]", p1)
    merged = "h0"
    for k in range(4):
        merged = add(mul(f"xor({merged}, {rounded(f'v{k}')})", p1), f"{p4}::UHUGEINT")
    eights = f"list_reduce(list_transform(range((n % 32) // 8), lambda s: {num('(n // 32 * 32 + 8 * s)', 8)}), lambda acc, lane: {add(mul('list_transform([xor(acc, ' + rounded('lane') + ')], lambda y: ' + rot('y', 27) + ')[1]', p1), f'{p4}::UHUGEINT')}, h1)"
    four = f"CASE WHEN n % 8 >= 4 THEN {add(mul('list_transform([xor(h2, ' + mul(num('(n // 8 * 8)', 4), p1) + ')], lambda y: ' + rot('y', 23) + ')[1]', p2), f'{p3}::UHUGEINT')} ELSE h2 END"
    ones = f"list_reduce(list_transform(range(n % 4), lambda s: {num('(n // 4 * 4 + s)', 1)}), lambda acc, lane: {mul('list_transform([xor(acc, ' + mul('lane', p5) + ')], lambda y: ' + rot('y', 11) + ')[1]', p1)}, h3)"
    shift = lambda a, r: f"xor({a}, {a} // {1 << r}::UHUGEINT)"
    last = [mul(shift("h4", 33), p2), mul(shift("h5", 29), p3), shift("h6", 32)]
    vs = ", ".join(f"{stripe(k)} AS v{k}" for k in range(4))
    sums = ", ".join(f"sum((h >> {b}) & 1) AS s{b}" for b in range(64))
    bits = " + ".join(f"CASE WHEN 2 * s{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
x AS (SELECT g, hex(encode(g)) AS x, octet_length(encode(g)) AS n FROM (SELECT DISTINCT g FROM g)),
y AS (SELECT *, {vs} FROM x WHERE n >= 32),
z AS (SELECT g, x, n, {add(rot('v0', 1), rot('v1', 7), rot('v2', 12), rot('v3', 18))} AS h0, v0, v1, v2, v3 FROM y),
i1 AS (SELECT g, x, n, {add(merged, 'n::UHUGEINT')} AS h1 FROM z UNION ALL SELECT g, x, n, {add(f"{42 + p5}::UHUGEINT", 'n::UHUGEINT')} FROM x WHERE n < 32),
i2 AS (SELECT *, {eights} AS h2 FROM i1), i3 AS (SELECT *, {four} AS h3 FROM i2), i4 AS (SELECT *, {ones} AS h4 FROM i3),
i5 AS (SELECT g, {last[0]} AS h5 FROM i4), i6 AS (SELECT g, {last[1]} AS h6 FROM i5), hs AS MATERIALIZED (SELECT g, ({last[2]})::UBIGINT AS h FROM i6),
sums AS (SELECT r, count(*) AS n, {sums} FROM g JOIN hs USING (g) GROUP BY r),
fp AS MATERIALIZED (SELECT d.r, d.doc_id, coalesce(f, 0::UBIGINT) AS f FROM d LEFT JOIN (SELECT r, ({bits})::UBIGINT AS f FROM sums) USING (r)),
k AS MATERIALIZED (SELECT f, min(doc_id) AS least FROM fp GROUP BY f),
e AS MATERIALIZED (SELECT p.f AS a, q.f AS b FROM k p JOIN k q ON p.f <> q.f AND bit_count(xor(p.f, q.f)) <= 3),
t AS (SELECT f AS node, f AS root FROM k UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
c AS (SELECT node, min(least) AS component_id FROM t JOIN k ON k.f = t.root GROUP BY node)
SELECT fp.doc_id, printf('%016x', fp.f) AS fingerprint, c.component_id FROM fp JOIN c ON c.node = fp.f
"""


SQL = _sql()
