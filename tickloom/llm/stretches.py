"""Candidate stretches for finding repeated windows, shared by the two substring operators.

A document is a sequence of values (words or bytes). Every window of ``window`` values picks an anchor: the run of ``gram``
values inside it with the smallest hash, the leftmost of equals. Equal windows pick equal anchors, and neighbouring windows
mostly share theirs, so a document falls into stretches of consecutive windows with one anchor, about one for every
(window - gram) / 2 values. A window that is repeated anywhere lies in stretches whose anchor occurs at least twice:

    entries   (anchor, stretch, document, start, windows)   one row per stretch, computed in place
    repeated  anchors that occur twice or more              partial counts before the shuffle
    occ       entries of repeated anchors                   a join that Spark can split at hot anchors
    distinct  one row per different stretch                 copies cost one row here, however many there are
    pieces    values of the distinct stretches alone        routed to tasks by anchor
                                                             (suffixes leave out those that are alone with their anchor)
    windows   the windows of crowded anchors' pieces        one row per different window after partial counts

Texts meet their stretches, and later their ranges, in shares of the documents (``common.SHARES``), one after the other; tables
are deleted after their last use. So no shuffle holds all texts.

A task that judges pieces sees all windows that can equal one another together. An anchor with more than ``CROWD`` distinct
stretches (a common passage in ever new surroundings) is judged window by window instead: equal windows, named by 128-bit
hashes, are counted with partial aggregation, and the counts are joined back to the windows, a join that Spark can split at hot
windows. Counts and order refer to all documents; nothing is sampled, capped or dropped.

A document is known by its doc_id and a hash of its text. Rows that share both are one document given twice; rows that share
the id alone are documents of their own. A null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tickloom.llm.common import BASE, by_batch, mix, pick, released, text_bytes, utf8, written, written_by_shares

CROWD = 2_000
LAST = (1 << 63) - 1
ENTRY = "anchor long, stretch long, doc_id long, v long, start int, n int"
PIECE = "anchor long, stretch long, copies long, doc_id long, v long, start int, n int, crowded boolean, piece binary"
WINDOW = "h1 long, h2 long, anchor long, stretch long, copies long, doc_id long, v long, start int, first int"
#: Windows that a task judges at once.
FLUSH = 40_000
#: Bytes of crowded pieces whose windows are made at once; there are some fifty times as many.
WINDOWS_OF = 128 << 10
#: Stretches that go to the JVM at once.
ROWS = 1 << 14


@dataclass(frozen=True)
class Scheme:
    """``values(memory, text)`` hashes a text's values; ``cut(text)`` gives them as something that can be sliced; ``join`` makes bytes
    of a slice and ``split`` a slice of these.

    ``chunk_bytes``: texts whose stretches are found at once; arrays beyond a core's cache take twice the time. ``lone``: whether the
    one stretch of an anchor that has no other is judged. Its windows differ from one another, as equal ones have their anchor at an
    equal distance; so they occur again only where the whole stretch does.
    """

    window: int
    gram: int
    chunk_bytes: int
    memory: Callable
    values: Callable
    anchors: Callable
    cut: Callable
    join: Callable
    split: Callable
    lone: bool = True


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    out, step = values, 1
    while step * 2 <= size:
        out, step = np.minimum(out[:-step], out[step:]), step * 2
    n = len(values) - size + 1
    return np.minimum(out[:n], out[size - step : size - step + n]) if n > 0 else values[:0]


def inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


POWERS: dict[int, np.ndarray] = {}


def powers_of(x: int, n: int) -> np.ndarray:
    """The first ``n`` powers of x modulo 2**64; a worker keeps them for the next texts."""
    known = POWERS.get(x)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 17), x, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 1 << 20:  # a huge text's are not kept
            POWERS[x] = known
    return known[:n]


def stretches(scheme: Scheme, memory, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(document number, start, windows, anchor, content hash) of every stretch."""
    parts = [scheme.values(memory, t) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = len(values) - scheme.window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = scheme.anchors(values, scheme.gram)
    order = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_least(order, scheme.window - scheme.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    stops = np.cumsum(sizes)
    windows = np.arange(n)
    windows = windows[windows + scheme.window <= np.repeat(stops, sizes)[:n]]
    if not len(windows):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    own = at[windows]
    heads = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    start, count = windows[heads], np.diff(np.append(heads, len(windows)))
    powers, back = powers_of(int(BASE), len(values)), powers_of(inverse(int(BASE)), len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers, dtype=np.uint64)])
    stop = start + count + scheme.window - 1
    content = mix((sums[stop] - sums[start]) * back[start] + mix(count.astype(np.uint64) << np.uint64(20) | (own[heads] - start).astype(np.uint64)))
    document = np.searchsorted(stops, start, "right")
    return document, start - (stops - sizes)[document], count, hashes[own[heads]], content


def entries(scheme: Scheme, docs: DataFrame) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(ENTRY))

    def run(batches):
        memory, held, size = scheme.memory(), [], 0
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * scheme.chunk_bytes / max(batch.nbytes, 1))))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                ids, marks = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                document, start, count, anchor, content = stretches(scheme, memory, part.column(2).to_pylist())
                held.append((anchor.view(np.int64), content.view(np.int64), ids[document], marks[document], start.astype(np.int32), count.astype(np.int32)))
                size += len(document)
                if size >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=arrow)
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=arrow)

    return docs.mapInArrow(run, ENTRY)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id (null as LAST), v, text; ``volume`` tells the bytes of the texts."""
    rows = pick(docs, "doc_id", "text")
    out = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"), "text")
    out.volume = text_bytes(rows)
    return out


def pieces_of(scheme: Scheme, _, keys: list, marks: list, texts: list, wanted: list):
    for key, mark, text, own in zip(keys, marks, texts, wanted, strict=True):
        values = scheme.cut(text)
        for s in own:
            a, n = s["start"], s["n"]
            yield s["anchor"], s["stretch"], s["copies"], key, mark, a, n, s["crowded"], scheme.join(values[a : a + n + scheme.window - 1])


def windows_of(scheme: Scheme, memory, *columns: list):
    for anchor, stretch, copies, key, mark, start, n, piece in zip(*columns, strict=True):
        values = scheme.split(piece)
        for i in range(n):
            yield *memory(scheme.join(values[i : i + scheme.window])), anchor, stretch, copies, key, mark, start, i


def window_hash():
    import xxhash

    def halves(window: bytes) -> tuple[int, int]:
        high, low = divmod(xxhash.xxh3_128_intdigest(window), 1 << 64)
        return high - (1 << 63), low - (1 << 63)

    return halves


def texts_of(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """The documents in which the stretches stand first, with the list of these."""
    wanted = distinct.groupBy("doc_id", "v").agg(F.collect_list(F.struct("anchor", "stretch", "copies", "start", "n", "crowded")).alias("wanted"))
    return rows.join(wanted, ["doc_id", "v"])


def windows(scheme: Scheme, pieces: DataFrame) -> DataFrame | None:
    """The windows of crowded anchors that occur twice or more: anchor, stretch, doc_id, v, start, first (window of the stretch),
    and the least (doc_id, v, start) at which an equal window stands. None if no anchor is crowded. Made before the pieces are judged."""
    from functools import partial

    if pieces.crowded.isEmpty():
        return None
    columns = ("anchor", "stretch", "copies", "doc_id", "v", "start", "n", "piece")
    each = written(by_batch(pieces.crowded, partial(windows_of, scheme), WINDOW, *columns, ready=window_hash, chunk_bytes=WINDOWS_OF), "windows")
    place = F.struct("doc_id", "v", (F.col("start") + F.col("first")).alias("start"))
    kinds = each.groupBy("h1", "h2").agg(F.sum("copies").alias("_n"), F.min(place).alias("least")).filter("_n > 1")
    return each.join(written(kinds.select("h1", "h2", "least"), "recurring"), ["h1", "h2"]).select("anchor", "stretch", "doc_id", "v", "start", "first", "least")


def candidates(scheme: Scheme, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occ, distinct, pieces), all of them tables; pieces are those of anchors that are not crowded and, where ``scheme`` says so, have two or more.

    ``pieces.crowded`` are those of crowded anchors, out of the same table.
    """
    from functools import partial

    # A table, so that both sides of the join are plain exchanges and Spark can split a hot anchor.
    repeated = written(entries(scheme, rows).groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor"), "anchors")
    occ = written(entries(scheme, rows).join(repeated, "anchor"), "occurrences")
    released(repeated)
    kinds = occ.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "v", "start")).alias("first"), F.min("n").alias("n"))
    crowds = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_k"))
    distinct = written(kinds.join(crowds, "anchor").select("anchor", "stretch", "copies", "first.doc_id", "first.v", "first.start", "n", (F.col("_k") > CROWD).alias("crowded"), (F.col("_k") == 1).alias("lone")), "stretches")
    wanted = distinct if scheme.lone else distinct.filter("NOT lone")
    own = lambda share: by_batch(texts_of(rows.filter(share), wanted.filter(share)), partial(pieces_of, scheme), PIECE, "doc_id", "v", "text", "wanted")
    cut = written_by_shares(rows.sparkSession, own, rows.volume, "pieces")
    pieces = cut.filter("NOT crowded").drop("crowded")
    pieces.table_path, pieces.crowded = cut.table_path, cut.filter("crowded").drop("crowded")
    return occ, distinct, pieces


SPAN = "anchor long, stretch long, doc_id long, v long, start int, a int, b int"


def judged(pieces: DataFrame, judge: Callable[[list[dict]], list[list[tuple[int, int]]]]) -> DataFrame:
    """Values, relative to the stretch's start, that ``judge`` marks: it gets all pieces of an anchor, in document order, and names
    ranges of each. The table of pieces goes."""

    def run(batches):
        def flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            out = []
            for row, found in zip(rows, judge(rows), strict=True):
                for a, b in found:
                    out.append((row["anchor"], row["stretch"], row["doc_id"], row["v"], row["start"], a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        held, size, last = [], 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                for row in batch.slice(k, 2048).to_pylist():
                    if row["anchor"] != last and size >= FLUSH:
                        yield from flush(held)
                        held, size = [], 0
                    last = row["anchor"]
                    held.append(row)
                    size += row["n"]
        if held:
            yield from flush(held)

    arrow = to_arrow_schema(_parse_datatype_string(SPAN))
    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "v", "start")
    marks = written(dealt.mapInArrow(run, SPAN), "marks")
    released(pieces)
    return marks


def joined(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in ascending order of start, merged where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def with_spans(rows: DataFrame, spans: DataFrame, made: Callable, schema: str) -> DataFrame:
    """What ``made`` gets out of each document's (doc_id, text, list of its removed ranges); the table of ranges (doc_id, v, a, b) goes.

    A range is packed into one number, a fifth of a struct's bytes in the shuffle.
    """

    def own(share):
        packed = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
        per = spans.filter(share).groupBy("doc_id", "v").agg(F.collect_list(packed).alias("spans"))
        each = rows.filter(share).join(per, ["doc_id", "v"], "left").withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))
        return by_batch(each, made, schema, "doc_id", "text", "spans")

    out = written_by_shares(rows.sparkSession, own, rows.volume, "cleaned")
    released(spans)
    return out


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Packed ranges in ascending order of start, merged where they touch."""
    if not spans:
        return []
    packed = np.sort(np.array(spans, np.int64))
    start, stop = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    cut = start[1:] > stop[:-1]
    return list(zip(start[np.concatenate([[True], cut])].tolist(), stop[np.concatenate([cut, [True]])].tolist(), strict=True))
