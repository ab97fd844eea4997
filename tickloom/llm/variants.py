"""Spelling variants: words one insertion, deletion or replacement apart, each led to its most frequent near word.

Words are compared through a bit-sliced position index. For words of lengths l and l + 1 it holds, for every position and
letter, the set of words with this letter there, one bit a word. The words of length l are looked up in it all at once, and
their three sets advance letter by letter with word-wide operations:

    exact    words equal so far
    replaced words with one error so far at the same position   (replaced & same) | (exact & ~same)
    shifted  words that hold one letter more so far             (shifted | exact) & next

where ``same`` is the index's set for the letter at this position and ``next`` that for the position after it. At the end
``replaced`` gives the near words of the same length and ``shifted | exact`` those that are one letter longer. Sets of only
one position live at a time, so memory depends on the number of words, not on their length.

No index holds the whole vocabulary. A word of length L is filed in the classes l = L and l = L - 1; in a class two near words
share the first l // 2 letters or the last l - l // 2. A cell is a class with a shared beginning and end. A cell of more than
``CROWD`` words is filed again, its free middle cut in two the same way, until it is small or its middle has one letter; there
the alphabet bounds it. A cell that goes on with the ending takes only pairs whose common beginning is shorter than what its
sister asks for, so each pair is found in exactly one cell. Cells are dealt to buckets of about ``BUCKET`` filings or
``BUCKET_BYTES``; a bucket gives each of its words a count and the best near word, not pairs.

Words come from whole texts: a task counts in a table of at most ``HELD`` words and hands it on when full, so hot words are
summed before the shuffle. A null text has no words; a null doc_id is spelled as an empty one. Rows given twice count twice;
rows that share a doc_id count each. Among near words of the same frequency the smallest in code-point order is the form. An
empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import LOWER, pick, table, utf8, written

RUNS = "[A-Za-zÀ-ÿ]"
#: Words of a cell above which it is filed again; filings and bytes of a bucket; words that a task counts at a time.
CROWD, BUCKET, BUCKET_BYTES, HELD = 4096, 8192, 8 << 20, 200_000
#: 64-bit words of one set of bits times words looked up at a time.
STEP = 1 << 18


def slipped(counts: Counter, key, text: str | None, pattern: re.Pattern, least: int, slip: int) -> None:
    """Adds a text's words. If ``slip`` divides the CRC of (document, word), the word loses a letter in this document."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in Counter(pattern.findall(utf8(text).translate(LOWER).decode())).items():
        if slip:
            h = zlib.crc32(run.encode(), start)
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
        counts[run] += n


def vocabulary(docs: DataFrame, least: int = 6, often: int = 5, slip: int = 0) -> DataFrame:
    """``word, n``: lower-cased (A-Z) runs of at least ``least`` letters that occur at least ``often`` times."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(batches):
        pattern, counts = re.compile(f"{RUNS}{{{least},}}"), Counter()

        def drained():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for at in range(batch.num_rows):
                slipped(counts, batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), pattern, least, slip)
                if len(counts) >= HELD:
                    yield drained()
        yield drained()

    parts = pick(docs, "doc_id", "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


#: l: the class; a, c: letters of the shared beginning and end; stop: pairs with a longer common beginning are found elsewhere.
PLACE = "struct<l:int,a:int,c:int,stop:int>"


def children(rows: DataFrame) -> DataFrame:
    """Each filing (word, n, p) in the two finer cells of its cell."""
    p = F.col("p")
    free = p["l"] - p["a"] - p["c"]
    half = F.floor(free / 2).cast("int")
    place = lambda a, c, stop: F.struct(p["l"].alias("l"), a.alias("a"), c.alias("c"), stop.alias("stop")).cast(PLACE)
    both = F.array(place(p["a"] + half, p["c"], p["stop"]), place(p["a"], p["c"] + free - half, p["a"] + half))
    return celled(rows.select("word", "n", F.explode(both).alias("p")))


def celled(rows: DataFrame) -> DataFrame:
    p, word = F.col("p"), F.col("word")
    end = F.when(p["c"] > 0, F.expr("right(word, p.c)")).otherwise("")
    return rows.withColumn("cell", F.xxhash64(p["l"], p["a"], p["c"], p["stop"], F.substring(word, F.lit(1), p["a"]), end))


def classes(words: DataFrame) -> DataFrame:
    """Each word as the shorter and as the longer one of its pairs."""
    place = lambda n: F.struct(n.alias("l"), F.lit(0).alias("a"), F.lit(0).alias("c"), (n + 1).alias("stop")).cast(PLACE)
    size = F.char_length("word")
    return words.select("word", "n", F.explode(F.array(place(size), place(size - 1))).alias("p"))


def bits_of(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    wide = np.zeros((len(rows), -(-rows.shape[1] // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8")


class Slice:
    """The index's sets of one position: a row of bits for each letter, and an empty row for all others."""

    def __init__(self, letters: np.ndarray):
        self.letters, at = np.unique(letters, return_inverse=True)
        rows = np.zeros((len(self.letters) + 1, len(letters)), bool)
        rows[at, np.arange(len(letters))] = letters > 0
        self.rows = bits_of(rows)

    def sets(self, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, wanted).clip(max=len(self.letters) - 1)
        return self.rows[np.where(self.letters[at] == wanted, at, len(self.letters))]


def matrix(words: list[str], width: int) -> np.ndarray:
    """Code points, one row for each word, filled up with zeros."""
    out = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def near_pairs(words: list[str], size: int, start: int, stop: int):
    """(shorter or equal, other) rows of near words, the first of ``size`` letters, the other of as many or one more.

    Only pairs whose common beginning has at least ``start`` and fewer than ``stop`` letters; pairs of equal length both ways.
    """
    letters = matrix(words, size + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    equal, longer = (bits_of((sizes == k)[None, :]) for k in (size, size + 1))
    ask = np.flatnonzero(sizes == size)
    width = equal.shape[1]
    step = max(1, STEP // width)
    for at in range(0, len(ask), step):
        own = ask[at : at + step]
        exact = np.repeat(equal | longer, len(own), axis=0)
        replaced, shifted, begun = np.zeros_like(exact), np.zeros_like(exact), exact.copy()
        ended = np.zeros_like(exact)
        index = Slice(letters[:, 0])
        for j in range(size):
            if j == start:
                begun = exact.copy()
            if j == stop:
                ended = exact.copy()
            after = Slice(letters[:, j + 1])
            same, next_ = index.sets(letters[own, j]), after.sets(letters[own, j])
            shifted = (shifted | exact) & next_
            replaced = (replaced & same) | (exact & ~same)
            exact = exact & same
            index = after
        if start >= size:
            begun = exact
        if stop == size:
            ended = exact
        found = ((replaced & equal) | ((shifted | exact) & longer)) & begun & ~ended
        q, w = np.nonzero(found)
        if len(q):
            bits = np.unpackbits(found[q, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, b = np.nonzero(bits)
            yield own[q[k]], w[k] * 64 + b


NEAR = "word string, near long, form string, form_n long"


def looked_up(part: pa.Table) -> pa.Table:
    """One bucket: for each word with near words there, their number and the most frequent one."""
    own: dict[tuple, dict[str, int]] = {}
    for word, n, l, a, stop in zip(*(part[c].to_pylist() for c in ("word", "n", "l", "a", "stop")), strict=True):  # noqa: E741
        own.setdefault((l, a, stop), {})[word] = n
    out: dict[str, tuple[int, int, str]] = {}
    for (size, start, stop), counts in own.items():
        if len(counts) < 2:
            continue
        words = sorted(counts)
        n = np.array([counts[w] for w in words], np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for q, v in near_pairs(words, size, start, stop):
            back = sizes[v] > size  # a longer word is never looked up itself
            x, y = np.concatenate([q, v[back]]), np.concatenate([v, q[back]])
            order = np.lexsort((y, -n[y], x))
            x, y = x[order], y[order]
            heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            for i, j, count in zip(x[heads].tolist(), y[heads].tolist(), np.diff(np.append(heads, len(x))).tolist(), strict=True):
                before = out.get(words[i])
                here = (-counts[words[j]], words[j])
                best = here if before is None else min(here, before[1:])
                out[words[i]] = (count + (before[0] if before else 0), *best)
    return pa.table({"word": pa.array(list(out), pa.string()), "near": pa.array([x[0] for x in out.values()], pa.int64()), "form": pa.array([x[2] for x in out.values()], pa.string()), "form_n": pa.array([-x[1] for x in out.values()], pa.int64())})


def dealt(filings: DataFrame, level: int) -> DataFrame:
    """``level, bucket`` and what a bucket needs of its filings."""
    rows, size = filings.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    buckets = max(1, -(-rows // BUCKET), -(-size // BUCKET_BYTES))
    return filings.select(F.lit(level).alias("level"), F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("bucket"), "word", "n", F.col("p.l").alias("l"), F.col("p.a").alias("a"), F.col("p.stop").alias("stop"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n``: the number of near words and the most frequent one, for words that have any."""
    rows, out, level = children(classes(words)), None, 0
    while True:
        splits = F.col("p.l") - F.col("p.a") - F.col("p.c") > 1
        crowds = written(rows.filter(splits).groupBy("cell").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select("cell"), "crowds")
        last = crowds.isEmpty()
        part = dealt(rows if last else rows.join(crowds, "cell", "left_anti"), level)
        out = part if out is None else out.union(part)
        if last:
            break
        rows = children(written(rows.join(crowds, "cell", "left_semi").select("word", "n", "p"), "crowded"))
        level += 1
    found = out.groupBy("level", "bucket").applyInArrow(looked_up, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that forms (word, form) lead to; each round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at, before = written(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots"), at
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def grouped(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary (word, n).

    A word's form is its most frequent near word, if that is at least ``ratio`` times as frequent as the word itself.
    """
    words = written(words.select("word", "n"), "words")
    led = F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))
    near = written(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n")), "near")
    ends = roots(near.filter("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(table(spark, sf_dir, "documents"), slip=199))


SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_transform(range(4 * length(x)), lambda k: ((('0x' || substr(x, k // 8 * 2 + 1, 2))::UBIGINT >> (k % 8)) & 1)::UBIGINT),
    lambda acc, bit: xor(acc >> 1, (xor(acc, bit) & 1) * 3988292384::UBIGINT), 4294967295::UBIGINT)) AS h FROM c),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT w.word, d.word FROM w JOIN d ON d.rest = w.word UNION SELECT d.word, w.word FROM w JOIN d ON d.rest = w.word),
k AS (SELECT a, count(*) AS n_near, min(struct_pack(o := -w.n, b := b)) AS best FROM p JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -best.o >= 5 * n THEN best.b END AS form, CASE WHEN -best.o >= 5 * n THEN -best.o END AS form_n FROM w LEFT JOIN k ON k.a = w.word),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL) t ON t.word = f.word
"""
