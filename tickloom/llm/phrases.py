"""Substring dedup by repeated-phrase automata: every word inside a phrase of 35 words that recurs anywhere is removed.

Recurring passages are confirmed in two steps: stretches around anchors that occur twice (see ``stretches``), then, inside the
task that holds all stretches of an anchor, by counting their 35-word phrases over all documents. The confirmed passages of
each shard of anchors are compiled into an Aho-Corasick automaton over words (a word is one letter of the automaton): stretches
that recur whole as one key, and of the others each phrase that recurs. All stretches of the shard are streamed through it to
locate every occurrence. Shards hold about ``stretches.FLUSH`` phrases, so an automaton's size is bounded; a stretch meets the
one automaton that can contain its phrases, so work stays linear. Phrases of crowded anchors are counted as rows instead.

Words are runs of non-white characters, unchanged. Phrases are judged on the input; both copies go, in one document or two.
Null, empty and short texts have no phrase and stay as they are. A row given twice repeats all its phrases. Other columns are
not read.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import WordNumbers, grams, released, sha, table, utf8, written
from tickloom.llm.stretches import Scheme, candidates, joined, judged, merged, numbered, with_spans, windows

PHRASE, GRAM = 35, 8


def words(text: str | None) -> list[bytes]:
    return utf8(text).split()


SCHEME = Scheme(PHRASE, GRAM, 4 << 20, WordNumbers, lambda memory, text: memory.hash(words(text)), grams, words, b" ".join, lambda piece: piece.split(b" "))


def letters(rows: list[dict]) -> list[str]:
    """Each piece as a string with one character per word."""
    number: dict[bytes, int] = {}
    char = lambda i: chr(i + 1 if i < 0xD7FF else i + 0x801)  # noqa: E731  past the surrogates
    return ["".join([char(number.setdefault(w, len(number))) for w in row["piece"].split(b" ")]) for row in rows]


def located(rows: list[dict]) -> list[list[tuple[int, int]]]:
    """For each piece, the words inside phrases that recur."""
    pieces = letters(rows)
    counts: Counter = Counter()
    for row, text in zip(rows, pieces, strict=True):
        for i in range(len(text) - PHRASE + 1):
            counts[text[i : i + PHRASE]] += row["copies"]
    passages = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for row, text in zip(rows, pieces, strict=True):
        if row["copies"] > 1:
            passages.add_word(text)
            continue
        for i in range(len(text) - PHRASE + 1):
            if counts[phrase := text[i : i + PHRASE]] > 1:
                passages.add_word(phrase)
    if not len(passages):
        return [[] for _ in rows]
    passages.make_automaton()
    return [joined(sorted((end - size + 1, end + 1) for end, size in passages.iter(text))) for text in pieces]


def spans(rows: DataFrame) -> DataFrame:
    """(doc_id, v, a, b): ranges of words to remove; they may overlap."""
    occ, distinct, pieces = candidates(SCHEME, rows)
    crowded = windows(SCHEME, pieces)
    found = judged(pieces, located)
    marks = found.select("anchor", "stretch", "a", "b")
    if crowded is not None:
        marks = marks.union(crowded.select("anchor", "stretch", F.col("first").alias("a"), (F.col("first") + PHRASE).alias("b")))
    out = written(occ.join(marks, ["anchor", "stretch"]).select("doc_id", "v", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")), "spans")
    released(occ, distinct, found)
    return out


def kept(text: str | None, found: list | None) -> tuple[list[bytes], int, int]:
    """(remaining words, number of words, number removed)."""
    own = words(text)
    if not found:
        return own, len(own), 0
    stay = np.ones(len(own), bool)
    for a, b in merged(found):
        stay[a:b] = False
    return [w for w, s in zip(own, stay.tolist(), strict=True) if s], len(own), int(len(own) - stay.sum())


def digests(_, keys: list, texts: list, found: list):
    for key, text, own in zip(keys, texts, found, strict=True):
        left, n, gone = kept(text, own)
        yield key, n, gone, sha(b" ".join(left))


def cleaned(_, keys: list, texts: list, found: list):
    for key, text, own in zip(keys, texts, found, strict=True):
        yield key, b" ".join(kept(text, own)[0]).decode("utf-8") if own else text


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: texts without recurring phrases; texts without any are unchanged."""
    rows = numbered(docs)
    return with_spans(rows, spans(rows), cleaned, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    rows = numbered(docs)
    return with_spans(rows, spans(rows), digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, k, md5(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
m AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS k FROM p JOIN m USING (h)),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.k) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.r = g.r AND x.k = g.k GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
