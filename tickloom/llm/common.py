"""Pieces that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.session import shared_dir

#: Bytes of words: A-Z lowered, everything that is neither a digit, a letter nor above ASCII becomes a space.
ALNUM_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes with only A-Z lowered. ``bytes.split()`` then cuts at space and \x09-\x0D and nowhere else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Bytes of a row group that a writer gathers before it writes; texts fill the usual 128 MB in every task.
ROW_GROUP = 16 << 20
#: Larger sets of texts are moved in so many shares of the documents, one after the other, so that no shuffle holds all texts at once.
SHARES, SHARE_BYTES = 4, 256 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact spelling, so that extra columns whose names clash do no harm."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return own.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    swept(spark)
    return out


def swept(spark: SparkSession) -> None:
    """Shuffle files of a finished job go once the JVM has dropped its plan; else they stay until some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def written_by_shares(spark: SparkSession, part: Callable[[Column], DataFrame], volume: int, name: str) -> DataFrame:
    """As ``written``, in jobs of their own for shares of the documents; ``part`` makes a share's rows, given its filter on doc_id.

    ``volume``: bytes of all texts.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    shares = min(SHARES, volume // SHARE_BYTES + 1)
    for k in range(shares):
        df = part(F.pmod(F.xxhash64("doc_id"), F.lit(shares)) == k)
        df.write.mode("append").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
        schema, df = df.schema, None
        swept(spark)
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    return out


@contextlib.contextmanager
def bloom_filtered(spark: SparkSession) -> Iterator[None]:
    """Joins started inside it may drop rows by a Bloom filter of the other side's keys before they are shuffled, however small the tables."""
    names = [f"spark.sql.optimizer.runtime.bloomFilter.{x}" for x in ("enabled", "applicationSideScanSizeThreshold", "creationSideThreshold")]
    before = [spark.conf.get(n, None) for n in names]
    try:
        for n, v in zip(names, ("true", "0", "256m"), strict=True):
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def released(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.table_path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def mapped_text(docs: DataFrame, rows: Callable[..., Iterator[tuple]], ready: Callable[[], Any] | None = None, *more: str) -> DataFrame:
    """The documents with new texts: ``rows(state, keys, texts, ...)`` yields (key, text) for each row, in order."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    return by_batch(docs, partial(_with_text, rows), DOCUMENT, *names, *more, ready=ready)


def _with_text(rows, state, keys, texts, langs, sources, sizes, *more):
    for (key, text), old, lang, source, size in zip(rows(state, keys, texts, *more), texts, langs, sources, sizes, strict=True):
        yield key, text, lang, source, size if text == old or text is None else len(text)


def by_batch(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str, *columns: str, ready: Callable[[], Any] | None = None, chunk_bytes: int = 3 << 20) -> DataFrame:
    """Map Arrow batches: ``rows(state, *column lists)`` yields output rows; ``ready()`` makes the state once per task.

    Long batches are cut into chunks of about ``chunk_bytes``, which bounds a worker's memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        try:
            yield from mapped(batches)
        finally:
            trim()

    def mapped(batches):
        state = ready() if ready else None
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * chunk_bytes / max(batch.nbytes, 1))))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                out = list(rows(state, *(part.column(i).to_pylist() for i in range(part.num_columns))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return pick(df, *columns).mapInArrow(run, schema)


def trim() -> None:
    """Hand what a task has freed back to the system: a worker lives on and would else keep its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function over a group, after which a worker hands back what it has freed."""

    def run(part: pa.Table) -> pa.Table:
        try:
            return function(part)
        finally:
            trim()

    return run


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class WordNumbers:
    """Words -> 64-bit hashes through a memory of bounded size; a worker's vocabulary is hashed once."""

    def __init__(self, most: int = 400_000):
        self.most, self.number, self.hashes = most, Numbers(), np.zeros(1 << 12, np.uint64)

    def hash(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        if len(number) > self.most:
            number.clear()
        known = len(number)
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(number) > known:
            while len(number) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            new = np.flatnonzero(ids >= known)  # new words got ascending numbers, each at its first place
            new = new[np.diff(np.maximum.accumulate(ids[new]), prepend=known - 1) > 0]
            self.hashes[known : len(number)] = [xxhash.xxh3_64_intdigest(words[i]) for i in new.tolist()]
        return self.hashes[ids]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier of rolling hashes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values."""
    n = len(values) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * BASE + values[k : k + n]
    return mix(out)
