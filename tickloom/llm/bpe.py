"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A vocabulary is a table byte string -> rank. Inside one pre-token the pair of lowest rank is merged first, the leftmost of
equals first. The queue keeps, for each merge rank, a bucket of linked-list positions; a two-level bitmap tells which
buckets hold something, and find-first-set on it gives the next rank in constant time. A position whose pair has changed
since it was queued is stale and is skipped when it comes up. A pre-token of n bytes takes O(n log n) at worst, in place of
the n scans of the plain method. The pre-tokens of a batch that no memory holds share one queue, which does not join them.

Nulls and empty texts have no tokens. Repeated rows are encoded each. Only ``text`` is read; other columns pass by.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import by_batch, pick, sha, table

#: A rank file is shipped to the executors whole, up to this size.
MAX_RANK_FILE_BYTES = 64 << 20
#: Distinct pre-tokens that a worker remembers, and the longest of them.
CACHED, CACHED_CHARS = 200_000, 64
#: Bytes of pre-tokens that share one queue; a longer pre-token has one of its own.
BLOCK_BYTES = 1 << 18


class Merger:
    """Ids of pre-tokens, many at a time: one linked list of positions and one queue serve a whole block of them.

    ``buckets``: rank -> positions; ``low``: block of 256 ranks -> bits of its filled buckets; ``top``: bits of the filled
    blocks. ``pair[i]`` is the rank of the pair that starts at position i, so an entry of another rank is stale. Pre-tokens
    never touch, so taking the lowest rank of the block takes the lowest of each of them in its turn.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_two = np.full(1 << 16, -1, np.int64)
        for two, rank in ranks.items():
            if len(two) == 2:
                self.of_two[two[0] << 8 | two[1]] = rank

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        whole = [self.ranks.get(p) for p in pieces]
        parts = [p for p, rank in zip(pieces, whole, strict=True) if rank is None]
        out, cut, size = [], 0, 0
        for at, part in enumerate(parts):
            size += len(part)
            if size >= BLOCK_BYTES or at == len(parts) - 1:
                out += self.block(parts[cut : at + 1])
                cut, size = at + 1, 0
        made = iter(out)
        return [next(made) if rank is None else (rank,) for rank in whole]

    def block(self, parts: list[bytes]) -> list[tuple[int, ...]]:
        data, get = b"".join(parts), self.ranks.get
        n = len(data)
        stops = np.cumsum([len(p) for p in parts])
        starts = bytearray(n + 1)  # marks where pre-tokens start
        for stop in (0, *stops.tolist()):
            starts[stop] = 1
        code = np.frombuffer(data, np.uint8).astype(np.int64)
        first = np.append(self.of_two[code[:-1] << 8 | code[1:]], -1)
        first[stops[stops > 0] - 1] = -1
        pair, following, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        live = np.flatnonzero(first >= 0)
        live = live[np.argsort(first[live], kind="stable")]
        kinds, at = np.unique(first[live], return_index=True)
        buckets = dict(zip(kinds.tolist(), [b.tolist() for b in np.split(live, at[1:])], strict=True)) if len(live) else {}
        low: dict[int, int] = {}
        for rank in buckets:
            low[rank >> 8] = low.get(rank >> 8, 0) | 1 << (rank & 255)
        top = sum(1 << block for block in low)
        while top:
            block = (top & -top).bit_length() - 1
            bits = low[block]
            bit = bits & -bits
            now = block << 8 | bit.bit_length() - 1
            bucket = buckets.pop(now)
            if bits == bit:
                del low[block]
                top ^= 1 << block
            else:
                low[block] = bits ^ bit
            bucket.sort()
            lower = False
            for done, i in enumerate(bucket, 1):
                if pair[i] != now:
                    continue
                j = following[i]
                k = following[i] = following[j]
                pair[j] = pair[i] = -1
                changed = () if starts[i] else (before[i],)
                if not starts[k]:
                    before[k] = i
                    changed = (i, *changed)
                for start in changed:
                    rank = pair[start] = get(data[start : following[following[start]]], -1)
                    if rank < 0:
                        continue
                    lower |= rank < now
                    if rank in buckets:
                        buckets[rank].append(start)
                        continue
                    buckets[rank] = [start]
                    block = rank >> 8
                    low[block] = low.get(block, 0) | 1 << (rank & 255)
                    top |= 1 << block
                if lower:  # a vocabulary may rank a longer token before its parts: that pair comes first
                    if done < len(bucket):
                        buckets[now] = bucket[done:]
                        block = now >> 8
                        low[block] = low.get(block, 0) | 1 << (now & 255)
                        top |= 1 << block
                    break
        out, i, ranks = [], 0, self.ranks
        for stop in stops.tolist():
            ids = []
            while i < stop:
                k = following[i]
                ids.append(ranks[data[i:k]])
                i = k
            out.append(tuple(ids))
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token."""
    return Merger(ranks)([piece])[0]


class Memo(dict):
    """Pre-token -> what ``make`` gives for it, bounded: when it is full, what was not asked for since the last time goes."""

    def __init__(self, make: Callable[[list[str]], list]):
        self.make, self.older = make, {}

    def __call__(self, texts: list[list[str]]) -> Iterator[Iterator]:
        """For each list of pre-tokens what was made for them; what is new is made together, first."""
        new = list(set(chain.from_iterable(texts)).difference(self))
        old = [p for p in new if p in self.older]
        self.update(zip(old, map(self.older.__getitem__, old), strict=True))
        new = [p for p in new if p not in self]
        self.update(zip(new, self.make(new), strict=True))
        for pieces in texts:
            yield map(self.__getitem__, pieces)
        for p in new:
            if len(p) > CACHED_CHARS:
                del self[p]
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.cut = regex.compile(pattern).findall
        self.merge = Merger(ranks)
        self.memo, self.forms = Memo(self.ids_of), Memo(self.forms_of)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.digits = {r: str(r) for r in self.bytes_of}

    def ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        return self.merge([p.encode("utf-8") for p in pieces])

    def forms_of(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        """Token count, ids in decimal and the bytes that the ids decode to."""
        return [(len(ids), self.written(ids), self.decode(ids)) for ids in self.ids_of(pieces)]

    def pieces(self, texts: list[str | None]) -> list[list[str]]:
        return [self.cut(t or "") for t in texts]

    def encoded(self, texts: list[str | None]) -> Iterator[list[int]]:
        return (list(chain.from_iterable(ids)) for ids in self.memo(self.pieces(texts)))

    def encode(self, text: str | None) -> list[int]:
        [ids] = self.encoded([text])
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def written(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


#: A worker's last codec, which keeps its memory from task to task.
_last: dict = {}


def codec_maker(spark: SparkSession, path: str, pattern: str):
    """A function that gives each task its codec; the rank table (of bounded size) is broadcast."""
    rank_of = read_ranks(path)
    key = (sha(repr(sorted(rank_of.items())).encode()), pattern)
    ranks = spark.sparkContext.broadcast(rank_of)

    return lambda: kept(key, ranks, pattern)


def kept(key, ranks, pattern: str) -> Codec:
    if key not in _last:
        _last.clear()
        _last[key] = Codec(ranks.value, pattern)
    return _last[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids array<int>``: the token ids of every whole text."""
    rows = lambda codec, keys, texts: zip(keys, codec.encoded(texts), strict=True)
    return by_batch(pick(docs, "doc_id", "text"), rows, "doc_id long, ids array<int>", "doc_id", "text", ready=codec_maker(docs.sparkSession, path, pattern))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``data binary``: the bytes of each row's ``ids`` (null: no bytes)."""
    rows = lambda codec, keys, ids: ((k, codec.decode(i or [])) for k, i in zip(keys, ids, strict=True))
    return by_batch(pick(tokens, "doc_id", "ids"), rows, "doc_id long, data binary", "doc_id", "ids", ready=codec_maker(tokens.sparkSession, path, pattern))


def digests(codec: Codec, keys: list, texts: list):
    """Pre-tokens are coded apart, so a text's decimal ids and decoded bytes are those of its pre-tokens in a row."""
    for key, forms in zip(keys, codec.forms(codec.pieces(texts)), strict=True):
        forms = list(forms)
        yield key, sum(f[0] for f in forms), sha(" ".join([f[1] for f in forms]).encode()), sha(b"".join([f[2] for f in forms]))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, without shuffling a row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_batch(pick(docs, "doc_id", "text"), digests, schema, "doc_id", "text", ready=codec_maker(docs.sparkSession, path, pattern))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
