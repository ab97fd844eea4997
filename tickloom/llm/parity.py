"""Similarity join of shingle sets by parity sketches (Jaccard of at least 0.75, exact).

A set's sketch is cut into blocks by a hash of the shingle; a block is the XOR of the 64-bit hashes of its shingles, so a
shingle that only one of two sets has disturbs a single block: the number of blocks in which two sketches differ is at most
the symmetric difference. Two linked sets of sizes a and b differ in at most (a + b) / 7 shingles, so among enough blocks some
must agree (pigeonhole): a set files the blocks it has under (size band, block, XOR), and only sets that share a file are
compared. A second, dense parity sketch (each shingle flips one of at least two bits per shingle) has a Hamming distance that
bounds the difference from below and turns false candidates away before texts are fetched and shingles compared.

Bands are octaves of the set size. A set files in its own band and, if it may have smaller partners there, in the one below.
Let d be the largest difference that it can have from a partner in a band. It files non-empty blocks in a fixed order until
it has d + 1 and a margin m of a quarter more; the sketch has so many blocks that there are always d + 1 (else an error is
raised, never a silent loss). Two linked sets then share at least 1 + m of the files of the one that stopped first.

A file of more than ``CROWD`` sets is crowded: a passage that many documents have, or a large family of copies. Sets with at
most m crowded files share an uncrowded one with every partner, so crowded files are needed only between the few sets with
more ("swamped": members of large families). There every set is compared with ``HEADS`` members of each crowded file, and
then, in blocks of sketches, with those that are still in another component. For the latter a set leaves its largest crowded
files, as many as its margin allows (see ``needed``), and a pair is not named again where both know an earlier common file. So a
family's pairs are not listed, and no link between different components is lost.

Equal texts and equal sets are one node throughout. Files travel packed, one row per (chunk of documents, bucket of files),
and are matched in numpy inside tasks of bounded size; pairs, verification and components are DataFrame work.

Null and empty texts have no shingles and no links; texts under five words are one shingle. Rows that share a doc_id are nodes of
their own and come out as separate rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.llm.common import LOWER, WordNumbers, bloom_filtered, by_batch, grams, mix, pick, table, text_bytes, tidy, utf8, written, written_by_shares
from tickloom.llm.components import labels

SHINGLE = 5
CROWD = 24
#: Bytes of text for each bucket of files (about a tenth as many files), and the smallest band.
BUCKET_BYTES = 8 << 20
FIRST_BAND = 64
#: Members of a crowded file that everyone in it is compared with first, and those compared in one block later.
HEADS, BLOCK = 3, 1500
#: A member of crowded files knows so many of them, the first by key.
KNOWN = 8
#: A set in a bucket of files; a margin too large for its field is cut, which only makes the set take part in more.
INFO = np.dtype([("name", "<i8"), ("size", "<u4"), ("margin", "<u2")])
#: Stands for a null doc_id, which counts as the largest.
LAST = (1 << 63) - 1


def shingle_sets(memory: WordNumbers, texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are hashed for all texts at once."""
    split = [utf8(t).translate(LOWER).split() for t in texts]
    hashes = memory.hash([w for words in split for w in words])
    long, start, out = grams(hashes, SHINGLE), 0, []
    for words in split:
        n = len(words)
        out.append(np.unique(long[start : start + n - SHINGLE + 1] if n >= SHINGLE else grams(hashes[start : start + n], n) ^ np.uint64(n) if n else long[:0]))
        start += n
    return out


def identity(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(own * np.uint64(3)).sum(dtype=np.uint64).astype(np.int64)) if len(own) else 0


def most_different(size: int, partner: int) -> int:
    return (size + partner) // 7


def band_of(size: int) -> int:
    """0 for sizes below FIRST_BAND, then octaves."""
    return 0 if size < FIRST_BAND else (size // FIRST_BAND).bit_length()


def band_stop(band: int) -> int:
    return FIRST_BAND << band


def filings(own: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band of the set: the keys that it files and its margin m."""
    size, band = len(own), band_of(len(own))
    bands = [(band, most_different(size, size * 4 // 3))]
    if band and 3 * size <= 4 * (band_stop(band - 1) - 1):
        bands.append((band - 1, most_different(size, band_stop(band - 1) - 1)))
    out = []
    for b, d in bands:
        blocks = (mix(own ^ np.uint64(0x5BD1E995)) >> np.uint64(11)) % np.uint64(band_stop(b)) if b else own
        order = np.argsort(blocks, kind="stable")
        blocks = blocks[order]
        heads = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        if len(heads) <= d:
            raise ValueError(f"a set of {size} shingles fills {len(heads)} blocks of a sketch, but may differ in {d}")
        take = min(len(heads), d + 1 + max(6, (d + 1) // 4))
        parity = np.bitwise_xor.reduceat(mix(own[order]), heads)[:take]
        out.append((mix(parity ^ mix(blocks[heads[:take]] * np.uint64(64) + np.uint64(b))), take - d - 1))
    return out


def dense(own: np.ndarray) -> np.ndarray:
    """A parity sketch of a power of two bits, at least two per shingle."""
    size = 1 << max(6, (2 * len(own) - 1).bit_length())
    bits = np.bincount((mix(own) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A shorter parity sketch of the same set."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def least_apart(one: bytes, two: bytes) -> int:
    """Hamming distance of two dense sketches, the longer one folded."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (one, two)), key=len)
    return int(np.bitwise_count(a ^ fold(b, len(a))).sum())


FILED = "bucket long, doc_id long, size long, set_id long, sketch binary, info binary, keys binary, owners binary"


def filed(buckets: int, memory: WordNumbers, ids: list, texts: list):
    """One row per document with its set; one row per bucket with the chunk's sets and their files, sorted by key."""
    distinct = list(set(texts))
    of = {t: (len(own), identity(own), dense(own).tobytes(), own) for t, own in zip(distinct, shingle_sets(memory, distinct), strict=True)}
    for i, t in zip(ids, texts, strict=True):
        size, name, sketch, _ = of[t]
        yield i % buckets, i, size, name, sketch, None, None, None
    names, keys, owners = [], [], []
    for size, name, own in {name: (size, name, own) for size, name, _, own in of.values() if size}.values():
        for key, margin in filings(own):
            keys.append(key)
            owners.append(np.full(len(key), len(names), np.uint32))
            names.append((name, size, min(margin, 65535)))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    info = np.array(names, INFO)
    bucket = (key >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    key, owner, bucket = key[order], owner[order], bucket[order]
    cuts = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:]):
        used, local = np.unique(owner[a:b], return_inverse=True)
        low = np.ascontiguousarray(key[a:b].view(np.uint8).reshape(-1, 8)[:, :5])
        yield int(bucket[a]), None, None, None, None, info[used].tobytes(), low.tobytes(), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes()


PAIR = "kind string, key long, a long, b long, extra long, sketch binary"


def matched(part: pa.Table) -> pa.Table:
    """Files of one bucket: pairs out of uncrowded ones, memberships of crowded ones; rows of documents pass through."""
    bucket = part["bucket"][0].as_py()
    rows = part.filter(pc.is_valid(part["set_id"]))
    through = pa.table({"kind": pa.array(["set"] * len(rows), pa.string()), "key": rows["doc_id"], "a": rows["set_id"], "b": rows["size"], "extra": rows["size"], "sketch": rows["sketch"]})
    part = part.filter(pc.is_null(part["set_id"]))
    if not len(part):
        return through
    infos, keys, owners, base = [], [], [], 0
    for info, key, owner in zip(part["info"].to_pylist(), part["keys"].to_pylist(), part["owners"].to_pylist(), strict=True):
        n = len(key) // 5
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(key, np.uint8).reshape(n, 5)
        keys.append(wide.view(np.uint64).reshape(-1))
        infos.append(np.frombuffer(info, INFO))
        owners.append(np.frombuffer(owner, np.uint16 if len(owner) == 2 * n else np.uint32).astype(np.int64) + base)
        base += len(infos[-1])
    info, key, owner = np.concatenate(infos), np.concatenate(keys), np.concatenate(owners)
    name = info["name"][owner]
    order = np.lexsort((name, key))
    key, name, owner = key[order], name[order], owner[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
    key, name, owner = key[fresh], name[fresh], owner[fresh]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = (sizes > 1) & (sizes <= CROWD)
    for size in np.unique(sizes[few]).tolist():
        at = heads[few & (sizes == size)]
        i, j = np.triu_indices(size, 1)
        first.append((at[:, None] + i).reshape(-1))
        second.append((at[:, None] + j).reshape(-1))
    a, b = np.concatenate(first), np.concatenate(second)
    size = info["size"].astype(np.int64)[owner]
    near = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
    pairs = np.unique(np.stack([name[a[near]], name[b[near]]]), axis=1) if near.any() else np.zeros((2, 0), np.int64)
    crowded = np.repeat(sizes > CROWD, sizes)
    n, m = pairs.shape[1], int(crowded.sum())
    found = pa.table({
        "kind": pa.array(["pair"] * n + ["crowd"] * m, pa.string()),
        "key": pa.array(np.concatenate([np.zeros(n, np.int64), mix(key[crowded] ^ mix(np.full(m, bucket, np.uint64))).view(np.int64)])),
        "a": pa.array(np.concatenate([pairs[0], name[crowded]])), "b": pa.array(np.concatenate([pairs[1], np.zeros(m, np.int64)])),
        "extra": pa.array(np.concatenate([np.zeros(n, np.int64), info["margin"][owner[crowded]].astype(np.int64)])), "sketch": pa.nulls(n + m, pa.binary()),
    })
    return pa.concat_tables([found, through.cast(found.schema)])


def packed_texts(_, names: list, texts: list):
    pack = zstandard.ZstdCompressor(level=3).compress
    for name, text in zip(names, texts, strict=True):
        yield name, pack(utf8(text))


def near(_, firsts: list, seconds: list, sizes: list, others: list, lefts: list, rights: list):
    """Pairs whose dense sketches don't rule a link out."""
    for a, b, i, j, one, two in zip(firsts, seconds, sizes, others, lefts, rights, strict=True):
        if least_apart(one, two) <= most_different(i, j):
            yield a, b


def similar(memory: WordNumbers, firsts: list, seconds: list, lefts: list, rights: list):
    """Exact check of candidate pairs."""
    open_ = zstandard.ZstdDecompressor().decompress
    texts = {**dict(zip(firsts, lefts, strict=True)), **dict(zip(seconds, rights, strict=True))}
    names = list(texts)
    sets = dict(zip(names, shingle_sets(memory, [open_(texts[n]).decode("utf-8") for n in names]), strict=True))
    for a, b in zip(firsts, seconds, strict=True):
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            yield a, b


def promising(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pairs that sketches allow."""
    a = kinds.select(F.col("id").alias("a"), F.col("size").alias("sa"), F.col("sketch").alias("ka"))
    b = kinds.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.col("sketch").alias("kb"))
    return by_batch(pairs.join(a, "a").join(b, "b"), near, "a long, b long", "a", "b", "sa", "sb", "ka", "kb")


def fetched(pairs: DataFrame, kinds: DataFrame, rows: DataFrame) -> DataFrame:
    """Packed texts of all sets in the pairs, each from its first document."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # A table, so that Spark knows its size: a few sets are sent to the texts and not the texts to them.
    wanted = written(wanted.join(kinds, "id").select("id", "doc_id"), "wanted")
    own = lambda share: by_batch(rows.filter(share).join(wanted.filter(share), "doc_id"), mine, "id long, packed binary", "id", "text", ready=WordNumbers)
    with bloom_filtered(rows.sparkSession):
        return written_by_shares(rows.sparkSession, own, rows.volume, "texts")


def mine(memory: WordNumbers, names: list, texts: list):
    """Rows may share a doc_id: only a text of the very set counts."""
    good = [i for i, own in enumerate(shingle_sets(memory, texts)) if identity(own) == names[i]]
    yield from packed_texts(None, [names[i] for i in good], [texts[i] for i in good])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are linked."""
    left = texts.select(F.col("id").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("packed").alias("right"))
    return by_batch(pairs.join(right, "b").join(left, "a"), similar, "a long, b long", "a", "b", "left", "right", ready=WordNumbers)


def still_apart(part: pa.Table) -> pa.Table:
    """Pairs out of two blocks of a crowded file that lie in different components and that sketches allow.

    A pair whose sets both know an earlier common file is left to that one; the first file that they share always names it.
    """
    key, known = part["key"][0].as_py(), np.full((len(part), KNOWN), LAST)
    if "known" in part.column_names:
        for i, own in enumerate(part["known"].to_pylist()):
            known[i, : len(own)] = own
    block = part["block"].to_numpy()
    left, right = (np.flatnonzero(block == part[side][0].as_py()) for side in ("p", "q"))
    names, roots, sizes = (part[c].to_numpy() for c in ("id", "root", "size"))
    raw = [np.frombuffer(x, np.uint64) for x in part["sketch"].to_pylist()]
    words = min(map(len, raw))
    folded = np.stack([fold(x, words) for x in raw])
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left.tolist():
        own = right[roots[right] > roots[i] if part["p"][0] == part["q"][0] else roots[right] != roots[i]]
        own = own[(3 * np.maximum(sizes[own], sizes[i]) <= 4 * np.minimum(sizes[own], sizes[i]))]
        own = own[7 * np.bitwise_count(folded[own] ^ folded[i]).sum(1, dtype=np.int64) <= sizes[own] + sizes[i]]
        if len(own):
            own = own[~np.isin(known[own], known[i][known[i] < key]).any(1)]
        first.append(np.full(len(own), names[i]))
        second.append(names[own])
    return pa.table({"a": pa.array(np.concatenate(first), pa.int64()), "b": pa.array(np.concatenate(second), pa.int64())})


def needed(members: DataFrame) -> DataFrame:
    """The members (key, id) of crowded files without those that no pair needs.

    Two linked sets that share no uncrowded file share more crowded ones than the smaller of their margins. A set may thus leave as many
    files as the smallest margin found in any of its own: in one order of all files (by size, then key) it leaves its last ones,
    and the first file that two linked sets share is kept by both.
    """
    files = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("margin").alias("_least"))
    own = members.join(files, "key").groupBy("id").agg(F.min("_least").alias("_spare"), F.array_sort(F.collect_list(F.struct("_n", "key"))).alias("_files"))
    return own.select("id", F.explode(F.slice("_files", F.lit(1), F.greatest(F.size("_files") - F.col("_spare").cast("int"), F.lit(0)))).alias("_f")).select("_f.key", "id")


def remaining(members: DataFrame, roots: DataFrame, kinds: DataFrame) -> DataFrame:
    """Candidate pairs of swamped sets that share a crowded file and are still in different components.

    A file is compared in blocks of about ``BLOCK`` members, so neither a task nor a table holds its pairs.
    """
    inside = needed(members).join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = written(inside.join(mixed, "key"), "rest")
    known = left.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("key")), 1, KNOWN).alias("known"))
    rows = left.join(known, "id").join(kinds.select("id", "size", "sketch"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_j")).withColumns({"p": F.least("block", "_j"), "q": F.greatest("block", "_j")})
    found = dealt.select("key", "p", "q", "block", "id", "root", "size", "sketch", "known").groupBy("key", "p", "q").applyInArrow(still_apart, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    own = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    joined = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, n_shingles, set_id; roots: id, root for the sets with links)."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    rows.volume = text_bytes(rows)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.volume // BUCKET_BYTES)
    packed = by_batch(rows, partial(filed, buckets), FILED, "doc_id", "text", ready=WordNumbers)
    found = written(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy(matched), PAIR), "files")
    sets = found.filter("kind = 'set'").select(F.col("key").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("a").alias("set_id"), "sketch")
    # Sets with more crowded files than their margin; they alone can need one.
    crowd = found.filter("kind = 'crowd'").select("key", F.col("a").alias("id"), F.col("extra").alias("margin"))
    swamped = crowd.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("margin").alias("margin")).filter("n > margin")
    members = written(crowd.select("key", "id").join(swamped.select("id", "margin"), "id"), "crowd")
    heads = members.groupBy("key").agg(F.array_distinct(F.array(F.min("id"), *[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(HEADS - 1)])).alias("heads"))
    stars = members.join(heads, "key").select("id", F.explode("heads").alias("head")).filter("id <> head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))
    candidates = found.filter("kind = 'pair'").select("a", "b").union(stars).distinct()
    kinds = sets.groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"))
    pairs = written(promising(candidates, kinds), "pairs")
    texts = fetched(pairs, kinds, rows)
    # One pair for each set first; then those that still lead to another component.
    links = written(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts), "links")
    more = apart(pairs, labels(links))
    links = written(links.union(verified(more, texts)), "links")
    roots = written(labels(links), "roots")
    rest = written(remaining(members, roots, kinds).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        roots = written(labels(links.union(verified(rest, fetched(rest, kinds, rows)))), "roots")
    return sets.drop("sketch"), roots


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document; the component is named by its smallest doc_id."""
    sets, roots = linked(docs)
    own = sets.join(roots, sets["set_id"] == roots["id"], "left").select("doc_id", "n_shingles", F.coalesce("root", "set_id").alias("root"))
    names = own.filter("n_shingles > 0").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least"))
    out = own.join(names, (F.col("root") == F.col("r")) & (F.col("n_shingles") > 0), "left")
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_shingles", F.nullif(F.coalesce("least", "doc_id"), F.lit(LAST)).alias("component_id"))


def named(memory: WordNumbers, texts: list, *others: list):
    for text, found, *own in zip(texts, shingle_sets(memory, texts), *others, strict=True):
        yield *own, text, identity(found)


def survivors(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the one of smallest doc_id stays."""
    sets, roots = linked(docs)
    own = sets.join(roots, sets["set_id"] == roots["id"], "left").withColumn("root", F.coalesce("root", "set_id"))
    full = own.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "set_id")).alias("w")).select("w.doc_id", "w.set_id")
    winners = full.union(own.filter("n_shingles = 0").select("doc_id", "set_id")).distinct().select("doc_id", F.col("set_id").alias("_set"))
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    # Rows may share a doc_id, so the text must be the winner's; a row given twice stays once.
    schema = "doc_id long, lang string, source string, n_chars long, _set long, text string, _own long"
    winners = written(winners, "winners")
    once = Window.partitionBy("doc_id", "_set").orderBy("text", "lang", "source")

    def own_texts(share):
        mine = by_batch(rows.filter(share).join(winners.filter(share), "doc_id"), named, schema, "text", "doc_id", "lang", "source", "n_chars", "_set", ready=WordNumbers)
        return mine.filter("_own = _set").withColumn("_row", F.row_number().over(once)).filter("_row = 1")

    kept = written_by_shares(rows.sparkSession, own_texts, text_bytes(rows), "survivors")
    return kept.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "text", "lang", "source", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * k >= 75 * (i.n + j.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
