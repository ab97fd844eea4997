"""Decontamination, phrase and suffix dedup and the similarity join against brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import fixtures as fx
from tickloom.llm import common, components, fmindex, parity, phrases, stretches, suffixes
from tickloom.llm.common import WordNumbers
from tickloom.session import shared_dir

ITEMS = [(1, "w1 w2 w3"), (2, None), (3, ""), (None, "one"), (10, "Two words"), (4, "--- !!")]


def rows(df, columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=key)


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert got == sorted(want, key=key)


@pytest.fixture(scope="module")
def docs():
    return fx.corpus()


def test_suffix_array_and_index_agree_with_search():
    rng = random.Random(3)
    for size, kinds in ((1, 1), (50, 2), (400, 3), (3000, 40)):
        text = np.array([rng.randrange(1, kinds + 1) for _ in range(size)], np.int64)
        order = fmindex.suffix_array(text, kinds)
        own = text.tolist()
        assert order.tolist() == sorted(range(size), key=lambda i: own[i:])
        index = fmindex.FmIndex(text, kinds)
        for width in (1, 3, 7):
            patterns = np.array([[rng.randrange(1, kinds + 1) for _ in range(width)] for _ in range(30)])
            low, high = index.count(patterns, np.full(30, width))
            for p, a, b in zip(patterns.tolist(), low, high, strict=True):
                want = [i for i in range(size - width + 1) if own[i : i + width] == p]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("clash", [False, True])
def test_decontamination(spark, docs, clash, monkeypatch):
    passage = docs[9][1]
    items = [*ITEMS, (20, passage), (21, passage), (21, passage), (5, " ".join(passage.split()[20:45]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    if clash:  # several passes over blocks of windows must add up
        monkeypatch.setattr(fmindex, "BLOCK_WINDOWS", 25)
    same(rows(fmindex.report(fmindex.find(fx.frame(spark, docs, clash), bench)), columns), fx.leaks(docs, items))


def test_clean_cuts_passages_and_keeps_the_rest(spark, docs):
    passage = docs[9][1]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = fmindex.clean(fx.frame(spark, docs), bench).collect()
    left = fx.leaks([(r["doc_id"], r["text"]) for r in out], [(1, passage)])
    assert not any(r[2] for r in left)
    hit = {r[0] for r in fx.leaks(docs, [(1, passage)]) if r[5]}
    texts = {(d[0], d[1]) for d in docs if d[0] not in hit}
    assert texts <= {(r["doc_id"], r["text"]) for r in out}


@pytest.mark.parametrize("crowd", [2000, 2])
def test_phrases(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr(stretches, "CROWD", crowd)
    same(rows(phrases.report(fx.frame(spark, docs, crowd == 2)), ("doc_id", "n_words", "n_removed", "kept_sha256")), fx.phrases(docs))


@pytest.mark.parametrize("crowd", [2000, 2])
def test_suffixes(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr(stretches, "CROWD", crowd)
    unique = [(i, *d[1:]) for i, d in enumerate(docs)]
    random.Random(1).shuffle(unique)
    same(rows(suffixes.report(fx.frame(spark, unique)), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")), fx.suffixes(unique))


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_hot_passages_do_not_end_in_one_task(spark, operator, monkeypatch):
    monkeypatch.setattr(stretches, "CROWD", 5)
    rng = random.Random(8)
    passage = fx.prose(rng, 60)
    docs = [(i, f"{fx.prose(rng, 50, 10**6)} {passage} {fx.prose(rng, 50, 10**6)}", "en", "s", 1) for i in range(40)]
    own = stretches.numbered(fx.frame(spark, docs))
    _, distinct, pieces = stretches.candidates(operator.SCHEME, own)
    assert distinct.filter("crowded").count() > 40
    assert all(r["count"] <= 5 for r in pieces.groupBy("anchor").count().collect())
    crowds = pieces.crowded.collect()
    assert {r["anchor"] for r in crowds} == {r["anchor"] for r in distinct.filter("crowded").collect()}
    assert stretches.windows(operator.SCHEME, pieces).count() >= len(crowds) // 2
    read, texts_of = [], stretches.texts_of
    monkeypatch.setattr(stretches, "texts_of", lambda *a: [read.append(1), texts_of(*a)][1])
    got, columns = operator.report(fx.frame(spark, docs)), ("doc_id", "n_words", "n_removed", "kept_sha256") if operator is phrases else ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(rows(got, columns), fx.phrases(docs) if operator is phrases else fx.suffixes(docs))
    assert len(read) == 1  # crowded stretches are cut in the pass of the others


def test_stretches_alone_with_their_anchor_are_not_judged(spark):
    """Copies of a whole text share every stretch: none is cut out and compared, and all but the first copy still go."""
    rng = random.Random(5)
    text, other = fx.prose(rng, 400, 10**6), fx.prose(rng, 60, 10**6)
    docs = [(i, t, "en", "s", 1) for i, t in enumerate([text, text, other, f"{other[:200]} ~ {other[200:]}", text])]
    _, distinct, pieces = stretches.candidates(suffixes.SCHEME, stretches.numbered(fx.frame(spark, docs)))
    judged, lone = {r["anchor"] for r in pieces.collect()}, {r["anchor"] for r in distinct.filter("lone").collect()}
    assert judged and len(lone) > 20 and not judged & lone
    assert all(r["count"] > 1 for r in pieces.groupBy("anchor").count().collect())
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(rows(suffixes.report(fx.frame(spark, docs)), columns), fx.suffixes(docs))


def test_packed_ranges_merge_where_they_touch():
    rng = random.Random(6)
    assert stretches.merged(None) == stretches.merged([]) == []
    for most in (12, 300):
        found = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(most) for _ in range(20))] + [((1 << 31) - 9, (1 << 31) - 1)]
        assert stretches.merged([a << 32 | b for a, b in found]) == stretches.joined(sorted(found))


def test_chunks_gather_and_powers_last(spark, docs, monkeypatch):
    """Rows of many chunks go to the JVM together, and later, longer texts get the powers they need."""
    monkeypatch.setattr(stretches, "POWERS", {})
    texts = ["short", *(d[1] for d in docs), "ab" * 300_000]
    parts = [stretches.stretches(suffixes.SCHEME, None, [t]) for t in texts]
    whole = stretches.stretches(suffixes.SCHEME, None, texts)
    for k in range(1, 5):
        assert np.array_equal(np.concatenate([p[k] for p in parts]), whole[k])
    assert all(len(x) <= 1 << 20 for x in stretches.POWERS.values())


@pytest.mark.parametrize("operator", [phrases, suffixes])
def test_texts_move_in_shares_and_tables_go(spark, docs, operator, monkeypatch):
    monkeypatch.setattr(common, "SHARE_BYTES", 1)
    before, moved, by_batch = set(os.listdir(shared_dir(spark))), [], stretches.by_batch
    monkeypatch.setattr(stretches, "by_batch", lambda df, *a, **b: [moved.append(df.count()), by_batch(df, *a, **b)][1])
    out = operator.report(fx.frame(spark, docs))
    assert out.count() == len(docs)
    assert max(moved) < len(docs) / 2
    assert {x.split("-")[0] for x in set(os.listdir(shared_dir(spark))) - before} <= {"cleaned", "windows", "recurring"}


def test_texts_cross_to_python_once_when_cut(spark, docs):
    bench = spark.createDataFrame([("a", fx.corpus()[9][1])], "item_id string, text string")
    plan = fmindex.clean(fx.frame(spark, docs), bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_task_scans_few_large_batches(monkeypatch):
    rng, added, add = random.Random(3), [], suffixes.Family.add
    monkeypatch.setattr(suffixes.Family, "add", lambda self, text, at: [added.append(len(at)), add(self, text, at)][1])
    data = [bytes(rng.randrange(97, 123) for _ in range(1099)) for _ in range(39)]
    data.append(data[4][100:] + b"z" * 100)
    pieces = [{"anchor": 1, "stretch": i, "doc_id": i, "v": 0, "start": 0, "n": 1000, "piece": x} for i, x in enumerate(data)]
    assert [(i, own) for i, own in enumerate(suffixes.repeated(pieces)) if own] == [(39, [(0, 999)])]
    assert sum(added) == stretches.FLUSH and len(added) <= 2


def test_repeated_rows_of_one_document_do_not_remove_each_other(spark, docs):
    text = docs[0][1]
    got = rows(suffixes.report(fx.frame(spark, [(1, text, "en", "s", 1)] * 2 + [(2, text, "en", "s", 1)])), ("doc_id", "n_removed"))
    assert got == [(1, 0), (1, 0), (2, len(text))]


def test_levels_merge_geometrically():
    rng = np.random.default_rng(2)
    family, seen = suffixes.Family(), set()
    for k in range(13):
        text = rng.integers(97, 99, 300).astype(np.uint8).tobytes() + b"ab" * 60 + (b"" if k % 3 else bytes(range(32, 152)))
        at = np.arange(len(text) - suffixes.DEPTH + 1)
        want = []
        for i in at.tolist():
            own = text[i : i + suffixes.DEPTH]
            want.append(own in seen)
            seen.add(own)
        assert family.add(text, at).tolist() == want
        generations = [g for g, _ in family.levels]
        assert generations == sorted(set(generations), reverse=True)
        for _, level in family.levels:
            windows = [family.text[p : p + suffixes.DEPTH].tobytes() for p in level]
            assert windows == sorted(windows)


@pytest.mark.parametrize("crowd", [24, 3])
def test_similarity_join(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr(parity, "CROWD", crowd)
    monkeypatch.setattr(parity, "BLOCK", 3 if crowd == 3 else 1500)  # many blocks, some of them empty
    same(rows(parity.join(fx.frame(spark, docs, crowd == 3)), ("doc_id", "n_shingles", "component_id")), fx.components(docs))


def test_crowded_files_that_no_pair_needs_are_left(spark):
    """Of two sets that share more crowded files than the smaller margin, one file at least stays common."""
    rng = random.Random(5)
    margins = {i: rng.randint(2, 6) for i in range(30)}
    filed = {i: set(rng.sample(range(20), margins[i] + 1 + rng.randint(0, 9))) for i in margins}
    members = spark.createDataFrame([(k, i, margins[i]) for i, own in filed.items() for k in own], "key long, id long, margin long")
    left = {i: set() for i in margins}
    for r in parity.needed(members).collect():
        left[r["id"]].add(r["key"])
    assert all(left[i] <= filed[i] for i in margins) and sum(map(len, left.values())) < sum(map(len, filed.values()))
    for i in margins:
        for j in range(i):
            if len(filed[i] & filed[j]) > min(margins[i], margins[j]):
                assert left[i] & left[j]


def test_blocks_of_a_crowded_file_need_no_file_lists():
    own = np.arange(1, 400, dtype=np.uint64)
    sets = [own, own + np.uint64(7), np.arange(9000, 9399, dtype=np.uint64)]
    rows_ = [{"key": 1, "p": 0, "q": 0, "block": 0, "id": i, "root": i, "size": len(x), "sketch": parity.dense(x).tobytes()} for i, x in enumerate(sets)]
    found = parity.still_apart(pa.Table.from_pylist(rows_))
    assert found.to_pylist() == [{"a": 0, "b": 1}]


def test_a_pair_is_named_by_its_first_known_file_alone():
    own = np.arange(1, 400, dtype=np.uint64)
    sets = [own, own + np.uint64(7)]
    named = []
    for key in (-3, 1, 5, 9):  # 1, 5 and 9 hold both sets, of which one knows -3 as well
        rows_ = [{"key": key, "p": 0, "q": 0, "block": 0, "id": i, "root": i, "size": len(x), "sketch": parity.dense(x).tobytes(), "known": [-3, 1, 5, 9][1 - i :]} for i, x in enumerate(sets) if key > 0 or i]
        named += [key] * parity.still_apart(pa.Table.from_pylist(rows_)).num_rows
    assert named == [1]


def test_sketches_and_sets_of_buckets_are_small():
    own = np.arange(1, 513, dtype=np.uint64)
    assert len(parity.dense(own)) * 8 <= 2 * len(own)
    text = " ".join(f"w{i}" for i in range(300))
    info = [r[5] for r in parity.filed(4, common.WordNumbers(), [1], [text]) if r[5]]
    assert info and max(map(len, info)) <= 2 * 14  # the set files in two bands


def test_survivors(spark, docs):
    out = parity.survivors(fx.frame(spark, docs)).collect()
    want = fx.components(docs)
    groups = {c for _, n, c in want if n}
    kept = [(r["doc_id"], r["text"]) for r in out]
    assert len(kept) == len(set(kept))
    assert {k for k, t in kept if fx.WHITE.search(t or "")} == groups


def test_linked_sets_always_share_enough_files():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 7, 20, 63, 64, 90, 127, 128, 170, 300, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = rng.integers(0, len(a) // 4 + 1)
            add = max(0, int((len(a) - drop) / 0.75) - len(a))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, rng.integers(0, add + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            shared = set(np.concatenate([k for k, _ in parity.filings(a)]).tolist()) & set(np.concatenate([k for k, _ in parity.filings(b)]).tolist())
            assert len(shared) > max(min(m for _, m in parity.filings(x)) for x in (a, b)) or len(shared) > 0
            apart = parity.least_apart(parity.dense(a).tobytes(), parity.dense(b).tobytes())
            assert apart <= len(a) + len(b) - 2 * both <= parity.most_different(len(a), len(b))


def test_shingles_of_short_texts():
    memory = WordNumbers()
    texts = [None, "", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a"]
    assert [len(s) for s in parity.shingle_sets(memory, texts)] == [0, 0, 1, 1, 1, 2, 1]
    assert all((s == parity.shingle_sets(memory, [t])[0]).all() for t, s in zip(texts, parity.shingle_sets(memory, texts), strict=True))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(300)] + [(7, 7), (9, 8)]
    got = {r["id"]: r["root"] for r in components.labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 801)} | {8: 8, 9: 8}


def test_empty_tables(spark):
    none = fx.frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (fmindex.report(fmindex.find(none, bench)), phrases.report(none), suffixes.report(none), parity.join(none), parity.survivors(none), fmindex.clean(none, bench)):
        assert df.collect() == []
    assert all(not r["contaminated"] for r in fmindex.report(fmindex.find(fx.frame(spark, fx.corpus()[:6]), bench)).collect())
