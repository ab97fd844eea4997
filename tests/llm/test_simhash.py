"""SimHash near-duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm import fixtures as fx
from tickloom.llm import simhash
from tickloom.llm.components import labels


def plain_fingerprint(text):
    w = fx.WHITE.findall(fx.low(text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def trees(fps, bits=3):
    """fingerprint -> smallest fingerprint (as given) of its component."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    own = sorted(fps)
    for i, f in enumerate(own):
        for g in own[:i]:
            if (f ^ g).bit_count() <= bits:
                a, b = sorted((find(f), find(g)))
                root[b] = a
    return {f: find(f) for f in fps}


def plain(docs):
    fps = [plain_fingerprint(t) for _, t, *_ in docs]
    root = trees(set(fps))
    least = {}
    for (key, *_), f in zip(docs, fps, strict=True):
        if key is not None:
            least[root[f]] = min(least.get(root[f], key), key)
    return [(key, f"{f:016x}", least.get(root[f])) for (key, *_), f in zip(docs, fps, strict=True)]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, clash, monkeypatch):
    docs = fx.corpus()
    rng = random.Random(12)
    long = fx.prose(rng, 40_000, 3000)
    docs += [(8000, long, None, None, 1), (8001, long + " end", None, None, 1), (8002, "W1 w2", "en", "s", 1), (8003, "w1\tw2 ", "en", "s", 1)]
    if clash:
        monkeypatch.setattr(simhash, "RUN", 100)
        monkeypatch.setattr(simhash, "BUCKET", 20)
    assert rows(simhash.join(fx.frame(spark, docs, clash))) == sorted(plain(docs), key=repr)


def test_empty_and_null_tables(spark):
    assert rows(simhash.join(fx.frame(spark, []))) == []
    assert rows(simhash.join(fx.frame(spark, [(None, None, None, None, None), (None, "", None, None, None)]))) == [(None, "0" * 16, None)] * 2
    assert rows(simhash.join(fx.frame(spark, [(4, None, None, None, None), (3, " ", None, None, None)]))) == [(3, "0" * 16, 3), (4, "0" * 16, 3)]


def family(rng, n, most):
    """Distinct fingerprints around one center."""
    center, out = rng.getrandbits(64), set()
    while len(out) < n:
        f = center
        for b in rng.sample(range(64), rng.randrange(most + 1)):
            f ^= 1 << b
        out.add(f)
    return out


@pytest.mark.parametrize("crowd", [3, 40, 100_000])
def test_crowded_cells_lose_no_link(spark, crowd, monkeypatch):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(300)} | family(rng, 500, 4) | family(rng, 200, 12)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BUCKET", 64)
    kinds = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.links(kinds)
    got = {r["id"] & (2**64 - 1): r["root"] for r in labels(found).collect()}
    groups = lambda of: {frozenset(x) for x in _classes(of)}
    want = trees(fps)
    assert groups({f: got.get(f, f) for f in fps}) == groups(want)


def _classes(of):
    out = {}
    for f, r in of.items():
        out.setdefault(r, set()).add(f)
    return out.values()


def test_pivot_columns_never_turn_a_link_away():
    rng = random.Random(3)
    fps = np.array(sorted(family(rng, 700, 6), key=int.bit_count), np.uint64)
    got = Counter((int(i), int(j)) for a, b in simhash.linked_pairs(fps, 3) for i, j in zip(a, b))
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert set(got) == want and max(got.values()) == 1
    assert len(set(simhash.PIVOTS.tolist())) == 64 and all((int(a) ^ int(b)).bit_count() == 32 for a in simhash.PIVOTS for b in simhash.PIVOTS if a != b)
