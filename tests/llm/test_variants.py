"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm import fixtures as fx
from tickloom.llm import variants


def plain_words(docs, least=6, often=5, slip=199):
    counts = Counter()
    for key, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fx.low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= often and len(w) >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(counts, ratio=5):
    of = {}
    for w, n in counts.items():
        own = [v for v in counts if near(w, v)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        of[w] = (form, n, len(own), None if form is None else counts[form])
    out = []
    for w, (form, n, k, form_n) in of.items():
        root = w
        while of[root][0] is not None:
            root = of[root][0]
        out.append((w, form, root, n, k, form_n))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def spellings(rng, n, letters="abé"):
    """Words over few letters, so that near ones abound."""
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(n)}
    base = "".join(rng.choice(letters) for _ in range(3000))
    return out | {base, base[1:], base[:-1], base[:1500] + "b" + base[1500:], base[:2000] + "é" + base[2001:], base + "a"}


@pytest.mark.parametrize("crowd", [2, 50, 10_000])
def test_groups_equal_brute_force(spark, crowd, monkeypatch):
    rng = random.Random(crowd)
    counts = {w: rng.choice([1, 1, 2, 5, 5, 30, 150, 1000]) for w in spellings(rng, 400)}
    monkeypatch.setattr(variants, "CROWD", crowd)
    monkeypatch.setattr(variants, "BUCKET", 100)
    monkeypatch.setattr(variants, "STEP", 64)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(variants.grouped(words)) == sorted(plain(counts), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_words_of_documents(spark, clash, monkeypatch):
    rng = random.Random(7)
    base = [*("".join(rng.choice("aeinrstÀéß÷") for _ in range(rng.randrange(4, 10))) for _ in range(60)), "Straße", "STRASSE", "naïvely"]
    docs = [(i, rng.choice([" ", "1", "_", "Ā", "\n"]).join(rng.choice(base) for _ in range(rng.randrange(200))), "en", "s", 1) for i in range(60)]
    docs += [(None, "straße " * 9, None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, "Strasse " * 40_000, "en", "s", 0), (4, "Strasse " * 4, "en", "s", 0), (5, "x" * 70_000, "en", "s", 0)]
    if clash:
        monkeypatch.setattr(variants, "HELD", 7)
    got = variants.vocabulary(fx.frame(spark, docs, clash), slip=3)
    want = plain_words(docs, slip=3)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert rows(variants.grouped(got)) == sorted(plain(want), key=repr)
    assert {r["word"]: r["n"] for r in variants.vocabulary(fx.frame(spark, docs)).collect()} == plain_words(docs, slip=0)


def test_empty_tables(spark):
    for docs in ([], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (2, "short a b", "en", "s", 0)]):
        assert rows(variants.grouped(variants.vocabulary(fx.frame(spark, docs), slip=199))) == []


def test_chains_lead_to_the_last_form(spark):
    counts = {"aaaaaa" + "b" * k: 6**k for k in range(9)} | {"zzzzzz": 7}
    got = {r["word"]: (r["form"], r["root"]) for r in variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: (x[1], x[2]) for w, *_ in counts.items() for x in plain(counts) if x[0] == w}
    assert got["aaaaaa"] == ("aaaaaab", "aaaaaa" + "b" * 8)
