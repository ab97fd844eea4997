"""Small made-up corpora and brute-force versions of the text operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, a periodic text, nulls, empty texts, ties, repeated rows and repeated ids."""
    rng = random.Random(seed)
    base = prose(rng, 220)
    words = base.split()
    passage = prose(rng, 60)
    texts = [base, base, base.upper(), None, "", " \t\n ", "one", "One", "two words", passage]
    for k in range(40):
        own = list(words)
        for _ in range(rng.randrange(1, 12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [f"{prose(rng, 80)} {passage} {prose(rng, 80)}" for _ in range(30)]
    texts += [f"{prose(rng, 30)}\n{passage}" for _ in range(5)]
    texts += ["na " * 300, "na " * 300 + "end", "é" * 500, "日本語 " * 50 + passage, "a" * 3000, "ab" * 700, prose(rng, 6000, 5000)]
    rows = [(i * 3 % 1009, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (6000, passage, "en", "s", 1), (6000, passage, "en", "s", 1), (7000, base + " tail", "en", "s", 1), (7000, "other text under one id", "en", "s", 1)]
    return rows


def frame(spark, rows: list[tuple], clash: bool = False):
    """The rows as documents; with ``clash`` extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in ("n_words", "spans", "items", "anchor", "route", "set_id", "id", "root", "size", "shard", "kept", "TEXT", "score", "_rank"):
            df = df.select("*", F.lit("x").alias(name)) if name != "TEXT" else df
    return df


def leaks(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = ALNUM.findall(low(text or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    out = []
    for key, text, *_ in docs:
        w = ALNUM.findall(low(text or ""))
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    ids |= found
        named = sorted(str(i) for i in ids if i is not None)
        out.append((key, len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return out


def phrases(docs: list[tuple], size: int = 35) -> list[tuple]:
    split = [WHITE.findall(t or "") for _, t, *_ in docs]
    counts = Counter(tuple(w[k : k + size]) for w in split for k in range(len(w) - size + 1))
    out = []
    for (key, *_), w in zip(docs, split, strict=True):
        gone = {j for k in range(len(w) - size + 1) if counts[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        out.append((key, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def suffixes(docs: list[tuple], depth: int = 100) -> list[tuple]:
    """Rows in document order; ids are unique here."""
    seen, out = set(), []
    for key, text, *_ in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            own = b[i : i + depth]
            if own in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(own)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((key, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def components(docs: list[tuple]) -> list[tuple]:
    sets = []
    for _, text, *_ in docs:
        w = WHITE.findall(low(text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (key, *_) in enumerate(docs):
        r = find(i)
        least[r] = key if least.get(r) is None else least[r] if key is None else min(least[r], key)
    return [(docs[i][0], len(sets[i]), least[find(i)]) for i in range(len(docs))]


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WHITE.findall(text)
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    often = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(often), len(w) < 50 or 100 * len(often) > 50 * len(w)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in p.finditer(text) if good[k](m[0])]
