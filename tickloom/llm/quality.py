"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a ratio computed from its text lies above (or below) a cut-off. Cut-offs are not set by hand:
labelled documents serve as holdouts. All rules tighten together along a fixed path of steps, from every rule's loosest
cut-off to its strictest. In each stratum (a band of document lengths) the steps are tested from the loosest on: "the rules
together reject at least a share ``alpha`` of good documents". An exact binomial tail on the good labelled documents gives
the p-value, and the first step that cannot be proven ends the walk, which needs no correction over steps; a Bonferroni
correction over the strata holds the chance that any stratum loses more than ``alpha`` of its good documents below
``delta``. Neighbouring bands with too few good labels to prove anything are pooled, by their number alone; the guarantee
is then one for the pooled stratum. Where even all bands together have too few, no rule acts.

Only counts per (band, step) reach the driver: a table of fixed size. Ratios are compared as integers times a
power of ten, so Spark and the driver see the same numbers.

Base: fewer than 50 words, or over half the words in repeated three-word windows, fails outright. Null texts have no
words and fail. Repeated rows are judged each. A document is good once if it has a label and all its labels say so; null
labels and null ids do not count. Repeated documents and equal texts count as they come.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import by_batch, pick, table, written

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Stratum bounds: words in a document.
BANDS = (200, 1000, 5000)
ALPHA, DELTA = 0.01, 0.05
#: Steps from the loosest cut-offs to the strictest.
STEPS = 41
#: Rule -> (metric, True if large values are bad, grid of cut-offs from the strictest).
GRID = {
    "symbols": ("symbols_ppm", True, tuple(range(0, 100_001, 2_500))),
    "dup_lines": ("dup_lines_ppm", True, tuple(range(0, 600_001, 20_000))),
    "repeats": ("repeats_ppm", True, tuple(range(20_000, 500_001, 20_000))),
    "long_words": ("mean_chars_milli", True, tuple(range(6_000, 14_001, 250))),
    "short_words": ("mean_chars_milli", False, tuple(range(5_000, 999, -250))),
}
METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, kind, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = np.zeros(n + 2, bool)
    often[2:-2] = count[kind] > 1
    return int((often[2:] | often[1:-1] | often[:-2]).sum())


def measure(_, keys: list, texts: list):
    for key, text in zip(keys, texts, strict=True):
        text = text or ""
        words = text.encode("utf-8").split()
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        yield key, len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def metrics(docs: DataFrame) -> DataFrame:
    """The base columns of every whole text."""
    return by_batch(pick(docs, "doc_id", "text"), measure, METRICS, "doc_id", "text")


def ratios(rows: DataFrame) -> DataFrame:
    share = lambda a, b, scale: F.floor(F.col(a) * scale / F.greatest(F.col(b), F.lit(1)))
    band = F.lit(0)
    for i, bound in enumerate(BANDS):
        band = F.when(F.col("n_words") >= bound, F.lit(i + 1)).otherwise(band)
    return rows.withColumns({
        "stratum": band, "symbols_ppm": share("n_symbols", "word_chars", 1_000_000), "dup_lines_ppm": share("n_dup_lines", "n_lines", 1_000_000),
        "repeats_ppm": share("n_repeat_words", "n_words", 1_000_000), "mean_chars_milli": share("word_chars", "n_words", 1_000),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def rejects(rule: str, cut: Column | int) -> Column:
    metric, large, _ = GRID[rule]
    return F.col(metric) > cut if large else F.col(metric) < cut


def lower_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): a regularised incomplete beta function, by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    scale = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (n + 3):
        return min(1.0, scale * fraction(a, b, x) / a)
    return max(0.0, 1.0 - scale * fraction(b, a, p) / b)


def fraction(a: int, b: int, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated forwards."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15 or m > 100_000:
            return out


def cuts_at(step: int) -> dict[str, int]:
    """Every rule's cut-off at a step of the path."""
    return {rule: grid[len(grid) - 1 - step * (len(grid) - 1) // (STEPS - 1)] for rule, (_, _, grid) in GRID.items()}


def rejected(step: int) -> Column:
    return reduce(or_, (rejects(rule, cut) for rule, cut in cuts_at(step).items()))


def pooled(goods: list[int], alpha: float, delta: float) -> list[list[int]]:
    """Neighbouring bands joined until each stratum could prove its loosest step; as many strata as that allows."""
    for strata in range(len(goods), 0, -1):
        enough = math.log(delta / strata) / math.log1p(-alpha)
        out, have = [[]], 0
        for band, n in enumerate(goods):
            if have >= enough and len(out) < strata:
                out, have = [*out, []], 0
            out[-1].append(band)
            have += n
        if len(out) > 1 and have < enough:
            out[-2:] = [out[-2] + out[-1]]
        if len(out) == strata:
            return out
    return [list(range(len(goods)))]


def thresholds(judged: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[int, int]:
    """Band -> the strictest step whose false rejections are proven rare; absent: no rule acts there."""
    good = pick(labels, "doc_id", "quality").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    counted = judged.filter(~F.col("base_failed")).join(good, "doc_id").groupBy("stratum")
    sums = [F.count_if(rejected(step)).alias(f"s{step}") for step in range(STEPS)]
    counts = {r["stratum"]: r for r in counted.agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    strata = pooled([counts[b]["n"] if b in counts else 0 for b in range(len(BANDS) + 1)], alpha, delta)
    out = {}
    for bands in strata:
        own = [counts[b] for b in bands if b in counts]
        n = sum(r["n"] for r in own)
        for step in range(STEPS):
            k = sum(r[f"s{step}"] for r in own)
            if k >= alpha * n or lower_tail(k, n, alpha) > delta / len(strata):
                break
            out.update(dict.fromkeys(bands, step))
    return out


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Base columns, ``base_failed``, ``kept``, the stratum and the first rule that rejects, for every document. The texts are read once."""
    judged = ratios(written(metrics(docs), "quality"))
    rule = F.lit(None).cast("string")
    for band, step in sorted(thresholds(judged, labels, alpha, delta).items()):
        first = F.coalesce(*[F.when(rejects(name, cut), F.lit(name)) for name, cut in cuts_at(step).items()])
        rule = F.when(F.col("stratum") == band, first).otherwise(rule)
    out = judged.withColumn("rule", F.when(~F.col("base_failed"), rule)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
