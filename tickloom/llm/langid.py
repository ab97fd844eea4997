"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a token (a run of non-white characters, in lower case; longer ones in pieces of ``PIECE``
bytes) in both directions, gives every position a distribution over the learned languages, and a document's probabilities
are the mean over all positions of its whole text. Since the recurrent state starts afresh at every token, a worker
remembers the sums of tokens it has met, which leaves results unchanged and saves nearly all of the arithmetic.

Training is plain numpy: forward passes, backpropagation through time and Adam, from a fixed seed. It uses a bounded
sample, the same at every input size: at most ``SAMPLE_DOCS`` documents of each of at most ``MAX_LANGS`` languages (the most
frequent), chosen by a hash of their id, and ``SAMPLE_TOKENS`` tokens from each, at hashed places of the whole text. Documents
whose crc32(doc_id) mod 3 is 1 are held out and never learned from.

``und`` with score 0 for texts that are null or have no letter, and for all if nothing can be learned. Repeated rows are
labelled each; a null id counts as the empty text for the fold.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.llm.common import DOCUMENT, by_batch, pick, table

PIECE, EMBED, HIDDEN = 24, 16, 24
SAMPLE_DOCS, SAMPLE_TOKENS, MAX_LANGS = 250, 40, 64
EPOCHS, BATCH, RATE = 3, 256, 6e-3
CACHED = 120_000
LETTER = re.compile(r"[^\W\d_]")


def pieces(token: bytes) -> list[bytes]:
    return [token] if len(token) <= PIECE else [token[i : i + PIECE] for i in range(0, len(token), PIECE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction. Gates are laid out update | reset | candidate."""

    def __init__(self, rng: np.random.Generator):
        self.w = {"x": rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 3 * HIDDEN)), "u": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)), "b": np.zeros(3 * HIDDEN)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: time x batch x 3*HIDDEN, already multiplied and biased. Returns the states after each step."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0]):
            hu = h @ self.w["u"]
            gates = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r, hn = gates[:, :HIDDEN], gates[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hn)
            if keep is not None:
                keep.append((h, z, r, n, hn))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, kept: list, d_out: np.ndarray, x_in: np.ndarray, grad: dict) -> np.ndarray:
        """Through time; adds to ``grad`` and returns the gradient of the inputs."""
        d_h = np.zeros_like(d_out[0])
        d_x = np.empty((*d_out.shape[:2], EMBED), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, n, hn = kept[t]
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * hn * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_n], 1)
            d_hu = np.concatenate([d_z, d_r, d_n * r], 1)
            grad["u"] += h.T @ d_hu
            grad["x"] += x_in[t].T @ d_gate
            grad["b"] += d_gate.sum(0)
            d_x[t] = d_gate @ self.w["x"].T
            d_h = d_h * z + d_hu @ self.w["u"].T
        return d_x


class Network:
    """Embedding, a GRU each way, and a softmax at every position."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 1, (256, EMBED)).astype(np.float32)
        self.ways = (Gru(rng), Gru(rng))
        self.out = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def inputs(self, way: Gru) -> np.ndarray:
        return self.embed @ way.w["x"] + way.w["b"]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """codes: time x batch of bytes. Returns time x batch x languages."""
        states = np.concatenate([self.ways[0].forward(self.inputs(self.ways[0])[codes]), self.ways[1].forward(self.inputs(self.ways[1])[codes[::-1]])[::-1]], 2)
        scores = states @ self.out + self.bias
        scores = np.exp(scores - scores.max(2, keepdims=True))
        return scores / scores.sum(2, keepdims=True)

    def sums(self, tokens: list[bytes]) -> np.ndarray:
        """For each token: summed position probabilities, and the number of positions in the last column."""
        total = np.zeros((len(tokens), len(self.langs) + 1))
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for i, token in enumerate(tokens):
            for p in pieces(token):
                by_size.setdefault(len(p), []).append((i, p))
        for size, own in by_size.items():
            for k in range(0, len(own), 2048):
                part = own[k : k + 2048]
                codes = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, size).T
                at = np.fromiter((i for i, _ in part), np.int64, len(part))
                np.add.at(total, at, np.concatenate([self.probabilities(codes).sum(0), np.full((len(part), 1), size)], 1))
        return total

    def step(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of one batch of tokens of equal length."""
        order = (codes, codes[::-1])
        kept: tuple[list, list] = ([], [])
        seen = [self.embed[c] for c in order]
        states = [w.forward(x @ w.w["x"] + w.w["b"], k) for w, x, k in zip(self.ways, seen, kept, strict=True)]
        both = np.concatenate([states[0], states[1][::-1]], 2)
        scores = both @ self.out + self.bias
        scores = np.exp(scores - scores.max(2, keepdims=True))
        p = scores / scores.sum(2, keepdims=True)
        n = codes.size
        loss = -float(np.log(np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (*codes.shape, 1)), 2) + 1e-9).mean())
        p[:, np.arange(codes.shape[1]), labels] -= 1
        d = p / n
        flat = d.reshape(-1, d.shape[2])
        grad = {"out": both.reshape(-1, both.shape[2]).T @ flat, "bias": flat.sum(0), "embed": np.zeros_like(self.embed)}
        d_both = d @ self.out.T
        for i, (way, part) in enumerate(zip(self.ways, (d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]), strict=True)):
            own = {k: np.zeros_like(v) for k, v in way.w.items()}
            d_x = way.backward(kept[i], part, seen[i], own)
            np.add.at(grad["embed"], order[i].reshape(-1), d_x.reshape(-1, EMBED))
            grad |= {f"{k}{i}": v for k, v in own.items()}
        return loss, grad

    def weights(self) -> dict[str, np.ndarray]:
        return {"out": self.out, "bias": self.bias, "embed": self.embed} | {f"{k}{i}": v for i, w in enumerate(self.ways) for k, v in w.w.items()}


def train(examples: list[tuple[str, bytes]], seed: int = 7) -> Network | None:
    """examples: (language, token). The same examples give the same network."""
    langs = sorted({lang for lang, _ in examples})
    if not langs:
        return None
    net, rng = Network(langs, seed), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(langs)}
    by_size: dict[int, tuple[list[bytes], list[int]]] = {}
    for lang, token in examples:
        for p in pieces(token):
            own = by_size.setdefault(len(p), ([], []))
            own[0].append(p)
            own[1].append(number[lang])
    data = {size: (np.frombuffer(b"".join(t), np.uint8).reshape(-1, size), np.array(y)) for size, (t, y) in by_size.items()}
    weights = net.weights()
    first, second, steps = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2)), None, 0
    first, second = first
    total = EPOCHS * sum(-(-len(y) // BATCH) for _, y in data.values())
    for _ in range(EPOCHS):
        batches = [(size, part) for size, (_, y) in sorted(data.items()) for part in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH))]
        for k in rng.permutation(len(batches)):
            size, part = batches[k]
            _, grad = net.step(data[size][0][part].T, data[size][1][part])
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for name, w in weights.items():
                g = np.clip(grad[name], -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                w -= (rate * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample_tokens(_, keys: list, langs: list, texts: list):
    for key, lang, text in zip(keys, langs, texts, strict=True):
        tokens = text.lower().encode("utf-8").split()
        for i in range(min(SAMPLE_TOKENS, len(tokens))):
            yield lang, tokens[zlib.crc32(f"{key}:{i}".encode()) % len(tokens)]


def examples(docs: DataFrame, text: str = "text") -> list[tuple[str, bytes]]:
    """The bounded training sample: at most SAMPLE_DOCS * SAMPLE_TOKENS tokens of each of MAX_LANGS languages."""
    rows = pick(docs, "doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return []
    place = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(11))
    spread = F.lit(float(1 << 63))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * SAMPLE_DOCS / n))).otherwise(share)
    near = rows.withColumn("_h", place).filter((F.col("_h") / spread + 1) / 2 <= share)
    few = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).filter(F.col("_r") <= SAMPLE_DOCS)
    found = by_batch(few, sample_tokens, "lang string, token binary", "doc_id", "lang", "text")
    return sorted((r["lang"], bytes(r["token"])) for r in found.collect())


class Labeller:
    """A network with the memory of tokens it has read."""

    def __init__(self, net: Network | None):
        self.net = net
        self.number: dict[bytes, int] = {}
        self.sums = np.zeros((0, (len(net.langs) if net else 0) + 1))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.net is None:
            return [("und", 0.0)] * len(texts)
        if len(self.number) > CACHED:
            self.number, self.sums = {}, self.sums[:0]
        number, known = self.number, len(self.number)
        tokens = [t.lower().encode("utf-8").split() if t and LETTER.search(t) else [] for t in texts]
        ids = [[number.setdefault(w, len(number)) for w in own] for own in tokens]
        if len(number) > known:
            self.sums = np.concatenate([self.sums, self.net.sums(list(number)[known:])])
        out = []
        for own in ids:
            if not own:
                out.append(("und", 0.0))
                continue
            total = self.sums[own].sum(0)
            share = total[:-1] / total[-1]
            best = int(share.argmax())
            out.append((self.net.langs[best], float(min(1.0, max(0.0, share[best])))))
        return out


def labelled(labeller: Labeller, keys: list, held: list, texts: list):
    for key, h, (lang, score) in zip(keys, held, labeller.label(texts), strict=True):
        yield key, h, lang, score


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document; trains on the same frame if no network is given."""
    net = net or train(examples(docs))
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return by_batch(rows, labelled, "doc_id long, held_out boolean, lang_pred string, score double", "doc_id", "held_out", "text", ready=lambda: Labeller(shipped.value))


def relabels(labeller: Labeller, keys: list, texts: list, sources: list, sizes: list):
    for key, text, source, size, (lang, score) in zip(keys, texts, sources, sizes, labeller.label(texts), strict=True):
        yield key, text, lang, source, size, score


def relabelled(docs: DataFrame, least: float, net: Network | None = None) -> DataFrame:
    """The documents with ``lang`` as predicted, without those of no language or of a score under ``least``."""
    net = net or train(examples(docs))
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    out = by_batch(docs, relabels, DOCUMENT + ", score double", "doc_id", "text", "source", "n_chars", ready=lambda: Labeller(shipped.value))
    return out.filter((F.col("lang") != "und") & (F.col("score") >= least)).drop("score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
