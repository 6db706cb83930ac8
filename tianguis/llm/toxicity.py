"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is its words, which are runs of letters; a run of more than PIECE letters (text without
blanks) enters as pieces of PIECE letters that overlap by half, each as a word. Each word enters as the sum of a learned word vector (hashed) and the
maximum, by component, of learned vectors of its character n-grams (3 to 5 bytes, and 6 to
8 from the word's start; with edge marks, hashed). Two
gated recurrent layers read a window of WINDOW words from both ends, attention pools
their states, and a logistic unit scores the window. Windows overlap by half and cover
every whole text; a document's score is that of its highest window.

The network is trained in numpy on a bounded sample of labelled documents: at most
TRAIN_EACH of either class in hash order, none of more than TRAIN_WORDS words or pieces, and only rows with
crc32(doc_id) mod 5 <> 0. Training alternates between finding the highest windows of the
sample and descending on them. The vectors start from smoothed log-odds of their bucket in
the sample, less 1.5 standard errors. Label, language, source and id are never inputs.

Defined cases: a null or empty text or one without words has no window and gets the share of
toxic documents in the sample, at most 0.49; without labels of both classes every text gets
that; rows repeated with one doc_id are scored each; a null doc_id counts as held out;
disagreeing labels of one doc_id count as toxic; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices

WINDOW, STRIDE = 32, 16
BUCKETS, WIDTH, HIDDEN = 131_072, 8, 8
TRAIN_EACH, TRAIN_WORDS = 2_500, 1_500
EPOCHS, STEPS, BATCH, RATE, SEED = 5, 120, 256, 0.01, 5  # at least so many epochs and steps
REMEMBER = 200_000  # words whose projections a task keeps
PIECE = 64  # letters of a run that enter as one word
PART = 4_096  # words whose n-grams are held at a time

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = _WORDS.findall(text.lower()) if isinstance(text, str) else []
    if max(map(len, words), default=0) > PIECE:
        words = [p for w in words for p in pieces(w)]
    return words


def pieces(word: str) -> list[str]:
    """Overlapping pieces that cover a long word; any half a piece of it is whole in one of them."""
    return [word] if len(word) <= PIECE else [word[a:a + PIECE] for a in range(0, len(word) - PIECE // 2, PIECE // 2)]


_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], dtype=np.uint64)


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams of 3 to 5 bytes of the words with edge marks and of
    their first 6 to 8 bytes, by word."""
    blobs = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs))
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(blobs)), sizes)
    found, owners = [], []
    opens = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(raw) else np.zeros(0, bool)
    for n in range(3, 9):
        if len(raw) < n:
            continue
        inside = owner[n - 1:] == owner[:len(raw) - n + 1]
        if n > 5:
            inside &= opens[:len(raw) - n + 1]
        value = np.full(len(raw) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            value += (raw[k:len(raw) - n + 1 + k] + np.uint64(1)) * _MUL[k]
        value = (value ^ (value >> np.uint64(15))) * _MUL[0]
        found.append(((value >> np.uint64(12)) % np.uint64(BUCKETS)).astype(np.int64)[inside])
        owners.append(owner[n - 1:][inside])
    found, owners = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return found[order].astype(np.int32), owners[order].astype(np.int32)


def word_bucket(word: str) -> int:
    return zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS


class WordTable:
    """Numbers of the words met so far."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.fresh: list[str] = []

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word numbers of each text; words not met before are listed in ``fresh``."""
        split = [words_of(t) for t in texts]
        new = sorted(w for w in set().union(*split) if w not in self.index) if split else []
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.fresh += new
        get = self.index.__getitem__
        return [np.fromiter(map(get, w), dtype=np.int64, count=len(w)) for w in split]

    def flat(self, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word buckets, character buckets, word of each of those) of the fresh words, or the first of them."""
        most = len(self.fresh) if most is None else most
        new, self.fresh = self.fresh[:most], self.fresh[most:]
        return (np.fromiter(map(word_bucket, new), dtype=np.int64, count=len(new)), *char_buckets(new))


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the network's bounded unit; its slope is (1 - |squash|) ** 2."""
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1; slope 2 * (min(gate, 1 - gate)) ** 2."""
    return squash(x) * 0.5 + 0.5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = lambda *s, a: (rng.standard_normal(s) * a).astype(np.float32)
        h, d = HIDDEN, WIDTH
        self.p = {
            "word": f(BUCKETS, d, a=0.05), "char": f(BUCKETS, d, a=0.05), "b": np.zeros((2, 3 * h), np.float32),
            "w": f(2, d, 3 * h, a=0.4), "u": f(2, h, 3 * h, a=0.3), "a": f(2 * h, 2 * h, a=0.3), "v": f(2 * h, a=0.3), "o": f(2 * h, a=0.4), "c": np.full(1, -1.0, np.float32)}
        self.base = 0.1
        self.trained = False

    def inputs(self, word: np.ndarray, chars: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Vector of each word: its own plus the maximum over its character n-grams."""
        return self.p["word"][word] + self.char_part(len(word), chars, owner)

    def char_part(self, n: int, chars: np.ndarray, owner: np.ndarray) -> np.ndarray:
        top = np.zeros((n, WIDTH), np.float32)
        if len(owner):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            ends = np.append(starts[1:], len(owner))
            for a in range(0, len(starts), 16_384):  # bounds the gathered vectors
                own = starts[a:a + 16_384]
                part = chars[own[0]:ends[a + len(own) - 1]]
                top[owner[own]] = np.maximum.reduceat(self.p["char"][part], own - own[0], axis=0)
        return top

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input part of the gates of both directions: (n, 2, 3 * HIDDEN)."""
        return np.einsum("nd,kde->nke", x, self.p["w"], optimize=True) + self.p["b"][None]

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window scores from gate inputs (steps, windows, 2, 3 * HIDDEN) and a mask (steps, windows)."""
        steps, n = mask.shape
        h = HIDDEN
        states = np.empty((steps, n, 2 * h), np.float32)
        saved: list = [[], []]
        for k in (0, 1):
            u, prev = self.p["u"][k], np.zeros((n, h), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                x, m = gates[t, :, k], mask[t][:, None]
                hu = prev @ u
                zr = gate(x[:, :2 * h] + hu[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = squash(x[:, 2 * h:] + r * hu[:, 2 * h:])
                new = c + z * (prev - c)
                new = prev + m * (new - prev)
                if keep:
                    saved[k].append((t, prev, z, r, c, hu[:, 2 * h:]))
                states[t, :, k * h:(k + 1) * h] = new
                prev = new
        inner = squash(states.reshape(-1, 2 * h) @ self.p["a"]).reshape(steps, n, 2 * h)
        score = inner @ self.p["v"] + (mask - 1) * 30
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (states, saved, inner, weight, pooled)) if keep else logit

    def backward(self, gates: np.ndarray, mask: np.ndarray, cache, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all but the input vectors, and the gradient of the gate inputs."""
        states, saved, inner, weight, pooled = cache
        h = HIDDEN
        g = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * self.p["o"]
        d_states = weight[:, :, None] * d_pool[None]
        d_weight = np.einsum("tnh,nh->tn", states, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tnh,tn->h", inner, d_score)
        d_inner = (d_score[:, :, None] * self.p["v"]) * (1 - np.abs(inner)) ** 2
        g["a"] = np.einsum("tnh,tnk->hk", states, d_inner)
        d_states = d_states + d_inner @ self.p["a"].T
        g["u"] = np.zeros_like(self.p["u"])
        d_gates = np.zeros_like(gates)
        for k in (0, 1):
            u, d_next = self.p["u"][k], np.zeros((mask.shape[1], h), np.float32)
            for t, prev, z, r, c, hn in reversed(saved[k]):
                m = mask[t][:, None]
                d = d_next + d_states[t, :, k * h:(k + 1) * h]
                d_new, d_prev = d * m, d * (1 - m)
                d_c = d_new * (1 - z) * (1 - np.abs(c)) ** 2
                d_z = d_new * (prev - c) * 2 * np.minimum(z, 1 - z) ** 2
                d_r = d_c * hn * 2 * np.minimum(r, 1 - r) ** 2
                d_gate = np.concatenate([d_z, d_r, d_c], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_gates[t, :, k] = d_gate
                g["u"][k] += prev.T @ d_hu
                d_next = d_prev + d_new * z + d_hu @ u.T
        return g, d_gates


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows over n words; together they cover all."""
    if n <= 0:
        return []
    last = max(0, -(-(n - WINDOW) // STRIDE)) * STRIDE
    return [(a, min(a + WINDOW, n)) for a in range(0, last + 1, STRIDE)]


def window_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows (windows, WINDOW), mask, document) of all windows of some documents."""
    doc, start, length, at = [], [], [], 0
    for k, r in enumerate(rows):
        n = len(r)
        if n:
            first = np.arange(0, max(0, -(-(n - WINDOW) // STRIDE)) * STRIDE + 1, STRIDE)
            doc.append(np.full(len(first), k))
            start.append(first + at)
            length.append(np.minimum(n - first, WINDOW))
        at += n
    if not doc:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.float32), np.zeros(0, np.int64)
    doc, start, length = np.concatenate(doc), np.concatenate(start), np.concatenate(length)
    mask = np.arange(WINDOW)[None] < length[:, None]
    flat = np.concatenate(rows)
    return flat[np.minimum(start[:, None] + np.arange(WINDOW)[None], len(flat) - 1)], mask.astype(np.float32), doc


def scores_of(net: Network, gates: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(highest window score, that window) of each document; -inf where there is none."""
    word, mask, doc = window_rows(rows)
    logit = np.empty(len(word), np.float32)
    for a in range(0, len(word), 1024):
        w = word[a:a + 1024].T
        logit[a:a + 1024] = net.forward(gates[w], np.ascontiguousarray(mask[a:a + 1024].T))
    best = np.full(len(rows), -np.inf, np.float32)
    np.maximum.at(best, doc, logit)
    order = np.lexsort((-logit, doc))
    first = np.full(len(rows), -1)
    lead = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    first[doc[lead]] = lead
    return best, first


def train(texts: list[str], toxic: np.ndarray) -> Network:
    net = Network()
    toxic = np.asarray(toxic, dtype=np.float32)
    if len(toxic):
        net.base = float(min(0.49, toxic.mean()))
    if not len(toxic) or toxic.min() == toxic.max():
        return net
    table = WordTable()
    rows = table.rows(texts)
    full = np.array([len(r) > 0 for r in rows])
    rows, toxic = [r for r, ok in zip(rows, full) if ok], toxic[full]
    if not len(toxic) or toxic.min() == toxic.max():
        return net
    word, chars, owner = table.flat()
    # start: smoothed log-odds of each bucket by documents
    for name, by_word in (("word", True), ("char", False)):
        pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
        edges = np.searchsorted(owner, np.arange(len(word) + 1))
        for r, y in zip(rows, toxic):
            own = np.unique(r)
            if by_word:
                hit = np.unique(word[own])
            else:
                sizes = edges[own + 1] - edges[own]
                hit = np.unique(chars[np.repeat(edges[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())])
            (pos if y else neg)[hit] += 1
        n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
        odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
        sure = np.maximum(0, np.abs(odds) - 1.5 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))
        net.p[name][:, 0] += np.clip(np.sign(odds) * sure / 2, -2, 2).astype(np.float32)
    rng = np.random.default_rng(SEED + 1)
    all_word, all_mask, all_doc = window_rows(rows)
    by_doc = np.searchsorted(all_doc, np.arange(len(rows) + 1))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    weight = np.where(toxic > 0, 0.5 / max(toxic.mean(), 1e-3), 0.5 / max(1 - toxic.mean(), 1e-3)).astype(np.float32)
    top = None
    epochs = max(EPOCHS, -(-STEPS * BATCH // (2 * len(rows))))
    for epoch in range(epochs):
        if epoch in (0, 1, epochs // 2, epochs * 3 // 4):
            if epoch == 0:  # the window whose words have the highest starting log-odds
                first = net.inputs(word, chars, owner)[:, 0]
                value = (first[all_word] * all_mask).max(axis=1) * 10 + (first[all_word] * all_mask).mean(axis=1)
                order = np.lexsort((-value, all_doc))
                top = order[np.flatnonzero(np.diff(all_doc[order], prepend=-1))]
            else:
                top = scores_of(net, net.project(net.inputs(word, chars, owner)), rows)[1]
        spare = by_doc[:-1] + (rng.random(len(rows)) * np.diff(by_doc)).astype(np.int64)
        clean = toxic == 0
        use = np.concatenate([top, spare[clean]])
        goal = np.concatenate([toxic, toxic[clean]])
        share = np.concatenate([weight, weight[clean] * 0.5])
        order = rng.permutation(len(use))
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            w, mask = all_word[use[part]].T, np.ascontiguousarray(all_mask[use[part]].T)
            own, at = np.unique(w, return_inverse=True)
            at = at.reshape(w.shape)
            chosen = np.full(len(word), -1, np.int32)
            chosen[own] = np.arange(len(own))
            near = chosen[owner] >= 0
            own_chars, own_owner = chars[near], chosen[owner[near]]
            x = net.inputs(word[own], own_chars, own_owner)
            gates = net.project(x)[at]
            logit, cache = net.forward(gates, mask, keep=True)
            d = ((sigmoid(logit) - goal[part]) * share[part] / len(part)).astype(np.float32)
            g, d_gates = net.backward(gates, mask, cache, d)
            flat = np.zeros((len(own), 2, 3 * HIDDEN), np.float32)
            np.add.at(flat, at.ravel(), d_gates.reshape(-1, 2, 3 * HIDDEN))
            g["w"] = np.einsum("nd,nke->kde", x, flat)
            g["b"] = flat.sum(axis=0)
            d_x = np.einsum("nke,kde->nd", flat, net.p["w"])
            leads = net.p["char"][own_chars] == net.char_part(len(own), own_chars, own_owner)[own_owner]
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], word[own], d_x)
            np.add.at(g["char"], own_chars, d_x[own_owner] * leads)
            step += 1
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.p[k] -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    net.trained = True
    return net


class Scorer:
    """Scores texts; keeps the projections of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.table, self.gates = WordTable(), np.zeros((0, 2, 3 * HIDDEN), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not self.net.trained:
            return np.full(len(texts), self.net.base)
        if len(self.table.index) > REMEMBER:
            self.table, self.gates = WordTable(), np.zeros((0, 2, 3 * HIDDEN), np.float32)
        rows = self.table.rows(texts)
        new = []
        while self.table.fresh:
            new.append(self.net.project(self.net.inputs(*self.table.flat(PART))))
        if new:
            self.gates = np.concatenate([self.gates, *new])
        best = scores_of(self.net, self.gates, rows)[0].astype(np.float64)
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -40, 40))), self.net.base)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """(text, toxic) of the bounded training sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_EACH) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).where(F.size(F.split("text", r"\s+")) <= TRAIN_WORDS)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(4 * TRAIN_EACH)
    # long runs count by their pieces; after the limit, so that only the sample is looked at
    rows = rows.where(F.expr(rf"aggregate(regexp_extract_all(text, '\\p{{L}}{{{PIECE + 1},}}', 0), cast(size(split(text, '\\s+')) as bigint), (n, w) -> n + length(w) div {PIECE // 2})") <= TRAIN_WORDS)
    return rows.select("text", F.col("__toxic").alias("toxic")).toPandas()


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sample = training_sample(docs, labels)
    net = train(sample["text"].tolist(), sample["toxic"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at = 0
            for part in slices(batch["text"].tolist(), 1_000_000):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:at + len(part)].tolist(), "held_out": batch["held_out"].iloc[at:at + len(part)].tolist(), "score": scorer(part)})
                at += len(part)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), "text").mapInPandas(
        run, "doc_id string, held_out boolean, score double").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
