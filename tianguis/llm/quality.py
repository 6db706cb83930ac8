"""Quality classifier: interpolated modified Kneser-Ney n-grams over text symbols.

A text becomes a sequence of symbols of an alphabet, a boundary, and one mark for a word that repeats
the word before it. In BYTES, which the queries use, each byte is a symbol of its own (256 symbols; boundary and
mark take the places of bytes that no UTF-8 text holds). FOLDED has SYMBOLS = 64: small letters, one class each for
capitals and digits, blank, line break, punctuation, classes of the bytes beyond ASCII. The model is of order 4;
with BYTES it grows with the n-grams of the trusted text.

1. The n-grams of trusted text (labelled quality 1) are counted over all of it; lower orders
   count distinct left neighbours. Discounts come from each order's counts of counts (four
   numbers an order are all that the driver sees), totals and freed mass from a grouping by context,
   and each order's probabilities from a join of its n-grams with their contexts and with
   the order below: the model is tables of seen n-grams, made by Spark.
2. One pass over all whole texts packs each document's n-gram counts by shard (shard:
   leading symbol, and a hash of all symbols but the last where that is not enough), dealt into blocks. There are as many shards as keep SHARD_GRAMS n-grams
   of the model in each, SHARDS at least, and as many blocks as keep BLOCK_BYTES / SHARDS of text in each shard of a block.
3. Order by order, the packed counts meet the model of their shard by a join on (shard, block), the model
   once per block, so what is joined grows with the text whatever the size of the model. An n-gram that is seen gives its log-probability; one that is not gives its context's
   freed mass, if the context is seen, and goes on to the order below without its first symbol. What a
   document has in all shards and orders is summed to its log-probability.
4. Thresholds come from exact quantiles of a language's trusted documents. The log
   perplexity of a text of n symbols varies with 1 / sqrt(n), so its distance from
   the language's median is taken times sqrt(n); rejected is what lies more than FENCE
   quartile distances above the median of that. A language with fewer than LEAST
   trusted documents takes the quantiles of all; ``threshold_of`` says which it was.

Defined cases: a null or empty text has only the boundary symbol and is kept; a null
language is a language of its own; rows repeated with one doc_id are scored each; a
label row whose document is missing does nothing, labels that disagree make a text
trusted if one of them is 1; without trusted text nothing is rejected; an empty table
gives an empty result; other columns are not looked at. ``docs`` must give its rows in the same
order when a part of it is read again after a lost executor, as a stored table does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import slices
from .common import give_back, lean, materialise, ship_package, spent, text_key
from .minhash import word_hashes

SYMBOLS, ORDER, SHARDS = 64, 4, 16
BITS = 6
BLOCK_BYTES = 128 << 20  # of text with SHARDS shards; the packed counts of a block and shard are one group of the joins
SHARD_GRAMS = 1 << 19  # n-grams of the highest order of the model in a shard, about
SLICE = 500_000  # characters of text that a worker counts at a time
FENCE, LEAST = 8.0, 200
BROADCAST_LABELS = 1_000_000  # trusted ids sent to all tasks up to this many, joined by shuffle beyond
BOUNDARY, BLANK, BREAK, REPEAT, DIGIT, CAPITAL = range(6)
_SPREAD = 0x9E3779B1  # contexts have 24 bits at most, so products stay below 2**56


class Alphabet(NamedTuple):
    """Symbol of each byte, in so many bits."""

    bits: int
    table: np.ndarray

    @property
    def symbols(self) -> int:
        return 1 << self.bits


def symbol_table() -> np.ndarray:
    """Symbol of each byte, folded to 64."""
    table = np.full(256, BREAK, dtype=np.uint8)
    table[32] = BLANK
    table[48:58] = DIGIT
    table[65:91] = CAPITAL
    table[97:123] = np.arange(6, 32)
    table[128:] = 32 + (np.arange(128, 256) & 15)
    for k, c in enumerate(b".,!?:;'\"-()|"):
        table[c] = 48 + k
    rest = [c for c in range(33, 127) if table[c] == BREAK]
    for c in rest:
        table[c] = 60 + (c & 3)
    return table


def byte_table() -> np.ndarray:
    """Symbol of each byte, all apart; the bytes 254 and 255 are in no UTF-8 text."""
    table = np.arange(256, dtype=np.uint8)
    table[[BOUNDARY, REPEAT]] = 255, 254
    return table


TABLE = symbol_table()
FOLDED, BYTES = Alphabet(BITS, TABLE), Alphabet(8, byte_table())


def symbols(texts: list[str | None], alphabet: Alphabet = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, document of each symbol); every text is followed by
    ORDER - 1 boundaries, of which the first belongs to it."""
    blobs = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0, *(len(b) + ORDER - 1 for b in blobs)])
    raw = np.frombuffer(b"".join(b + b"\n" * (ORDER - 1) for b in blobs), dtype=np.uint8)
    sym = alphabet.table[raw]
    doc = np.repeat(np.arange(len(blobs)), np.diff(at))
    for k in range(1, ORDER):
        sym[at[1:] - k] = BOUNDARY
    start, value = word_hashes(raw)
    same = np.flatnonzero((value[1:] == value[:-1]) & (doc[start[1:]] == doc[start[:-1]])) + 1
    if len(same):
        blank = np.flatnonzero((raw <= 32) & ((raw == 32) | ((raw >= 9) & (raw <= 13))))
        end = blank[np.searchsorted(blank, start[same])]
        gap = blank[np.searchsorted(blank, start[same - 1])]  # the mark stands for the blank before the word, too
        step = np.zeros(len(raw) + 1, dtype=np.int32)
        step[gap + 1] += 1
        step[end] -= 1
        keep = np.cumsum(step[:-1]) == 0
        sym[gap] = REPEAT
        sym, doc = sym[keep], doc[keep]
    return sym, doc


def grams(texts: list[str | None], alphabet: Alphabet = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram code) of every symbol and the closing boundary of each text."""
    sym, doc = symbols(texts, alphabet)
    lead = np.concatenate([np.zeros(ORDER - 1, np.uint8), sym]).astype(np.int64)
    code = lead[ORDER - 1:].copy()
    for k in range(1, ORDER):
        code |= lead[ORDER - 1 - k:len(lead) - k] << (alphabet.bits * k)
    closing = (code & (alphabet.symbols - 1)) == BOUNDARY
    before = np.concatenate([[BOUNDARY], sym[:-1]])
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    keep = ~closing | (before != BOUNDARY) | first
    return doc[keep], code[keep]


def shard_of(code: np.ndarray, order: int, alphabet: Alphabet = FOLDED, shards: int = SHARDS) -> np.ndarray:
    """Shard of n-grams: their leading symbol's, beyond SHARDS also their context's; single symbols
    share the empty context and so one shard."""
    if order == 1:
        return code * 0
    return (code >> alphabet.bits * (order - 1)) % SHARDS + SHARDS * (((code >> alphabet.bits) * _SPREAD >> 16) % (shards // SHARDS))


def pack(doc: np.ndarray, code: np.ndarray, n_docs: int, order: int = ORDER, times: np.ndarray | None = None,
         alphabet: Alphabet = FOLDED, shards: int = SHARDS) -> Iterator[tuple[int, bytes]]:
    """(shard, bytes) of the counted n-grams (each ``times`` if given): per document the number of
    entries, then per entry the step from the code before it and the count."""
    width = alphabet.bits * ORDER
    key = doc << width | code
    if times is None:
        key, count = np.unique(key, return_counts=True)
    else:
        by = np.argsort(key, kind="stable")
        key, first = np.unique(key[by], return_index=True)
        count = np.add.reduceat(times[by], first)
    d, c = key >> width, key & ((1 << width) - 1)
    shard = shard_of(c, order, alphabet, shards)
    squeeze = zstandard.ZstdCompressor(level=1)
    by = np.argsort(shard, kind="stable")
    for at in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
        if len(at):
            s, dd, cc = int(shard[at[0]]), d[at], c[at]
            first = np.flatnonzero(np.diff(dd, prepend=-1))
            step = np.diff(cc, prepend=0)
            step[first] = cc[first]
            planes = step.astype("<u4").view(np.uint8).reshape(-1, 4).T
            sizes = np.bincount(dd, minlength=n_docs).astype("<u4")
            yield s, squeeze.compress(np.array([n_docs, len(at)], "<u4").tobytes() + sizes.tobytes() + planes.tobytes() + count[at].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, count) of a shard's entries."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n_docs, n = raw[:8].view("<u4").tolist()
    sizes = raw[8:8 + 4 * n_docs].view("<u4").astype(np.int64)
    at = 8 + 4 * n_docs
    step = np.ascontiguousarray(raw[at:at + 4 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    count = np.ascontiguousarray(raw[at + 4 * n:at + 8 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    doc = np.repeat(np.arange(n_docs), sizes)
    total = np.cumsum(step)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    has = sizes > 0
    base = np.zeros(n_docs, np.int64)
    base[has] = total[start[has]] - step[start[has]]
    return doc, total - base[doc], count


def trusted_counts(docs: DataFrame, trusted: DataFrame, alphabet: Alphabet = FOLDED) -> DataFrame:
    """Table (code, n): counts of all n-grams of trusted documents."""
    ids = trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__trusted"), "left_semi").select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["text"].tolist(), SLICE):
                code, n = np.unique(grams(part, alphabet)[1], return_counts=True)
                yield pd.DataFrame({"code": code, "n": n})
    return materialise(texts.mapInPandas(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "kn-counts")


def discounts(levels: dict[int, DataFrame]) -> dict[int, list[float]]:
    """D1, D2, D3+ of each order from its counts of counts."""
    every = None
    for order, level in levels.items():
        row = level.agg(F.lit(order).alias("m"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
        every = row if every is None else every.unionByName(row)
    out = {}
    for m, n1, n2, n3, n4 in every.collect():
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        out[m] = [max(0.05, min(k, k - (k + 1) * y * b / a)) if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return out


def kneser_ney(counts: DataFrame, alphabet: Alphabet = FOLDED) -> dict[int, DataFrame]:
    """The model by order: table (code, p, b) of seen n-grams with their probability and the mass that
    their context frees. An n-gram that is not seen has b times the probability one order below
    (b = 1 if its context is not seen either); below single symbols all are alike.

    Highest order: counts; lower orders: numbers of distinct left neighbours."""
    bits, levels = alphabet.bits, {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):
        levels[m] = materialise(levels[m + 1].groupBy((F.col("code") % (1 << bits * m)).alias("code")).agg(F.count("*").alias("n")), "kn-level")
    cuts, model, below = discounts(levels), {}, None
    for m in range(1, ORDER + 1):
        rows = levels[m].withColumn("context", F.shiftright("code", bits))
        d1, d2, d3 = (F.lit(d) for d in cuts[m])
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), *(F.count_if(c).alias(k) for k, c in (
            ("k1", F.col("n") == 1), ("k2", F.col("n") == 2), ("k3", F.col("n") > 2)))).select(
            "context", "total", ((F.col("k1") * d1 + F.col("k2") * d2 + F.col("k3") * d3) / F.col("total")).alias("b"))
        rows = rows.join(contexts, "context").withColumn("suffix", F.col("code") % (1 << bits * (m - 1)))
        rows = rows.withColumn("low", F.lit(1.0 / alphabet.symbols)) if below is None else rows.join(
            below.select(F.col("code").alias("suffix"), F.col("p").alias("low")), "suffix")
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        below = model[m] = materialise(rows.select("code", ((F.col("n") - cut) / F.col("total") + F.col("b") * F.col("low")).alias("p"), "b"), "kn-model")
    return model


def sharded(level: DataFrame, order: int, alphabet: Alphabet = FOLDED, shards: int = SHARDS) -> DataFrame:
    """(shard, blob): the model's n-grams of a shard, in order of code."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("code")
        blob = b"".join(c.to_numpy().tobytes() for c in (rows["code"].astype("<i8"), np.log(rows["p"]).astype("<f8"), np.log(rows["b"]).astype("<f8")))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "blob": [zstandard.ZstdCompressor(level=3).compress(blob)]})
    shard = F.lit(0)
    if order > 1:  # as shard_of
        shard = F.shiftright("code", alphabet.bits * (order - 1)) % SHARDS + SHARDS * (
            F.shiftright(F.shiftright("code", alphabet.bits) * F.lit(_SPREAD), 16) % (shards // SHARDS))
    return level.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(run, "shard int, blob binary")


def packed_counts(docs: DataFrame, blocks: int, alphabet: Alphabet = FOLDED, shards: int = SHARDS) -> DataFrame:
    """For each run of documents (slice) one row of facts (shard -1) and one row per shard, dealt into blocks."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text", text_key().alias("text_key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        names = ["slice", "shard", "blob", "doc_id", "lang", "text_key", "n"]
        for batch in batches:
            at = 0
            for part in slices(batch["text"].tolist(), SLICE):
                own = batch.iloc[at:at + len(part)]
                at += len(part)
                doc, code = grams(part, alphabet)
                slice_id = (task << 32) + number
                number += 1
                n = np.bincount(doc, minlength=len(part))
                out = [(slice_id, -1, None, own["doc_id"].tolist(), own["lang"].tolist(), own["text_key"].tolist(), n.tolist())]
                out += [(slice_id, s, blob, None, None, None, None) for s, blob in pack(doc, code, len(part), alphabet=alphabet, shards=shards)]
                yield pd.DataFrame(out, columns=names)
    return rows.mapInPandas(lean(run), "slice long, shard int, blob binary, doc_id array<string>, lang array<string>, text_key array<long>, n array<long>").withColumn(
        "block", F.pmod(F.xxhash64("slice"), F.lit(blocks)).cast("int"))


def _list(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


JOINED = {"block": ("int", pa.int32()), "slice": ("long", pa.int64()), "shard": ("int", pa.int32()), "blob": ("binary", pa.binary()),
          "doc_id": ("array<string>", _list(pa.string())), "lang": ("array<string>", _list(pa.string())),
          "text_key": ("array<long>", _list(pa.int64())), "n": ("array<long>", _list(pa.int64())),
          "of": ("array<long>", _list(pa.int64())), "place": ("array<int>", _list(pa.int32())), "micro": ("array<long>", _list(pa.int64()))}
CHUNK = 500_000  # packed entries that are looked up at a time


def chunks(left: pa.Table, order: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, code, count, slice of each document, its place there) of some rows of packed counts at a time."""
    held, docs, size = [], 0, 0
    for k in range(len(left)):
        doc, code, count = unpack(left["blob"][k].as_py())
        here = int(doc[-1]) + 1
        if order == ORDER:
            of, place = np.full(here, left["slice"][k].as_py()), np.arange(here)
        else:
            of, place = (left[c][k].values.to_numpy(zero_copy_only=False) for c in ("of", "place"))
        held.append((doc + docs, code, count, of, place))
        docs, size = docs + here, size + len(doc)
        if size >= CHUNK:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, docs, size = [], 0, 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def met(packed: DataFrame, level: DataFrame, order: int, blocks: int, alphabet: Alphabet = FOLDED, shards: int = SHARDS) -> DataFrame:
    """Packed counts joined with the model of one order on (shard, block). Rows of sums (of, place:
    the documents, micro: millionths of log-probability), packed counts that go on to the order below
    (shard, blob, with of and place of the blob's documents); rows of facts pass."""
    bits = alphabet.bits

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in JOINED}
        if key[0].as_py() < 0:
            return pa.table({name: left[name].cast(kind) if name in left.column_names else pa.nulls(len(left), kind) for name, (_, kind) in JOINED.items()})
        raw = [zstandard.ZstdDecompressor().decompress(b) for b in right["blob"].to_pylist()]
        codes, logp, logb = (np.concatenate([np.frombuffer(r, t).reshape(3, -1)[k] for r in raw] or [np.zeros(0, t)]) for k, t in enumerate(("<i8", "<f8", "<f8")))
        codes = np.append(codes, 1 << 62)

        def add(**values):
            for name in out:
                out[name].append(values.get(name))
        for doc, code, count, of, place in chunks(left, order):
            at = np.searchsorted(codes, code)
            seen = codes[at] == code
            value = np.zeros(len(code))
            value[seen] = logp[at[seen]]
            miss = np.flatnonzero(~seen)
            if len(miss):
                context = code[miss] >> bits
                first = np.searchsorted(codes, context << bits)
                known = codes[first] >> bits == context
                value[miss[known]] = logb[first[known]]
                if order == 1:
                    value[miss] -= math.log(alphabet.symbols)
                else:
                    suffix = code[miss] & ((1 << bits * (order - 1)) - 1)
                    goes = shard_of(suffix, order - 1, alphabet, shards)
                    for s in np.unique(goes):
                        mine = goes == s
                        own, number = np.unique(doc[miss[mine]], return_inverse=True)
                        for _, rest in pack(number, suffix[mine], len(own), order - 1, count[miss[mine]], alphabet, shards):
                            add(block=key[1].as_py(), shard=int(s), blob=rest, of=of[own], place=place[own])
            total = np.bincount(doc, weights=count * value)
            hit = np.unique(doc)
            add(of=of[hit], place=place[hit], micro=np.rint(total[hit] * 1e6).astype(np.int64))
        give_back()
        return pa.table({name: pa.array(out[name], kind) for name, (_, kind) in JOINED.items()})
    model = sharded(level, order, alphabet, shards).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block"]
    return packed.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in JOINED.items()))


def dealt(size: int, n_grams: int) -> tuple[int, int]:
    """(shards, blocks) for so many bytes of text and so many n-grams of the model."""
    shards = SHARDS
    while shards * SHARD_GRAMS < n_grams:
        shards *= 2
    return shards, size * SHARDS // (BLOCK_BYTES * shards) + 1


def scored(docs: DataFrame, trusted: DataFrame, alphabet: Alphabet = FOLDED) -> DataFrame:
    """One row per document: doc_id, text_key, lang, n (symbols), trusted, log_perplexity."""
    counts = trusted_counts(docs, trusted, alphabet)
    model = kneser_ney(counts, alphabet)
    shards, blocks = dealt(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, counts.count())
    rest, facts, sums = packed_counts(docs, blocks, alphabet, shards), None, None
    for order in range(ORDER, 0, -1):
        out = materialise(met(rest, model[order], order, blocks, alphabet, shards), "kn-met")
        facts = out.where("shard = -1") if facts is None else facts
        part = out.where("micro is not null").select("of", "place", "micro")
        sums = part if sums is None else sums.unionByName(part)
        rest = out.where("shard >= 0").select("block", "shard", "blob", "of", "place")
    totals = sums.selectExpr("inline(arrays_zip(of, place, micro))").withColumnRenamed("of", "slice").groupBy("slice", "place").agg(F.sum("micro").alias("micro"))
    facts = facts.selectExpr("slice", "posexplode(arrays_zip(doc_id, lang, text_key, n)) as (place, f)").select("slice", "place", "f.*")
    ids = trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct()
    out = facts.join(totals, ["slice", "place"]).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).join(
        ids, F.col("doc_id") == F.col("__trusted"), "left").select(
        "doc_id", "text_key", "lang", "n", F.col("__trusted").isNotNull().alias("trusted"),
        F.round(-F.col("micro") / 1e6 / F.col("n"), 6).alias("log_perplexity"))
    return materialise(out, "kn-scored")


def _quantiles(rows: DataFrame, keys: list[str], value: str, grid: int, tag: str) -> DataFrame:
    """Exact median and upper quartile of a value on a grid of 1 / ``grid``, from counts by value:
    what a window sorts is bounded by the grid, not by the documents."""
    counts = rows.groupBy(*keys, F.round(F.col(value) * grid).cast("long").alias("v")).agg(F.count("*").alias("m"))
    by = [F.col(k) for k in keys] or [F.lit(0)]
    run = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("v"))).withColumn("all", F.sum("m").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("v"))) / grid
    return materialise(run.groupBy(*keys).agg(at(0.5).alias("mid"), at(0.75).alias("high"), F.max("all").alias("docs")), tag)


def _by_language(rows: DataFrame, value: str, grid: int, name: str) -> DataFrame:
    """Adds ``name_mid`` and ``name_high`` of the row's language, or of all trusted
    text where a language has fewer than LEAST trusted documents, and ``name_of``: language, all, or
    null without trusted text."""
    good = rows.where("trusted")
    own = _quantiles(good, ["language"], value, grid, "kn-quantiles").where(F.col("docs") >= LEAST).select(
        "language", F.col("mid").alias("m1"), F.col("high").alias("h1"))
    every = _quantiles(good, [], value, grid, "kn-quantiles").select(F.col("mid").alias("m0"), F.col("high").alias("h0")).first()
    m0, h0 = every if every else (None, None)
    return rows.join(own, "language", "left").withColumns({
        f"{name}_mid": F.coalesce("m1", F.lit(m0).cast("double")), f"{name}_high": F.coalesce("h1", F.lit(h0).cast("double")),
        f"{name}_of": F.when(F.col("m1").isNotNull(), "language").when(F.lit(m0 is not None), "all")}).drop("m1", "h1")


def decided(scores: DataFrame) -> DataFrame:
    """Adds perplexity, threshold (of the log perplexity, null without trusted text), threshold_of
    (whose quantiles gave it: language, all or null) and kept."""
    rows = scores.withColumn("language", F.coalesce("lang", F.lit("")))
    rows = _by_language(rows, "log_perplexity", 1000, "x")
    rows = rows.withColumn("z", (F.col("log_perplexity") - F.col("x_mid")) * F.sqrt("n"))
    rows = _by_language(rows, "z", 100, "z")
    fence = F.col("z_mid") + FENCE * F.greatest(F.col("z_high") - F.col("z_mid"), F.lit(0.1))
    threshold = F.round(F.col("x_mid") + fence / F.sqrt("n"), 6)
    kept = threshold.isNull() | (F.col("n") <= 1) | (F.col("log_perplexity") <= threshold)
    return rows.select("doc_id", "text_key", "lang", "n", "trusted", "log_perplexity", F.exp("log_perplexity").alias("perplexity"),
                       threshold.alias("threshold"), F.col("z_of").alias("threshold_of"), kept.alias("kept"))


def classified(docs: DataFrame, labels: DataFrame, alphabet: Alphabet = FOLDED) -> DataFrame:
    """One row per document with its perplexity, its threshold and the decision."""
    return decided(scored(docs, labels.where("quality = 1"), alphabet))


def accepted(docs: DataFrame, labels: DataFrame, alphabet: Alphabet = FOLDED) -> DataFrame:
    """``docs`` without the rejected documents. Texts meet the decisions in one exchange, of the
    same form at every size."""
    ship_package(docs.sparkSession)
    with spent(docs.sparkSession):
        out = materialise(classified(docs, labels, alphabet).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k")).distinct(),
                          "kn-rejected", lasting=True)
    key = "__text_key"
    return docs.withColumn(key, text_key()).join(
        out.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(key) == F.col("__k")), "left_anti").drop(key)
