"""Target-distribution importance resampling over hashed n-grams, by prefix CRCs.

Features of a text are all runs of 1 to 3 consecutive words (A-Z lower-cased, words are
runs of digits, letters and bytes beyond ASCII), joined by one space and counted with
repeats; a feature's bucket is its CRC-32 modulo ``buckets``. No n-gram is ever built:
each separator-normalised text is scanned once, word by word, and the running CRC before
and after every word is stored. With C the CRC of a prefix and shift_n the appending of n
zero bytes, a linear map over GF(2), the CRC of a substring is
C(end) xor shift_(end - start)(C(start)): everything before the substring cancels. Shifts
come from byte tables, one for each length below 64 and one for each power of two above,
so every length is exact.

1. Bucket counts of the raw rows and of the target rows: each task sums its own, Spark
   adds them. They are ``buckets`` numbers each, whatever the input, and go to the driver.
2. A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); a
   second scan adds up the gains of each text's features (its weight).
3. score = weight + Gumbel noise from a hash of the document's id; the highest scores
   among texts of at least ``least_words`` words are drawn without replacement. Ranks come
   from one range partitioning by score and the partitions' row counts, so no task sorts
   more than its range.

Defined cases: a null or empty text has no features and weight 0; it is returned, never
drawn; the hash of a null doc_id is that of the seed with nothing after the colon; rows
repeated with one doc_id are scored alike and each takes a rank of its own; an empty target gives
gains from the raw rows alone; empty tables give empty results; other columns are not
looked at. Texts are processed in pieces of ``PIECE`` bytes cut between words, whatever
their length. Floors of logarithms are taken in doubles.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ship_package

LONGEST = 3          # words of a feature
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
PIECE = 1 << 20      # bytes of text that are scanned at a time
_BYTES = 64          # shifts below this many bytes have tables of their own

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _shift_one(c: np.ndarray) -> np.ndarray:
    """CRC registers after one more zero byte."""
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _tables(basis: np.ndarray) -> np.ndarray:
    """Byte tables (4, 256) of the linear map that sends bit k to ``basis[k]``."""
    out = np.zeros((4, 256), dtype=np.uint32)
    values = np.arange(256)
    for k in range(32):
        out[k // 8] ^= np.where(values >> (k % 8) & 1, basis[k], 0).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


@functools.cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to 63 zero bytes, and for 64, 128, 256, ... of them."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    short = []
    for _ in range(_BYTES):
        short.append(_tables(basis))
        basis = _shift_one(basis)
    power = []
    for _ in range(34):
        power.append(_tables(basis))
        basis = _apply(power[-1], basis)
    return np.stack(short), power


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs ``c`` of texts, followed by ``n`` zero bytes each (without the final step)."""
    short, power = _shifts()
    low = n % _BYTES
    out = short[low, 0, c & 255] ^ short[low, 1, c >> 8 & 255] ^ short[low, 2, c >> 16 & 255] ^ short[low, 3, c >> 24]
    high, k = n // _BYTES, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        if len(odd):
            out[odd] = _apply(power[k], out[odd])
        high, k = high >> 1, k + 1
    return out


def _pieces(text: bytes | None) -> Iterator[bytes]:
    """The normalised text in pieces of about PIECE bytes, cut at separators."""
    if not text:
        return
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        piece = text[at:end].translate(_NORMAL)
        while end < len(text):  # the last word goes on
            more = text[end:end + PIECE].translate(_NORMAL)
            cut = more.find(b" ")
            if cut >= 0:
                piece, end = piece + more[:cut], end + cut
                break
            piece, end = piece + more, end + len(more)
        yield piece
        at = end


def _features(words: list[bytes], rows: np.ndarray, new: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the features that end in a word marked ``new``, by length.

    ``rows`` names the text of each word: features do not go from one text to the next."""
    n = len(words)
    after = np.fromiter(accumulate(words, lambda c, w: zlib.crc32(b" " + w, c), initial=0), np.uint32, n + 1)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1)
    starts = ends - size
    # the CRC before a word is the one after the word before it and one space
    low = np.uint32(0xFFFFFFFF)
    before = after[:-1] ^ low
    before = (_space()[(before ^ 32) & 255] ^ (before >> 8)) ^ low
    for length in range(1, LONGEST + 1):
        last = np.arange(length - 1, n)
        first = last - (length - 1)
        take = new[last] & (rows[first] == rows[last])
        last, first = last[take], first[take]
        crc = after[last + 1] ^ shifted(before[first], ends[last] - starts[first])
        yield rows[last], (crc % np.uint32(buckets)).astype(np.int64)


@functools.cache
def _space() -> np.ndarray:
    return _shift_one(np.arange(256, dtype=np.uint32))


def _scan(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, words of each row) for groups of texts or pieces; every feature once."""
    words, rows, new, held = [], [], [], 0

    def flush():
        r = np.repeat(np.array(rows, dtype=np.int64), np.array([len(w) for w in words], dtype=np.int64))
        flat = [w for group in words for w in group]
        fresh = np.concatenate(new)
        count = np.bincount(r[fresh], minlength=len(texts))
        found = list(_features(flat, r, fresh, buckets))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), count

    for row, text in enumerate(texts):
        tail: list[bytes] = []
        for piece in _pieces(text):
            got = piece.split()
            if not got:
                continue
            words.append(tail + got)
            rows.append(row)
            new.append(np.arange(len(tail) + len(got)) >= len(tail))
            tail = (tail + got)[-(LONGEST - 1):]
            held += len(piece)
            if held >= PIECE:
                yield flush()
                words, rows, new, held = [], [], [], 0
    if words:
        yield flush()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in _scan(batch["text"].tolist(), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = (docs.where("text <> ''").select(F.col("text").cast("binary").alias("text"))
            .mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, dtype=np.int64)  # one number a bucket, whatever the input
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of a bucket's share in target and raw, floored."""
    n = len(raw)
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with n_words, n_features and weight of every row."""
    ship_package(docs.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            word = np.zeros(n, dtype=np.int64)
            features, weight = np.zeros(n), np.zeros(n)
            for row, bucket, words in _scan(batch["__text"].tolist(), len(gain)):
                word += words
                features += np.bincount(row, minlength=n)
                weight += np.bincount(row, weights=gain[bucket], minlength=n)  # whole numbers, exact below 2^53
            out = batch.drop(columns="__text")
            yield out.assign(__words=word, __features=features.astype(np.int64), __weight=weight.astype(np.int64))

    return (docs.select(*keep, F.col("text").cast("binary").alias("__text"))
            .mapInPandas(weigh, f"{schema}, __words long, __features long, __weight long"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, n_features, weight, score, rank) of every row of ``docs(doc_id, text)``;
    rank is null where the row was not drawn. ``target(text)`` gives the target distribution."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    w = weights(keyed, gain, ["doc_id", "text_key"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    order = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    # written first: finding the ranges reads the rows once more
    scored = materialise(w.withColumnsRenamed({"__words": "n_words", "__features": "n_features", "__weight": "weight"})
                         .withColumn("score", F.col("weight") + noise), "importance-weights")
    # the range a row fell in is written with it, so that a lost task cannot change it
    laid = materialise(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    parts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") >= least_words).alias("fit"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
                         F.floor(F.sum("fit").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = laid.join(parts, "part").withColumn("place", place)
    return ranked.select("doc_id", "text_key", "n_features", "weight", "score",
                         F.when((F.col("n_words") >= least_words) & (F.col("place") <= F.col("drawn")), F.col("place")).cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; of rows that agree in doc_id and text
    as many as were drawn."""
    picked = resampled(docs, target, **parameters).where("rank is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("__times"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    same = Window.partitionBy("doc_id", "__key").orderBy(F.lit(1))
    d, p = docs.withColumn("__key", key), picked.withColumnsRenamed({"doc_id": "__id", "text_key": "__tk"})
    hit = d.join(p, (d["__key"] == p["__tk"]) & d["doc_id"].eqNullSafe(p["__id"]))
    return hit.withColumn("__no", F.row_number().over(same)).where("__no <= __times").select(*docs.columns)


def oracle(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """DuckDB SQL for ``resampled``: every n-gram is built and its CRC folded byte by byte."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def grams(table: str, key: str) -> str:
        words = f"SELECT {key}, regexp_extract_all(translate(text, '{capitals}', '{small}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
        at = "unnest(range(1, len(w) + 1)) AS i"
        return f"""(SELECT {key}, array_to_string(w[i:i + k - 1], ' ') AS gram
            FROM (SELECT {key}, w, {at} FROM ({words})), range(1, {LONGEST + 1}) ks(k) WHERE i + k - 1 <= len(w))"""

    return f"""
    WITH RECURSIVE step(i, k, c) AS (
        SELECT i, 0, i FROM range(256) r(i)
        UNION ALL
        SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
    bytes AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    raw AS (SELECT r, gram, count(*) AS n FROM {grams("docs", "r")} GROUP BY ALL),
    goal AS (SELECT gram, count(*) AS n FROM {grams("benchmark", "0 AS r")} GROUP BY gram),
    crc AS (
        SELECT gram, xor(list_reduce(list_transform(range(octet_length(encode(gram))),
                   lambda j: ('0x' || substr(hex(encode(gram)), 2 * j + 1, 2))::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {buckets} AS bucket
        FROM (SELECT gram FROM raw UNION SELECT gram FROM goal), bytes),
    s AS (SELECT bucket, sum(n) AS n FROM raw JOIN crc USING (gram) GROUP BY bucket),
    t AS (SELECT bucket, sum(n) AS n FROM goal JOIN crc USING (gram) GROUP BY bucket),
    gain AS (
        SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {buckets})::DOUBLE
            / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {buckets})::DOUBLE)))::BIGINT AS gain
        FROM range({buckets}) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    weight AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM raw JOIN crc USING (gram) JOIN gain USING (bucket) GROUP BY r),
    scored AS (
        SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score,
               len(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) >= {least_words} AS fit
        FROM (SELECT *, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM docs)
        LEFT JOIN weight USING (r)),
    placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE fit)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM placed
    UNION ALL
    SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE fit IS NOT TRUE"""
