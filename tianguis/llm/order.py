"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride shards.

1. Texts are encoded once (a public byte-level vocabulary), closed with an end mark and cut into
   sequences of LENGTH ids; the last of a document is padded. The ids are written, compressed,
   in rows of some documents each, with their task and place in it.
2. A sequence's number is the count of sequences of the tasks before its own plus its place:
   dense, without a sort (one small row per task goes through the driver).
3. A keyed Feistel network over the smallest even-bit domain that holds n numbers, with
   cycle-walking, maps numbers to slots: a permutation of 0 .. n - 1 that any task computes
   by itself. Key and n define the order. A second pass over the written ids deals each sequence by its slot.
4. Slots are dealt by ranges of shards; a shard holds SHARD_SLOTS records of a fixed stride in
   slot order, so the record of a slot is at a known place, and a reader resumes anywhere.

A shard is one row (shard, first_slot, records) of a Parquet table, in files of ascending
shards: any store Spark writes to can hold it, and a lost task's output is replaced as a whole.
The numbers are those written in the first pass, so it does not matter how the second one is
split or how often a task is run again. The total is checked at the end.

Record, little-endian: doc_id (8 bytes, signed), sequence in its document (4), number
of ids that are not padding (2), flags (2; 1: no doc_id), ids (2 bytes each).

Defined cases: a null or empty text gives one sequence with only the end mark; a null doc_id
is 0 with flag 1; repeated rows are separate documents; an empty table gives no shard;
other columns are not looked at; a long text gives as many sequences as it needs.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import materialise, ship_package, spent

LENGTH, SHARD_SLOTS, ROUNDS = 256, 2048, 6
HEADER = np.dtype([("doc_id", "<i8"), ("part", "<u4"), ("n_tokens", "<u2"), ("flags", "<u2")])
RECORD = np.dtype([*HEADER.descr, ("ids", "<u2", (LENGTH,))])
STRIDE = RECORD.itemsize


def round_keys(key: str) -> np.ndarray:
    digest = hashlib.blake2b(key.encode(), digest_size=64).digest()
    return np.frombuffer(digest, dtype="<u8")[:ROUNDS]


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def slots(numbers: np.ndarray, n: int, key: str) -> np.ndarray:
    """Slot of each number below n: balanced Feistel rounds, walked again while the result is n or more."""
    if n <= 1:
        return np.zeros(len(numbers), dtype=np.int64)
    half = max(1, -(-int(n - 1).bit_length() // 2))
    mask, keys = np.uint64((1 << half) - 1), round_keys(key)
    out = np.asarray(numbers, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbers_of(slot: np.ndarray, n: int, key: str) -> np.ndarray:
    """The inverse of ``slots``: which sequence stands in a slot."""
    if n <= 1:
        return np.zeros(len(slot), dtype=np.int64)
    half = max(1, -(-int(n - 1).bit_length() // 2))
    mask, keys = np.uint64((1 << half) - 1), round_keys(key)
    out = np.asarray(slot, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys[::-1]:
            left, right = right ^ (_mixed(left, k) & mask), left
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@functools.cache
def encoding(path: str):
    """The encoder of a file of byte-level ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(path: str, texts: list[str | None]) -> list[list[int]]:
    encode = encoding(path).encode_ordinary
    return [encode(t) if isinstance(t, str) else [] for t in texts]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")


def records(own: pd.DataFrame, ids: list[list[int]], end_id: int) -> np.ndarray:
    """The records of some documents, in order."""
    n = np.fromiter((len(x) + 1 for x in ids), dtype=np.int64, count=len(ids))
    parts = -(-n // LENGTH)
    flat = np.zeros(int(parts.sum()) * LENGTH, dtype="<u2")
    first = np.concatenate([[0], np.cumsum(parts)[:-1]]) * LENGTH
    for x, a in zip(ids, first.tolist()):
        flat[a:a + len(x)] = x
    flat[first + n - 1] = end_id
    out = np.zeros(len(flat) // LENGTH, dtype=RECORD)
    out["ids"] = flat.reshape(-1, LENGTH)
    doc = np.repeat(np.arange(len(ids)), parts)
    place = np.arange(len(doc)) - np.repeat(first // LENGTH, parts)
    out["part"] = place
    out["n_tokens"] = np.minimum(n[doc] - place * LENGTH, LENGTH)
    out["flags"] = own["doc_id"].isna().to_numpy()[doc]
    out["doc_id"] = own["doc_id"].fillna("0").astype("int64").to_numpy()[doc]
    return out


def packed(out: np.ndarray) -> bytes:
    """Records without their padding, compressed."""
    import zstandard

    head = np.empty(len(out), dtype=HEADER)
    for name in HEADER.names:
        head[name] = out[name]
    own = np.arange(LENGTH)[None, :] < out["n_tokens"][:, None]
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + out["ids"][own].tobytes())


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """The inverse of ``packed`` for n records."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(raw, dtype=HEADER, count=n)
    out = np.zeros(n, dtype=RECORD)
    for name in HEADER.names:
        out[name] = head[name]
    ids = np.zeros((n, LENGTH), dtype="<u2")
    ids[np.arange(LENGTH)[None, :] < head["n_tokens"][:, None]] = np.frombuffer(raw, dtype="<u2", offset=n * HEADER.itemsize)
    out["ids"] = ids
    return out


def sequences(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Written: (part, first, n, blob), the packed records of some documents, which are those from ``first`` on of task ``part``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for part in slices(batch["text"].tolist(), 1_000_000):
                out = records(batch.iloc[at:at + len(part)], encoded(path, part), end_id)
                at += len(part)
                yield pd.DataFrame({"part": [task], "first": [first], "n": [len(out)], "blob": [packed(out)]})
                first += len(out)
    return materialise(_rows(docs).mapInPandas(run, "part int, first long, n int, blob binary"), "order-sequences", compression="none")


def shards(docs: DataFrame, path: str, end_id: int, key: str = "epoch-0", shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Written shards: (shard, first_slot, n, records), records being n * STRIDE bytes in slot order."""
    ship_package(docs.sparkSession)
    with spent(docs.sparkSession):
        return dealt(sequences(docs, path, end_id), key, shard_slots)


def dealt(written: DataFrame, key: str, shard_slots: int) -> DataFrame:
    """The shards of written ``sequences``."""
    spark = written.sparkSession
    before, total = {}, 0
    for r in written.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row per task
        before[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast(before)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, first, n, blob in zip(batch["part"].tolist(), batch["first"].tolist(), batch["n"].tolist(), batch["blob"]):
                number = shared.value[part] + first
                raw = unpacked(blob, n).tobytes()
                yield pd.DataFrame({"slot": slots(np.arange(number, number + n), total, key), "record": [raw[k:k + STRIDE] for k in range(0, len(raw), STRIDE)]})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shard, held = None, []
        for batch in batches:
            shard = batch["slot"].to_numpy(np.int64) // shard_slots
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() if len(shard) else []
            for a, b in zip(cut, [*cut[1:], len(shard)]):
                if shard[a] != open_shard:
                    if held:
                        yield _shard_row(open_shard, held, shard_slots)
                    open_shard, held = int(shard[a]), []
                held += batch["record"].iloc[a:b].tolist()
        if held:
            yield _shard_row(open_shard, held, shard_slots)

    n_shards = -(-total // shard_slots)
    parts = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = written.mapInPandas(deal, "slot long, record binary").withColumn(
        "range", F.floor(F.floor(F.col("slot") / shard_slots) * parts / F.lit(max(1, n_shards))).cast("int"))
    # dense slots: equal ranges of shards are equal shares of rows, whatever the documents
    out = materialise(rows.repartitionById(parts, "range").sortWithinPartitions("slot").select("slot", "record").mapInPandas(
        fill, "shard long, first_slot long, n int, records binary"), "order-shards", lasting=True, compression="zstd")
    found = out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("shard").alias("shards")).first()
    if (found["n"], found["shards"]) != (total, n_shards):
        raise RuntimeError(f"{found} instead of {total} sequences in {n_shards} shards")
    return out


def _shard_row(shard: int, held: list[bytes], shard_slots: int) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "first_slot": [shard * shard_slots], "n": [len(held)], "records": [b"".join(held)]})


def read_slots(written: DataFrame, start: int, stop: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, record) of the slots start .. stop - 1: only the shards that hold them are read."""
    rows = written.where(F.col("shard").between(start // shard_slots, max(start, stop - 1) // shard_slots))
    return _records(rows).where((F.col("slot") >= start) & (F.col("slot") < stop))


def _records(written: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, n, raw in zip(batch["first_slot"], batch["n"], batch["records"]):
                yield pd.DataFrame({"slot": np.arange(first, first + n), "record": [raw[k:k + STRIDE] for k in range(0, len(raw), STRIDE)]})
    return written.select("first_slot", "n", "records").mapInPandas(run, "slot long, record binary")


def manifest(written: DataFrame) -> DataFrame:
    """One row per slot, read back from the shards: shard, byte offset, and what the record holds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, first, raw in zip(batch["shard"], batch["first_slot"], batch["records"]):
                r = np.frombuffer(raw, dtype=RECORD)
                sha = [hashlib.sha256(raw[k:k + STRIDE]).hexdigest() for k in range(0, len(raw), STRIDE)]
                missing = r["flags"] & 1 == 1
                yield pd.DataFrame({"slot": np.arange(first, first + len(r)), "shard": shard, "byte_offset": np.arange(len(r)) * STRIDE,
                                    "doc_id": pd.Series(r["doc_id"].astype(np.int64)).astype("Int64").mask(missing), "part": r["part"].astype(np.int64),
                                    "n_tokens": r["n_tokens"].astype(np.int64), "record_sha256": sha})
    return written.mapInPandas(run, "slot long, shard long, byte_offset long, doc_id long, part long, n_tokens long, record_sha256 string")
