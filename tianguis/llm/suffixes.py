"""Repeated-passage removal by column-wise suffix sorting of many documents.

Every byte that a string of ``WINDOW`` bytes covers goes if that string also starts anywhere
else, in the same or in another text. Suffixes of all texts are put in order column by
column: each round adds one symbol to the left of every string, and the order of the new
suffixes (and with it the collection's Burrows-Wheeler transform, the symbols left of the
sorted suffixes) follows from the order before by one stable distribution on the new
symbol. The common prefix of two neighbours is 1 plus the least common prefix between
their old places where their symbols agree, else 0. Neighbours that share WINDOW bytes
are repeats; so each round reads one column and the order and prefixes of the last one.

To have rounds of bounded number that run in parallel, texts enter as pieces that are
lined up on shared content. Of each window the K-byte string with the smallest hash is its
anchor (the leftmost on ties). Equal windows have equal anchors at equal offsets, so
consecutive starts with one anchor make a piece, pieces with one anchor hash make a
collection, and only suffixes in one column (one offset to the anchor) can be equal:
columns already done are never merged again. A column is one step of at most
WINDOW + SPAN - 1 rounds, whatever the lengths of the texts.

1. A scan emits the anchor hashes of each text; those that occur twice or more are
   counted out. An anchor that occurs once has no partner.
2. A second scan, joined with each text's list of those, cuts the pieces. Equal pieces
   (a 128-bit digest) form a class with a count: a class of two has nothing but repeats.
3. Classes are dealt by anchor hash, sorted, and streamed through the column-wise sort,
   whole collections at a time. The tables between the steps, Parquet in the shared folder,
   are read and written in sequence; they are the method's external files. Columns of a
   block of pieces are held in memory (a few MB), not in files of the task's machine.
4. Collections of more than ``HOT`` classes (a passage shared by very many texts with
   other surroundings) are cut into narrower offset ranges whose common bytes join the
   key: 32, 8 and at last 1 starts, where a collection is one class. No rows are dropped.
5. Repeated starts go back to the texts that hold them and are united into runs.

Defined cases: a null text is an empty one; texts shorter than WINDOW lose nothing; rows
with equal texts are copies of each other and lose every byte if long enough; very long
texts are cut into chunks with WINDOW - 1 bytes of overlap; null and repeated doc_ids do
not matter; empty tables give empty results; other columns are not looked at. Texts are
told apart by 64-bit hashes: a table of 1e9 different texts has one collision with a
probability of 3 %.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, ship_package, text_key

WINDOW = 200                # bytes of a repeated string
K = 64                      # bytes of an anchor
SPAN = WINDOW - K + 1       # starts that one anchor can serve
HOT = 4096                  # classes of a collection that one task sorts
WIDTHS = (32, 8, 1)         # starts of a piece, where collections are too large
CHUNK = 1 << 19             # bytes that are hashed at a time
BLOCK = 16_384              # pieces that are sorted at a time, in whole collections
HELD = 1 << 24              # bytes of pieces a task holds to find equal ones

_PLACE = np.uint64((1 << 20) - 1)


@functools.cache
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte; powers of an odd number modulo 2^64 and of its inverse."""
    n = CHUNK + WINDOW + 1
    values = mix64(np.arange(1, 257, dtype=np.uint64))
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return values, out[0], out[1]


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, hash) of the pieces of texts laid end to end
    in ``buf`` (at most CHUNK + WINDOW bytes), which end at ``ends``."""
    n = len(buf)
    nothing = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return nothing, nothing, nothing, nothing, nothing.astype(np.uint64)
    values, power, inverse = _hashing()
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[buf] * power[:n], out=total[1:])
    code = mix64((total[K:] - total[:-K]) * inverse[:n - K + 1])
    least = (code & ~_PLACE) | np.arange(len(code), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    anchor = (least & _PLACE).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)[:len(anchor)]
    fits = np.arange(WINDOW, n + 1) <= ends[text]
    fresh = fits.copy()
    fresh[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1])
    last = fits.copy()
    last[:-1] &= ~fits[1:] | (anchor[1:] != anchor[:-1])
    first, last = np.flatnonzero(fresh), np.flatnonzero(last)
    return text[first], first, last, anchor[first], code[anchor[first]]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Buffers of texts laid end to end with their ends, and the (row, offset) of each."""
    held, where, size = [], [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, CHUNK):
            part = text[at:at + CHUNK + WINDOW - 1]
            if size + len(part) > CHUNK + WINDOW - 1:
                yield _laid(held, where)
                held, where, size = [], [], 0
            held.append(part)
            where.append((row, at))
            size += len(part)
    if held:
        yield _laid(held, where)


def _laid(held, where):
    return np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(p) for p in held]), where


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, key, n): anchor hashes of each text."""
    for batch in batches:
        keys = batch["key"].to_numpy(np.int64)
        out = []
        for buf, ends, where in _chunks(batch["text"].tolist()):
            text, _, _, _, code = anchors(buf, ends)
            rows = np.array([r for r, _ in where])
            out.append(pd.DataFrame({"h": code.view(np.int64), "key": keys[rows[text]]}))
        if out:
            yield pd.concat(out).groupby(["h", "key"], sort=False).size().reset_index(name="n")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each piece with a listed anchor; the first of equal ones carries their bytes and number."""
    held: dict = {}
    rows, size = [], 0

    def hand_on():
        out = pd.DataFrame(rows, columns=["cid", "h", "key", "start", "back", "starts", "piece", "n"])
        out["n"] = [held[c] if p is not None else None for c, p in zip(out["cid"], out["piece"])]
        return out.astype({"n": "Int64"})

    for batch in batches:
        texts, keys, listed = batch["text"].tolist(), batch["key"].to_numpy(np.int64), batch["listed"].tolist()
        listed = [None if x is None else np.sort(np.asarray(x, dtype=np.int64)) for x in listed]
        for buf, ends, where in _chunks([t if x is not None and len(x) else None for t, x in zip(texts, listed)]):
            text, first, last, anchor, code = anchors(buf, ends)
            code, offsets, data = code.view(np.int64), np.concatenate([[0], ends]), buf.tobytes()
            cut = np.searchsorted(text, np.arange(len(where) + 1))
            for i, (row, at) in enumerate(where):
                mine = slice(cut[i], cut[i + 1])
                x = listed[row]
                hit = np.searchsorted(x, code[mine])
                take = np.flatnonzero(x[np.minimum(hit, len(x) - 1)] == code[mine]) + cut[i]
                base, key = at - int(offsets[i]), int(keys[row])
                for a, b, c, h in zip(first[take].tolist(), last[take].tolist(), anchor[take].tolist(), code[take].tolist()):
                    piece = data[a:b + WINDOW]
                    cid = hashlib.blake2b(piece, digest_size=16, salt=(c - a).to_bytes(8, "little")).digest()
                    if cid in held:
                        held[cid] += 1
                        rows.append((cid, h, key, base + a, c - a, b - a + 1, None, None))
                    else:
                        held[cid] = 1
                        size += len(piece)
                        rows.append((cid, h, key, base + a, c - a, b - a + 1, piece, None))
            if size > HELD or len(rows) > HELD >> 7:
                yield hand_on()
                held, rows, size = {}, [], 0
    if rows:
        yield hand_on()


def sort_columns(pieces: list[bytes], back: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each piece and each offset to the anchor (0 to SPAN - 1 bytes before it): does the window
    that starts there also start in another piece of its group?

    ``back`` is the anchor's place in a piece; pieces of one group are lined up on it and are
    adjacent, ``group`` counts up."""
    m = len(pieces)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    row = np.repeat(np.arange(m), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    # column-major; symbol 0 stands where a piece has no byte, and equals nothing
    columns = np.zeros((WINDOW + SPAN - 1, m), dtype=np.uint16)
    columns[WINDOW - 1 + np.repeat(back, size) - at, row] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint16) + 1
    order = np.arange(m)
    common = np.zeros(m + 1, dtype=np.int16)   # with the neighbour before; one place more for the last range
    out = np.zeros((SPAN, m), dtype=bool)
    bucket = group.astype(np.int32) * 512
    for k, column in enumerate(columns):
        left = column[order]                   # the transform: symbols left of the sorted suffixes
        deal = bucket + left                   # order never leaves its group, so bucket needs no permutation
        move = np.argsort(deal, kind="stable")
        deal = deal[move]
        same = np.flatnonzero((deal[1:] == deal[:-1]) & (deal[1:] & 511 > 0)) + 1
        low, high = move[same - 1] + 1, move[same] + 1
        new = np.zeros(m + 1, dtype=np.int16)
        if len(same):
            new[same] = 1 + np.minimum.reduceat(common, np.column_stack([low, high]).ravel())[::2]
        order, common = order[move], new
        if k >= WINDOW - 1:
            long = np.flatnonzero(common >= WINDOW)
            out[k - (WINDOW - 1), order[long]] = True
            out[k - (WINDOW - 1), order[long - 1]] = True
    return out


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cid, low, high): runs of repeated starts of each class; rows come in order of h, cid."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        h = batch["h"].to_numpy(np.int64)
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0   # the last collection may go on
        if cut < BLOCK and len(h) < 4 * BLOCK:
            rest = batch
            continue
        rest = batch.iloc[cut:]
        if cut:
            yield from _runs(batch.iloc[:cut])
    if rest is not None and len(rest):
        yield from _runs(rest)


def _runs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    h, cid = rows["h"].to_numpy(np.int64), rows["cid"].tolist()
    fresh = np.array([True] + [a != b for a, b in zip(cid[1:], cid)]) | np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(fresh)
    n = np.add.reduceat(rows["n"].to_numpy(np.int64), first)
    rows, h = rows.iloc[first], h[first]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    at = 0
    while at < len(edges) - 1:   # whole collections, about BLOCK pieces at a time
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK, "right")) - 1)
        lo, hi = int(edges[at]), int(edges[to])
        part, many = rows.iloc[lo:hi], n[lo:hi] > 1
        back, starts = part["back"].to_numpy(np.int64), part["starts"].to_numpy(np.int64)
        groups = np.repeat(np.arange(to - at), np.diff(edges[at:to + 1]))
        again = sort_columns(part["piece"].tolist(), back, groups) | many[None, :]
        # by start: the anchor's offset falls as starts rise
        place = back[:, None] - np.arange(SPAN)[None, :]
        hit = again[np.clip(place, 0, SPAN - 1), np.arange(hi - lo)[:, None]] & (np.arange(SPAN)[None, :] < starts[:, None])
        flat = np.zeros((hi - lo, SPAN + 2), dtype=np.int8)
        flat[:, 1:-1] = hit
        row, low = np.nonzero(np.diff(flat, axis=1) == 1)
        _, high = np.nonzero(np.diff(flat, axis=1) == -1)
        ids = part["cid"].to_numpy(object)
        yield pd.DataFrame({"cid": ids[row], "low": low, "high": high - 1})
        at = to


def _narrow(width: int):
    """Cuts pieces by offsets to the anchor, ``width`` starts each; their common bytes are the new key."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cid, h, back, starts, piece, n in zip(*(batch[c].tolist() for c in ("cid", "h", "back", "starts", "piece", "n"))):
                least = back - starts + 1                       # the smallest offset, of the last start
                for b in range(least // width, back // width + 1):
                    near, far = b * width, b * width + width - 1
                    u, v = back - min(far, back), back - max(near, least)
                    part = piece[u:v + WINDOW]
                    shared = piece[back - near:back - far + WINDOW]   # of every start in the range
                    key = hashlib.blake2b(shared, digest_size=8, key=f"{h}:{b}".encode()).digest()
                    new = hashlib.blake2b(part, digest_size=16, salt=(back - u).to_bytes(8, "little"), key=key).digest()
                    out.append((new, int.from_bytes(key, "little", signed=True), cid, u, back - u, v - u + 1, part, n))
            if out:
                yield pd.DataFrame(out, columns=["cid", "h", "key", "start", "back", "starts", "piece", "n"])
    return cut


_FOUND = "back int, starts int, piece binary, n long"


def repeated_starts(found: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(cid, low, high): runs of starts of each class that occur anywhere else. ``found`` has a row for
    each occurrence of a class; rows with bytes count ``n`` of them."""
    classes = found.where("piece is not null").select("cid", "h", "back", "starts", "piece", "n")
    sizes = classes.select("h", "cid").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("classes"))
    hot = materialise(sizes.where(F.col("classes") > HOT).select("h"), "suffixes-hot") if widths else None
    crowded = hot is not None and not hot.isEmpty()
    small = classes.join(hot, "h", "left_anti") if crowded else classes
    runs = (small.repartition("h").sortWithinPartitions("h", "cid")
            .mapInPandas(_sorted, "cid binary, low long, high long"))
    if not crowded:
        return runs
    large = classes.join(hot, "h", "left_semi")
    narrow = materialise(large.mapInPandas(_narrow(widths[0]), f"cid binary, h long, key binary, start long, {_FOUND}"), "suffixes-narrow")
    inner = materialise(repeated_starts(narrow, widths[1:]), "suffixes-inner")
    back = narrow.select("cid", "key", "start").distinct().join(inner, "cid")
    return runs.unionByName(back.select(F.col("key").alias("cid"), (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield batch.assign(text=[None if t is None else pack.compress(t) for t in batch["text"]])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches with their texts unpacked, a few MB at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = batch["text"].tolist()
        sizes = [0 if t is None else zstandard.frame_content_size(t) for t in texts]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 4 * CHUNK):
                size += sizes[to]
                to += 1
            yield batch.iloc[at:to].assign(text=[None if t is None else unpack.decompress(t) for t in texts[at:to]])
            at = to


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, text_key().alias("key"), F.col("text").cast("binary").alias("text"))


def removed_runs(docs: DataFrame) -> DataFrame:
    """(key, runs): for each text that has any, the half-open byte ranges of its repeated strings (they may
    overlap); key is the hash of the text."""
    ship_package(docs.sparkSession)
    long = _keyed(docs).where(F.octet_length("text") >= WINDOW)
    hashes = materialise(long.mapInPandas(_hashes, "h long, key long, n long"), "suffixes-anchors")
    twice = hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    listed = hashes.join(twice, "h").groupBy("key").agg(F.collect_set("h").alias("listed"))
    packed = long.mapInPandas(_packed, "key long, text binary")
    found = materialise(
        packed.join(listed.hint("shuffle_hash"), "key")
        .mapInPandas(lambda batches: _pieces(_unpacked(batches)), f"cid binary, h long, key long, start long, {_FOUND}"), "suffixes-pieces")
    runs = repeated_starts(found)
    spans = found.select("cid", "key", "start").join(runs, "cid").select(
        "key", F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + WINDOW).alias("b")).alias("run"))
    return spans.groupBy("key").agg(F.collect_set("run").alias("runs"))


def united(runs) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_bytes, n_removed, n_spans, spans, kept, kept_sha256) of every row of
    ``docs(doc_id, text)``: removed byte ranges, the remaining bytes and their digest."""
    packed = _keyed(docs, "doc_id").mapInPandas(
        _packed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, text binary")
    marked = packed.join(removed_runs(docs).hint("shuffle_hash"), "key", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _unpacked(batches):
            out = []
            for text, runs in zip(batch["text"], batch["runs"]):
                text, runs = text or b"", united(runs if runs is not None else [])
                kept = _without(text, runs)
                out.append((len(text), sum(b - a for a, b in runs), len(runs), [{"a": a, "b": b} for a, b in runs], kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(object), "text_key": batch["key"].to_numpy(), "n_bytes": cols[0],
                                "n_removed": cols[1], "n_spans": cols[2], "spans": cols[3], "kept": cols[4], "kept_sha256": cols[5]})

    return marked.mapInPandas(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_bytes long, n_removed long, "
                                   "n_spans long, spans array<struct<a:long,b:long>>, kept binary, kept_sha256 string")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the digests of ``deduplicated``: digests of all windows, grouped."""
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    windows AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * window})) AS h FROM (SELECT r, x, unnest(range(n - {window - 1})) AS i FROM docs)),
    starts AS (SELECT r, i FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)),
    edges AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {window} THEN 0 ELSE 1 END AS fresh FROM starts),
    numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM edges),
    runs AS (SELECT r, min(i) AS a, max(i) + {window} AS b FROM numbered GROUP BY r, run),
    gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS upto FROM runs),
    cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept
            FROM gaps JOIN docs USING (r) GROUP BY r)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM docs LEFT JOIN cut USING (r)"""
