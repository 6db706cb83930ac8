"""Near-duplicates by b-bit MinHash.

Pass 1 reads every whole text once: distinct word shingles as 64-bit hashes, 240
minima, 40 band keys of 6 minima each, and one low bit of every minimum packed into
four longs. Texts with equal shingle sets form a class; all later steps see classes.

Candidates come from bands without listing the pairs of a bucket. In a bucket the
classes elect leaders: a class is a leader unless it is near an earlier one, where near
means that sizes fit and that the b-bit estimate, corrected for chance agreement, is not
far below the threshold (five standard deviations; at 0.8 the bands miss a link with
probability 5e-6 and the estimate another with 3e-7). Every class is paired with the
leaders it is near. Buckets of more than HOT classes are split at random and their parts'
leaders meet in a second round. Pairs are confirmed on full shingle sets: first the two
best leaders of a class, then what still joins different components.

What leaders cannot show is a link between two classes that are not leaders. Where
those of a bucket ended in different components, an exact prefix-filter join over full
sets finds the rest: two sets with similarity of at least t share a shingle among
the rarest (1 - t) n + 1 of each, and the intersection lies behind their first common one.
Copies and large groups thus cost about linear work, and no link is dropped.

Shingle hashes are 64 bits wide: two sets that differ count as different unless
hashes collide (for one pair of 500-shingle sets about 1e-14). Class keys too: a
table of 1e9 different texts has one collision with a probability of 3 %.

Defined cases: a null, empty or blank text has no shingles, is linked with nothing and
is kept; a text with fewer words than a shingle is one shingle, its whole sequence;
rows repeated with one doc_id are copies of each other; a row without doc_id is
compared like any other, but never names a component (its component_id is null if
no linked row has an id); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import slices
from .common import components, lean, materialise, mix64, ship_package, spent, text_key

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
LONGS = (HASHES + 63) // 64
SIGMAS = 5
HOT = 4096       # classes of a bucket that one task holds
BLOOM_BITS = 26  # of the filter over texts that need their full set (8 MB)
SLICE = 200_000  # characters of text whose words and shingles a worker holds at a time

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` or more; a worker keeps one table."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        _POWERS.clear()
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.full(1 << max(16, (n - 1).bit_length()), factor, dtype=np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.multiply.accumulate(table, out=table))
    return _POWERS


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each maximal run of non-blank bytes, A-Z lowered."""
    low = LOWER[raw]
    blank = IS_SPACE[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
        value = (total[end] - total[start]) * down[start]
        return start, mix64(value + (end - start).astype(np.uint64) * _MUL)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    blobs = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    start, words = word_hashes(raw)
    first = np.searchsorted(start, at)
    out = []
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for k in range(1, width):
            rolled[:len(words) - k] = mix64(rolled[:len(words) - k] * _MUL + words[k:]) if len(words) > k else rolled[:len(words) - k]
        for a, b in zip(first, first[1:]):
            if b - a >= width:
                out.append(np.unique(rolled[a:b - width + 1]))
            elif b > a:
                whole = words[a:a + 1].copy()
                for k in range(a + 1, b):
                    whole = mix64(whole * _MUL + words[k:k + 1])
                out.append(mix64(whole + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


@functools.cache
def _family() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return (rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    family, out = _family(), None
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            low = (family * hashes[None, k:k + 2048]).min(axis=1)
            out = low if out is None else np.minimum(out, low)
    return out


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of a non-empty set, as signed longs."""
    low = minima(hashes)
    bits = np.zeros(LONGS * 64, dtype=np.uint8)
    bits[:HASHES] = ((low ^ (low >> np.uint64(31))) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, bitorder="little").view("<i8")
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL
        for column in low.reshape(BANDS, ROWS).T:
            key = mix64(key * _MUL + column)
    return packed, key.view(np.int64)


def class_key(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        mixed = mix64(hashes)
        return int(mix64(np.array([mixed.sum(dtype=np.uint64) * _MUL + np.bitwise_xor.reduce(mixed) + np.uint64(len(hashes))]))[0].astype(np.int64))


def described(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: doc_id, text key, number of shingles, class, packed bits and
    band keys (the last two only where a task first meets the class)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        for batch in batches:
            at = 0
            for part in slices(batch["text"].tolist(), SLICE):
                rows = []
                for hashes in shingle_sets(part, width):
                    if not len(hashes):
                        rows.append((0, None, None, None))
                        continue
                    node = class_key(hashes)
                    if node in known:
                        rows.append((len(hashes), node, None, None))
                    else:
                        known.add(node)
                        rows.append((len(hashes), node, *signature(hashes)))
                n, node, bits, bands = zip(*rows)
                # an inferred column of longs and nulls would become doubles and lose digits
                out = pd.DataFrame({"n": n, "node": pd.array(node, dtype="Int64"), "bits": pd.Series(bits, dtype=object), "bands": pd.Series(bands, dtype=object)})
                out.insert(0, "text_key", batch["text_key"].iloc[at:at + len(part)].to_numpy())
                out.insert(0, "doc_id", batch["doc_id"].iloc[at:at + len(part)].to_numpy())
                at += len(part)
                yield out
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key().alias("text_key"), "text").mapInPandas(
        lean(run), "doc_id string, text_key long, n long, node long, bits array<long>, bands array<long>"
    ).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(node, hashes) for the classes whose text keys are in ``wanted(text_key)``.

    The wanted keys travel as a bit map of fixed size, so no text is shuffled; the
    few texts it lets through by chance cost time only."""
    spark, mask = docs.sparkSession, (1 << BLOOM_BITS) - 1
    words = wanted.select(F.col("text_key").bitwiseAND(F.lit(mask)).alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, done = shared.value, set()
        for batch in batches:
            h = batch["text_key"].to_numpy(dtype=np.int64) & mask
            batch = batch[(bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1]
            for part in slices(batch["text"].tolist(), SLICE):
                rows = []
                for hashes in shingle_sets(part, width):
                    node = class_key(hashes) if len(hashes) else None
                    if node is not None and node not in done:
                        done.add(node)
                        rows.append((node, hashes.tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["node", "hashes"])
    return docs.select(text_key().alias("text_key"), "text").mapInPandas(lean(run), "node long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(u) + len(v) - same))
            yield batch.loc[keep, ["a", "b"]]
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return materialise(pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(lean(run), "a long, b long"), tag)


def most_differing(percent: int) -> int:
    """Differing bits up to which a pair may still reach the similarity."""
    t = percent / 100
    agree = (1 + t) / 2
    least = t - SIGMAS * 2 * (agree * (1 - agree) / HASHES) ** 0.5
    return int(HASHES * (1 - least) / 2)


def leaders(node: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leader mask, class, leader it is near, differing bits) of one bucket's classes, as positions."""
    most = most_differing(percent)

    def near(k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1)
        return (differ <= most) & (100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k])), differ

    left, lead = np.arange(len(node)), []
    while len(left):
        k, left = left[0], left[1:]
        lead.append(k)
        left = left[~near(k, left)[0]]
    mask = np.zeros(len(node), dtype=bool)
    mask[lead] = True
    rest = np.flatnonzero(~mask)
    found = [(rest[hit], np.full(int(hit.sum()), k), differ[hit]) for k in lead for hit, differ in (near(k, rest),)] if len(rest) else []
    return (mask, *(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)))


PAIRS = "key long, a long, b long, differ int, n long, bits array<long>"


def bucket_pairs(rows: DataFrame, percent: int, split: bool) -> DataFrame:
    """Near (class a, leader b) pairs of all buckets of ``rows(key, salt, node, n, bits)``. With ``split``,
    leaders of a split bucket are returned too, as rows without b."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            key, salt = batch["key"].to_numpy(np.int64), batch["salt"].to_numpy(np.int64)
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
            rest = batch.iloc[start[-1]:]
            yield from pairs_of(batch, key, salt, start)
        if rest is not None and len(rest):
            yield from pairs_of(rest, rest["key"].to_numpy(np.int64), rest["salt"].to_numpy(np.int64), np.array([0, len(rest)]))

    def pairs_of(batch: pd.DataFrame, key: np.ndarray, salt: np.ndarray, start: np.ndarray) -> Iterator[pd.DataFrame]:
        size = np.diff(start)
        used = np.flatnonzero((size > 1) | (salt[start[:-1]] > 0) if split else size > 1)
        if not len(used):
            return
        node, n = batch["node"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
        out: list[tuple] = []
        for k in used.tolist():
            a, b = start[k], start[k] + size[k]
            bits = np.stack(batch["bits"].iloc[a:b].to_numpy()).view(np.uint64)
            lead, x, y, differ = leaders(node[a:b], n[a:b], bits, percent)
            out += zip([int(key[a])] * len(x), node[a + x].tolist(), node[a + y].tolist(), differ.tolist(), [0] * len(x), [None] * len(x))
            if split and salt[a] > 0:
                out += [(int(key[a]), int(node[a + j]), None, 0, int(n[a + j]), bits[j].view(np.int64)) for j in np.flatnonzero(lead).tolist()]
            if len(out) > 20_000:
                yield _pair_frame(out)
                out = []
        if out:
            yield _pair_frame(out)
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInPandas(lean(run), PAIRS)


def _pair_frame(rows: list[tuple]) -> pd.DataFrame:
    key, a, b, differ, n, bits = zip(*rows)
    return pd.DataFrame({"key": key, "a": a, "b": pd.array(b, dtype="Int64"), "differ": differ, "n": n, "bits": pd.Series(bits, dtype=object)})


def candidate_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(key, a, b, differ): class a is near leader b of bucket key. Leaders of the parts of a split
    bucket are listed too, without b: they met no class of another part that is not a leader."""
    bands = classes.select(F.explode("bands").alias("key"), "node", "n", "bits")
    hot = materialise(bands.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > HOT), "mh-hot")
    if hot.isEmpty():
        return materialise(bucket_pairs(bands.withColumn("salt", F.lit(0)), percent, False).select("key", "a", "b", "differ"), "mh-pairs")
    parts = F.ceil(2 * F.col("size") / HOT)
    salted = bands.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), parts) + 1, F.lit(0))).drop("size")
    first = materialise(bucket_pairs(salted, percent, True), "mh-split")
    again = first.where("b is null").select("key", F.lit(0).alias("salt"), F.col("a").alias("node"), "n", "bits")
    second = bucket_pairs(again, percent, False).select("key", "a", "b", "differ")
    return materialise(first.select("key", "a", "b", "differ").unionByName(second), "mh-pairs")


def _rooted(df: DataFrame, roots: DataFrame | None, column: str, name: str) -> DataFrame:
    if roots is None:
        return df.withColumn(name, F.col(column))
    return df.join(roots.select(F.col("node").alias(column), F.col("root").alias("_r")), column, "left").withColumn(
        name, F.coalesce("_r", column)).drop("_r")


def linked_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots): every row with its class, one row per class, and (node, root) of
    the classes that have a link."""
    rows = materialise(described(docs, width), "mh-rows")
    classes = materialise(
        rows.where("bands is not null").groupBy("node").agg(
            F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.min("text_key").alias("text_key")), "mh-classes")
    near = candidate_pairs(classes, percent)
    best = Window.partitionBy("a").orderBy("differ", "b")
    pairs = materialise(near.where("b is not null").groupBy("a", "b").agg(F.min("differ").alias("differ"))
                        .withColumn("place", F.row_number().over(best)).select("a", "b", "place"), "mh-ranked")
    need = near.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialise(classes.select("node", "text_key").join(need, "node"), "mh-wanted")
    sets = materialise(full_sets(docs, width, wanted.select("text_key")).join(wanted.select("node"), "node")
                       .groupBy("node").agg(F.first("hashes").alias("hashes")), "mh-sets")
    edges = confirmed(pairs.where("place <= 2"), sets, percent, "mh-links")
    roots = materialise(components(edges), "mh-roots")
    later = _rooted(_rooted(pairs.where("place > 2"), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb")
    more = confirmed(later, sets, percent, "mh-links")
    if not more.isEmpty():
        edges = edges.union(more)
        roots = materialise(components(edges), "mh-roots")
    rest = _between_members(near.select("key", F.col("a").alias("node")).distinct(), roots, sets, percent)
    if rest is not None and not rest.isEmpty():
        roots = components(edges.union(rest))
    return rows, classes, roots


def _between_members(inner: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between classes of a bucket that are not leaders, or lead a part of a split
    bucket, and lie in different components."""
    placed = materialise(_rooted(inner.select("key", "node"), roots, "node", "root"), "mh-placed")
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    main = materialise(by_root.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots"))
                       .where("roots > 1").select("key", F.col("top.root").alias("main")), "mh-open")
    if main.isEmpty():
        return None
    open_members = placed.join(main, "key")
    side = materialise(open_members.groupBy("node", "root").agg(F.max(F.col("root") != F.col("main")).alias("minor")), "mh-sides")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, raw in zip(batch["node"], batch["hashes"]):
                h = np.frombuffer(raw, np.int64)
                yield pd.DataFrame({"node": np.full(len(h), node), "n": np.full(len(h), len(h)), "token": h})

    each = materialise(side.select("node").join(sets, "node").mapInPandas(lean(tokens), "node long, n long, token long"), "mh-tokens")
    shared = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rare = each.join(shared, "token").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("df", "token")))
    # shingles of one class alone come first in the order; they use up places without matching
    known = each.groupBy("node").agg(F.first("n").alias("n"))
    common = rare.groupBy("node").agg(F.count("*").alias("common")).join(known, "node").join(side, "node")
    prefix = materialise(
        rare.select("node", "token", "place").join(common, "node").withColumn("place", F.expr("place + n - common"))
        .where(f"place <= n - int(ceil({percent} * n / 100.0)) + 1"), "mh-prefix")
    a = prefix.where("minor").select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("n_a"), F.col("place").alias("p_a"))
    b = prefix.select("token", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("n_b"), F.col("place").alias("p_b"))
    # nothing common stands before the first common shingle, so the intersection fits behind it
    fits = f"ra <> rb and {100 + percent} * (1 + least(n_a - p_a, n_b - p_b)) >= {percent} * (n_a + n_b)"
    pairs = a.join(b, "token").where(fits).select("a", "b").distinct()
    return confirmed(materialise(pairs, "mh-rest"), sets, percent, "mh-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; component_id is the smallest linked doc_id, itself included."""
    rows, classes, roots = linked_classes(docs, width, percent)
    named = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rooted = _rooted(named, roots, "node", "root")
    names = materialise(rooted, "mh-named")
    least = names.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = materialise(names.join(materialise(least, "mh-least"), "root").select("node", "component_id"), "mh-components")
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the row with the smallest doc_id (of rows
    that share it the smallest text key, of equal rows one). Texts without words stay all;
    a group without any doc_id keeps the smallest text key. Texts meet the decisions in one
    exchange, of the same form at every size; only rows with an equal one are exchanged again."""
    ship_package(docs.sparkSession)
    with spent(docs.sparkSession):
        pick = materialise(_chosen(docs, width, percent), "mh-chosen", lasting=True)
    key = "__text_key"
    right = pick.withColumnsRenamed({"doc_id": "__id", "text_key": "__k"}).hint("shuffle_hash")
    joined = docs.withColumn(key, text_key()).join(
        right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(key) == F.col("__k"))).drop("__id", "__k")
    if not pick.where("__copies > 1").isEmpty():
        joined = materialise(joined, "mh-kept", lasting=True)
        once = joined.where("__copies > 1").dropDuplicates(["doc_id", key])
        joined = joined.where("__copies = 1").unionByName(once)
    return joined.select(*[f"`{c}`" for c in docs.columns])


def _chosen(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_key, __copies) of the rows that stay; copies is 1 where all equal rows do."""
    rows, classes, roots = linked_classes(docs, width, percent)
    named = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")).alias("first"))
    names = materialise(_rooted(named, roots, "node", "root"), "mh-named")
    best = materialise(names.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key"), "mh-best")
    copies = (rows.where("node is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("__copies"))
              .where("__copies > 1").withColumnsRenamed({"doc_id": "__id", "text_key": "__k"}))
    best = best.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__k")), "left").select(
        "doc_id", "text_key", F.coalesce("__copies", F.lit(1)).alias("__copies"))
    blank = rows.where("node is null").select("doc_id", "text_key").distinct().withColumn("__copies", F.lit(1).cast("long"))
    return best.unionByName(blank)
