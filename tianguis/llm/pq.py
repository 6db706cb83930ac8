"""Embedding near-duplicates by product quantisation.

Equal vectors form a class; all steps below see one vector of each class, in doubles and scaled
by a power of two, with the number of its rows. There is about one list for every LIST_SIZE
classes, however many there are: up to COARSE centroids, and beyond that finer ones that cut every
coarse cell alike (a list is a coarse and a fine centroid of the residual). They and the subspace
code books of the residuals are fitted on a sample of SAMPLE classes, chosen by
hash; every class is indexed: its list, its residual code and the length of the error of
that code. As a query a class probes the PROBES lists nearest to it among the finer ones of
its PROBES nearest coarse cells. In a list, the
table-lookup distance to a code minus the code's own error is a lower bound of the true
distance, so the filter before the exact cosine loses nothing; only probing can miss a
link. A link counts for both ends when either end's probes reach the other.

A list meets its queries in blocks of BLOCK members and BLOCK queries, so one hot list
spreads over many tasks, and a block emits its members' counts and one root for each linked
member instead of pairs: output is linear however dense a group is.

Defined cases: a null or empty vector, a zero vector and one with a null or non-finite
component have no links, keep themselves and are their own component; vectors of different
lengths have no cosine and are compared within their length only; rows that repeat a vector are
linked with each other; a null vec_id never names a component; an empty table gives an empty
result; other columns (labels too) are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, ship_package

LIST_SIZE, COARSE, PROBES = 64, 4096, 32
CELLS = 1 << 22  # distances that are held at a time
SUBSPACES, CODES = 16, 32
SAMPLE, BLOCK = 40_000, 4096
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; angles stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all centres."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None]
    return np.maximum(d, 0, out=d)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([nearest(x[a:a + 4096], centres).argmin(axis=1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.add.reduceat(x[order], at, axis=0)
        centres[own[order][at]] = sums / np.diff(np.append(at, len(x)))[:, None]
    return centres


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest entries of each row, the smallest first."""
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)


class Quantiser:
    """Centroids and residual code books fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, n: int):
        rng = np.random.default_rng(SEED)
        sample = sample.astype(np.float32)
        dim = sample.shape[1]
        self.centres = k_means(sample, max(1, min(COARSE, n // LIST_SIZE, len(sample))), 6, rng)
        rest = sample - self.centres[np.concatenate([nearest(sample[a:a + 4096], self.centres).argmin(axis=1) for a in range(0, len(sample), 4096)])]
        cells = -(-n // (LIST_SIZE * len(self.centres))) if n // LIST_SIZE > len(self.centres) else 1
        self.fine = k_means(rest, cells, 6, rng) if cells > 1 else np.zeros((1, dim), dtype=np.float32)
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        rest = sample - self.centre(self.lists(sample)[:, 0])
        self.books = [k_means(np.ascontiguousarray(rest[:, a:b]), CODES, 6, rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The PROBES nearest lists of each row, the nearest first."""
        step = max(1, CELLS // (len(self.centres) + PROBES * len(self.fine)))
        return np.concatenate([self._lists(x[a:a + step].astype(np.float32)) for a in range(0, len(x), step)])

    def _lists(self, x: np.ndarray) -> np.ndarray:
        d = nearest(x, self.centres)
        cells = _least(d, min(PROBES, d.shape[1]))
        if len(self.fine) == 1:
            return cells.astype(np.int64)
        rest = (x[:, None, :] - self.centres[cells]).reshape(-1, x.shape[1])
        d = nearest(rest, self.fine).reshape(len(x), -1)
        best = _least(d, min(PROBES, d.shape[1]))
        return np.take_along_axis(cells, best // len(self.fine), axis=1).astype(np.int64) * len(self.fine) + best % len(self.fine)

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error length) of residuals."""
        rest = rest.astype(np.float32)
        codes = np.empty((len(rest), len(self.books)), dtype=np.uint8)
        error = np.zeros(len(rest))
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            d = nearest(rest[:, a:b], book)
            codes[:, k] = d.argmin(axis=1)
            error += ((rest[:, a:b].astype(np.float64) - book[codes[:, k]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def table_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances between query residuals and coded members, by table lookup."""
        rest = rest.astype(np.float32)
        out = np.zeros((len(rest), len(codes)), dtype=np.float32)
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out += nearest(rest[:, a:b], book)[:, codes[:, k]]
        return out


def block_links(quantiser: Quantiser, centre: int, members: pd.DataFrame, queries: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one block: per class the rows linked through this block and a root."""
    dim = quantiser.centres.shape[1]
    m = np.frombuffer(b"".join(members["vec"]), np.float64).reshape(-1, dim)
    q = np.frombuffer(b"".join(queries["q_vec"]), np.float64).reshape(-1, dim)
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(m), -1)
    own = queries["own"].to_numpy(dtype=np.int64)
    probes = np.frombuffer(b"".join(members["probes"]), np.int64).reshape(len(m), -1)
    mid, qid = members["cid"].to_numpy(dtype=np.int64), queries["q_cid"].to_numpy(dtype=np.int64)
    mw, qw = members["w"].to_numpy(dtype=np.int64), queries["q_w"].to_numpy(dtype=np.int64)
    m_norm, q_norm = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    reach = (np.sqrt(2 - 2 * cosine) + members["error"].to_numpy(dtype=np.float64) + 1e-4) ** 2
    rest = q / q_norm[:, None] - quantiser.centre(np.array([centre]))
    lefts, rights = [], []
    for a in range(0, len(q), 512):
        near = quantiser.table_distances(rest[a:a + 512], codes) <= reach[None]
        i, j = np.nonzero(near)
        i += a
        keep = qid[i] != mid[j]
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 65536):
            u, v = i[s:s + 65536], j[s:s + 65536]
            hit = np.einsum("ij,ij->i", q[u], m[v]) / (q_norm[u] * m_norm[v]) >= cosine
            lefts.append(u[hit])
            rights.append(v[hit])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    if not len(i):
        return pd.DataFrame({"cid": [], "links": [], "root": []})
    q_links = np.bincount(i, weights=mw[j], minlength=len(q)).astype(np.int64)
    one_way = (probes[j] != own[i][:, None]).all(axis=1)  # the member's own probes do not reach the query
    m_links = np.bincount(j[one_way], weights=qw[i[one_way]], minlength=len(m)).astype(np.int64)
    nodes, at = np.unique(np.concatenate([qid, mid]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[i], at[len(q) + j]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    links = np.bincount(at, weights=np.concatenate([q_links, m_links]), minlength=len(nodes)).astype(np.int64)
    keep = (links > 0) | (label != np.arange(len(nodes)))
    return pd.DataFrame({"cid": nodes[keep], "links": links[keep], "root": nodes[label[keep]]})


def _links_of_length(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(cid, links, root) parts of all classes of one vector length."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.orderBy("h1", "h2").limit(SAMPLE).select("vec").toPandas()  # bounded by SAMPLE
    quantiser = Quantiser(unit(scaled(np.stack([np.asarray(v, dtype=np.float64) for v in sample["vec"]]))), n)
    shared = spark.sparkContext.broadcast(quantiser)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quant = shared.value
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.iloc[a:a + 2000]
                raw = scaled(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]]))
                x = unit(raw)
                probes = quant.lists(x)
                codes, error = quant.code(x - quant.centre(probes[:, 0]))
                yield pd.DataFrame({
                    "cid": part["cid"], "w": part["w"], "vec": [v.tobytes() for v in raw], "own": probes[:, 0],
                    "codes": [c.tobytes() for c in codes], "error": error, "probes": [p.tobytes() for p in probes], "lists": list(probes)})

    indexed = materialise(classes.select("cid", "w", "vec").mapInPandas(
        index, "cid long, w long, vec binary, own long, codes binary, error double, probes binary, lists array<long>"), "pq-index")
    # a row for each list
    m_blocks = indexed.groupBy(F.col("own").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"))
    q_blocks = indexed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    blocks = materialise(m_blocks.join(q_blocks, "list"), "pq-blocks")
    cut = lambda c, parts: F.pmod(F.xxhash64("cid", F.lit(7)), F.col(parts)).cast("int").alias(c)
    spread = lambda c, parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias(c)
    members = indexed.withColumnRenamed("own", "list").join(blocks, "list").select(
        "list", cut("mb", "mb"), spread("qb", "qb"), "cid", "w", "vec", "codes", "error", "probes")
    queries = indexed.select(F.explode("lists").alias("list"), "cid", "w", "vec", "own").join(blocks, "list").select(
        "list", spread("mb", "mb"), cut("qb", "qb"), "cid", "w", "vec", "own").toDF("list", "mb", "qb", "q_cid", "q_w", "q_vec", "own")

    def linked(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": [], "root": []})
        return block_links(shared.value, int(key[0]), left, right, cosine)

    keys = ["list", "mb", "qb"]
    members = members.toDF(*members.columns)
    return members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(linked, "cid long, links long, root long")


def near_duplicates(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship_package(rows.sparkSession)
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = rows.select("vec_id", vec.alias("vec")).withColumn(
        "ok", F.coalesce((F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False)))
    keyed = flat.select("vec_id", "ok", F.when(F.col("ok"), F.xxhash64("vec")).alias("h1"),
                        F.when(F.col("ok"), F.xxhash64(F.lit(SEED), "vec")).alias("h2"), "vec")
    classes = materialise(
        keyed.where("ok").groupBy("h1", "h2").agg(F.count("*").alias("w"), F.first("vec").alias("vec"), F.min("vec_id").alias("first_id"))
        .withColumn("dim", F.size("vec")).withColumn("cid", F.monotonically_increasing_id()), "pq-classes")
    parts = None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():  # vector lengths
        some = _links_of_length(classes.where(F.col("dim") == dim), dim, cosine)
        parts = some if parts is None else parts.unionByName(some)
    empty = classes.select("cid", F.col("w").alias("links"), F.col("cid").alias("root")).limit(0)
    parts = materialise(parts if parts is not None else empty, "pq-links")
    counts = parts.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(parts.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    placed = classes.select("cid", "h1", "h2", "w", "first_id").join(counts, "cid", "left").join(
        roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = materialise(placed, "pq-placed")
    least = materialise(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "pq-least")
    facts = materialise(placed.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), "component_id"), "pq-facts")
    out = keyed.drop("vec").join(facts, ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
