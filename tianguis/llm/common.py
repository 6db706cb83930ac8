"""Helpers shared by the operators: tables, durable intermediates, components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; also sees to it that executors can import the package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[str]] = []


def materialise(df: DataFrame, tag: str, lasting: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs a re-read and not a recomputation. Each call has a folder of its own;
    within ``spent`` it is removed at the end, unless it is ``lasting``."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{tag}-{uuid.uuid4().hex}")
    if _SCOPES and not lasting:
        _SCOPES[-1].append(path)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def spent(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, but for lasting ones, are removed at the end: what
    is returned must not read them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def packed_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the text column compressed (binary), for exchanges of whole rows; a few rows at a time."""
    def pack(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                column = pa.array([None if t is None else compress(t) for t in part.column(at).cast(pa.large_binary()).to_pylist()], pa.binary())
                yield part.set_column(at, "text", column)
    return docs.mapInArrow(pack, _with_text(docs, "binary"))


def unpacked_text(docs: DataFrame) -> DataFrame:
    """The inverse of ``packed_text``, a few rows at a time."""
    def unpack(batches):
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                column = pa.array([None if t is None else expand(t).decode() for t in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, "text", column)
    return docs.mapInArrow(unpack, _with_text(docs, "string"))


def _with_text(docs: DataFrame, kind: str) -> StructType:
    return StructType([StructField(f.name, BinaryType() if kind == "binary" else StringType(), True) if f.name == "text" else f for f in docs.schema])


def text_key(text_col: str = "text"):
    """Hash of a text (null counts as empty), the second half of a row's identity:
    rows that agree in doc_id and text are the same row to every operator."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and odd multipliers), element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


FINISH_EDGES = 1_000_000  # a graph contracted to so few edges is finished by one task (16 MB)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(b["a"].to_numpy(np.int64), b["b"].to_numpy(np.int64)) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": nodes, "root": nodes[label]})


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): smallest node reachable over undirected ``edges(a, b)`` of long nodes.

    Rounds of hooking and contraction: each node points at its smallest
    neighbour, pointers are doubled until they reach roots, edges are rewritten
    to roots and those inside one tree dropped. Every round at least halves the
    nodes that still have edges, so rounds grow with the logarithm of the graph
    whatever its diameter; the last FINISH_EDGES edges are solved in one task.
    Hot nodes only meet partial minimum aggregates and inner joins whose hot side
    adaptive execution can split. Nodes without an edge are not listed; self-loops
    and nulls are ignored; no edges: no rows."""
    e = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{tag}-edges")
    mapping = None
    while True:
        if e.count() <= FINISH_EDGES:
            parent = materialise(e.coalesce(1).mapInPandas(_solve, "node long, root long"), f"{tag}-last")
            return parent if mapping is None else _mapped_on(mapping, parent, tag)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
            .select("node", F.least("node", "m").alias("root")), f"{tag}-hook")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            parent = materialise(parent.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), f"{tag}-jump")
            moved = not parent.where("moved").isEmpty()
            parent = parent.select("node", "root")
            if not moved:
                break
        mapping = parent if mapping is None else _mapped_on(mapping, parent, tag)
        pa = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = materialise(e.join(pa, "a").join(pb, "b").where("ra <> rb")
                        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                        f"{tag}-edges")


def _mapped_on(mapping: DataFrame, parent: DataFrame, tag: str) -> DataFrame:
    """``mapping`` with its roots replaced by their roots in ``parent``."""
    up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return materialise(mapping.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{tag}-map")


LEARNT: list[dict] = []  # what operators keep in a worker from one task to the next


def give_back() -> None:
    """Returns the memory that this worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (of ``mapInPandas``) in a worker that holds nothing else: a worker serves the tasks of all
    operators of an application, and what earlier ones learnt or freed would count beside the task's own."""
    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        for learnt in LEARNT:
            learnt.clear()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors' Python as a zip file, once per application
    (what ``--py-files`` does for a submitted job); workers import the operators from it."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tianguis-zip-"), "tianguis_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(top, "tianguis")):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
