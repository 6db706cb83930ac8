"""Benchmark decontamination by pigeonhole pieces and bit-parallel verification.

Texts and test items are compared in a canonical form: lower case, words of letters
and digits joined by single blanks, with a blank at either end, which an item must find
too: it starts and ends where words do. An item of n characters may differ from a
passage by k = n // CHARS_PER_EDIT edits (insertions, deletions, replacements). Cut
into k + 1 pieces, at least one piece occurs exactly in such a passage: an
Aho-Corasick automaton over all pieces finds those hits in one walk over each whole
text, and each hit is verified in its window with Myers' bit-parallel distance.

Items are handled in blocks of at most BLOCK_CHARS characters, so what is broadcast and what
a worker holds are bounded; every block goes against all documents, one scan of the texts per
block. Hits are merged by item id after all blocks (fewest edits, then the smallest end), so
results do not depend on the blocks.

Defined cases: a null or empty text holds no item; null items and items without a word
match nothing; items shorter than CHARS_PER_EDIT must occur exactly; repeated items each
count under their id, items without an id count as item -1; repeated documents each get
their row; an empty benchmark leaves every document clean, an empty table of documents
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, packed_text, ship_package, text_key, unpacked_text

CHARS_PER_EDIT = 20
BLOCK_CHARS = 4_000_000

_WORDS = re.compile(r"[^\W_]+")


def canonical(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if isinstance(text, str) else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in budget + 1 pieces of nearly equal length."""
    cut = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers_search(masks: dict[str, int], size: int, window: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best substring of ``window`` within ``budget`` edits of the
    pattern: one column of the edit table per character, as bit vectors of +1 and -1 steps."""
    plus, minus, score = (1 << size) - 1, 0, size
    top, all_bits = 1 << (size - 1), (1 << size) - 1
    best = None
    for at, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & all_bits
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & all_bits
        mh = (mh << 1) & all_bits
        plus = (mh | ~(xv | ph)) & all_bits
        minus = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


class ItemBlock:
    """Automaton and bit masks of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.texts = [f" {t} " for _, t in items]
        self.budget = [len(t) // CHARS_PER_EDIT for _, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            for offset, piece in pieces(t, self.budget[k]):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, (len(piece), spots))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            got: dict[str, int] = {}
            for at, c in enumerate(self.texts[k]):
                got[c] = got.get(c, 0) | 1 << at
            self.masks[k] = got
        return self.masks[k]

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item id -> (edits, end in the canonical text) of its best passage, the first of equal ones."""
        t = canonical(text)
        found: dict[int, tuple[int, int]] = {}
        if self.empty or not t:
            return found
        whole, t = len(t), f" {t} "
        tried: set[tuple[int, int]] = set()
        exact: set[int] = set()
        for end, (length, spots) in self.automaton.iter(t):
            for k, offset in spots:
                if k in exact:
                    continue
                begin = end + 1 - length - offset
                if (k, begin) in tried:
                    continue
                tried.add((k, begin))
                item, budget = self.texts[k], self.budget[k]
                if begin >= 0 and t.startswith(item, begin):
                    got, shift = (0, len(item)), begin
                    exact.add(k)
                elif budget:
                    shift = max(0, begin - budget)
                    got = myers_search(self._masks(k), len(item), t[shift:begin + len(item) + budget], budget)
                else:
                    got = None
                if got:
                    hit = (got[0], min(max(shift + got[1] - 2, 0), whole))  # without the blanks before and behind
                    name = self.ids[k]
                    if name not in found or hit < found[name]:
                        found[name] = hit
        return found


_OPEN: tuple[str, ItemBlock] | None = None


def _opened(name: str, items: list[tuple[int, str]]) -> ItemBlock:
    """The block's automaton; a worker builds it once and holds one block at a time."""
    global _OPEN
    if _OPEN is None or _OPEN[0] != name:
        _OPEN = (name, ItemBlock(items))
    return _OPEN[1]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(id, canonical text) of all items, in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = canonical(row["text"])
        if text:
            block.append((-1 if row["item_id"] is None else row["item_id"], text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("end", T.LongType())]))


def hits_column(docs: DataFrame, items: list[tuple[int, str]]):
    """Array of (item_id, edits, end) for the text column of ``docs``."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        block = _opened(name, shared.value)
        return pd.Series([[{"item_id": i, "edits": e, "end": at} for i, (e, at) in sorted(block.find(t).items())] for t in texts], dtype=object)
    return hits("text")


def _found(docs: DataFrame, blocks: Iterator[list[tuple[int, str]]]) -> DataFrame | None:
    """(__id, __k, hits) of the documents with hits: the blocks' own results, a scan each, merged."""
    keyed, out = docs.select("doc_id", "text", text_key().alias("__k")), None
    for items in blocks:
        part = materialise(keyed.select(F.col("doc_id").alias("__id"), "__k", hits_column(keyed, items).alias("hits")).where(F.size("hits") > 0).distinct(), "dec-hits")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return None
    merged = out.groupBy("__id", "__k").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return merged.withColumn("hits", F.expr("filter(hits, (x, i) -> i = 0 OR x.item_id <> element_at(hits, greatest(i, 1)).item_id)"))


def _split(benchmark: DataFrame) -> tuple[list[tuple[int, str]], Iterator[list[tuple[int, str]]] | None]:
    """The only block, or an iterator over all of them where there are several."""
    blocks = item_blocks(benchmark)
    first = next(blocks, [])
    second = next(blocks, None)
    return first, None if second is None else itertools.chain([first, second], blocks)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids, hits."""
    ship_package(docs.sparkSession)
    only, several = _split(benchmark)
    if several is None:
        out = docs.select("doc_id", hits_column(docs, only).alias("hits"))
    else:
        rows = docs.select("doc_id", text_key().alias("__key"))
        out = rows.join(_found(docs, several), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left").select(
            "doc_id", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
                      F.array_sort(F.col("hits.item_id")).alias("item_ids"), "hits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of a test item."""
    ship_package(docs.sparkSession)
    only, several = _split(benchmark)
    if several is None:
        return docs.where(F.size(hits_column(docs, only)) == 0)
    bad = _found(docs, several).select("__id", "__k").hint("shuffle_hash")
    rows = packed_text(docs.withColumn("__key", text_key()))
    return unpacked_text(rows.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_anti").drop("__key"))
