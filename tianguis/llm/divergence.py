"""Source divergence audit: chi-squared-like distances between the sources of a language.

A term is a run of letters (A-Z lower-cased) and of characters beyond ASCII. A language
keeps the terms that occur in at least ``least_docs`` of its documents, V of them. With
count c of a term and N the sum over kept terms, a source has the smoothed share
p = 1 + floor(10^9 (c + 2) / (N + 2 V)) for every kept term, so does the language. The
distance of two shares is f(p, q) = floor((p - q)^2 / (p + q)). ``pair`` rows give, for
every other source of the language, f summed over all kept terms; ``term`` rows the
terms a source uses more than its language does, by f, down to ``best``.

Sums are accumulated by rows, as in Gustavson's sparse matrix product. The counts form
a term-major index: one row per term with the list of its sources. It is dealt into
blocks of whole terms of about ``BLOCK`` postings of one language. In a block every source
takes its terms, one after the other, through the index and adds to one dense
accumulator with a place for each peer; no pair of postings is ever a row. Terms that a
source lacks have its baseline share b (count 0). The sums are therefore taken as
differences to the baselines:

    V f(b_g, b_h) + sum over terms of g of [f(p, b_h) - f(b_g, b_h)] and the same of h
    + sum over common terms of [f(p, q) - f(p, b_h) - f(b_g, q) + f(b_g, b_h)]

The first two sums need no index: terms of equal count have equal shares, so they are
taken once per distinct count. Block results are added up by Spark, a number for each
pair of sources that the result lists anyway.

All arithmetic is exact, in 64-bit integers: shares are divided in three steps of 1,000,
which holds for N + 2 V below 9 10^15. A language with many sources has its accumulator rows
dealt to several tasks (``CELLS`` numbers a task), each of which reads the block's index.

Defined cases: null text, lang and source are ''; a language with one source has no
pairs; one without kept terms has pairs of value 0; sources without terms are peers like
any other; repeated rows are documents of their own; empty tables give empty results;
other columns are not looked at. Texts are read in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ship_package

LEAST_DOCS = 10
BEST = 10
BLOCK = 1 << 18     # postings of a block
CELLS = 1 << 22     # accumulator cells of a task
HELD = 200_000      # counters a task holds before it hands them on
PIECE = 1 << 20     # bytes of a text that are split at a time
SCALE = 1_000       # shares are out of SCALE^3

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        piece = text[at:at + PIECE].translate(_NORMAL)
        at += len(piece)
        while at < len(text) and not piece.endswith(b" "):
            more = text[at:at + PIECE].translate(_NORMAL)
            cut = more.find(b" ") + 1
            piece, at = (piece + more[:cut], at + cut) if cut else (piece + more, at + len(more))
        yield piece.split()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, docs) partial counts of a task."""
    held: dict = defaultdict(Counter)   # (lang, source) -> occurrences
    docs: dict = defaultdict(Counter)   # (lang, source) -> documents
    size = 0

    def hand_on():
        rows = [(lang, source, t.decode("utf-8", "replace"), n, docs[lang, source][t]) for (lang, source), c in held.items() for t, n in c.items()]
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"]).astype({c: object for c in ("lang", "source", "term")})

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            c, mine = held[lang, source], Counter()
            for words in _words(text or b""):
                mine.update(words)
            before = len(c)
            c.update(mine)
            docs[lang, source].update(mine.keys())
            size += len(c) - before
            if size > HELD:
                yield hand_on()
                held, docs, size = defaultdict(Counter), defaultdict(Counter), 0
    yield hand_on()


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total) by long division in base 1,000."""
    left, out = count.astype(np.int64) + 2, np.zeros(len(count), dtype=np.int64)
    whole, left = left // total, left % total
    for _ in range(3):
        left = left * SCALE
        out, left = out * SCALE + left // total, left % total
    return 1 + out + whole * SCALE ** 3


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block(peers: pd.DataFrame, index: pd.DataFrame, lang: str, bucket: int, rows: range, best: int) -> Iterator[pd.DataFrame]:
    """What a block of terms adds to the rows ``rows`` of the pair sums, and its best terms of these sources.

    ``peers`` lists all sources of the language by name (total, and V in ``terms``); ``index`` the block's terms."""
    peers = peers.sort_values("source", ignore_index=True)
    names, totals, terms = peers["source"].to_numpy(object), peers["total"].to_numpy(np.int64), int(peers["terms"].iloc[0])
    n = len(names)
    floor_of = np.array([shares(np.zeros(1), t + 2 * terms)[0] if terms else 0 for t in totals.tolist()], dtype=np.int64)
    place = {s: i for i, s in enumerate(names)}
    # term-major: the sources and counts of term t lie at start[t] : start[t + 1]
    lists = index["sources"].tolist()
    size = np.array([len(x) for x in lists], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    peer = np.array([place[s] for x in lists for s in x], dtype=np.int64)
    count = np.array([c for x in index["counts"] for c in x], dtype=np.int64)
    share = np.zeros(len(peer), dtype=np.int64)
    by_peer = np.argsort(peer, kind="stable")  # group-major: the postings of each source
    cut = np.searchsorted(peer[by_peer], np.arange(n + 1))
    for g in range(n):
        mine = by_peer[cut[g]:cut[g + 1]]
        if len(mine):
            share[mine] = shares(count[mine], int(totals[g]) + 2 * terms)
    term_of = np.repeat(np.arange(len(lists)), size)
    if len(lists):
        of_lang = shares(np.add.reduceat(count, start[:-1]), int(totals.sum()) + 2 * terms)
    for g in rows:
        mine = by_peer[cut[g]:cut[g + 1]]
        base = distance(floor_of[g], floor_of) if terms else np.zeros(n, dtype=np.int64)
        total = terms * base if bucket == 0 else np.zeros(n, dtype=np.int64)
        if len(mine):
            # terms of g against baselines of all peers, once per distinct share; the same sum counts for (peer, g)
            own = np.zeros(n, dtype=np.int64)
            value, times = np.unique(share[mine], return_counts=True)
            step = max(1, CELLS // n)
            for at in range(0, len(value), step):
                p, k = value[at:at + step, None], times[at:at + step, None]
                own += ((distance(p, floor_of[None, :]) - base[None, :]) * k).sum(axis=0)
            yield pd.DataFrame({"lang": lang, "source": names, "part": "pair", "item": names[g], "value": own})
            # scatter: each term of g through its list into the accumulator of peers
            lengths = size[term_of[mine]]
            upto = np.cumsum(lengths)
            step_to = np.searchsorted(upto, np.arange(CELLS, int(upto[-1]) + CELLS, CELLS))
            lo = 0
            for hi in dict.fromkeys(np.minimum(step_to + 1, len(mine)).tolist()):
                part, reps = mine[lo:hi], lengths[lo:hi]
                if not len(part):
                    continue
                at = np.arange(int(reps.sum())) + np.repeat(start[term_of[part]] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps)
                p, h = np.repeat(share[part], reps), peer[at]
                q = share[at]
                np.add.at(total, h, distance(p, q) - distance(p, floor_of[h]) - distance(floor_of[g], q) + base[h])
                lo = hi
            total += own
            p, q = share[mine], of_lang[term_of[mine]]
            over = np.flatnonzero(p > q)
            if len(over):
                f = distance(p[over], q[over])
                item = index["term"].to_numpy(object)[term_of[mine][over]]
                if len(f) > best:
                    keep = np.flatnonzero(f >= np.partition(f, -best)[-best])
                    f, item = f[keep], item[keep]
                top = sorted(zip((-f).tolist(), item))[:best]
                yield pd.DataFrame({"lang": lang, "source": names[g], "part": "term", "item": [t for _, t in top], "value": [-v for v, _ in top]})
        if len(mine) or bucket == 0:
            yield pd.DataFrame({"lang": lang, "source": names[g], "part": "pair", "item": names, "value": total})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank) of all sources of ``docs(text, lang, source)``."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = materialise(docs.select(*blank).distinct(), "divergence-groups")
    counts = (docs.select(*blank, F.col("text").cast("binary").alias("text"))
              .mapInPandas(_count, "lang string, source string, term string, n long, docs long"))
    # one exchange: both groupings are clustered by (lang, term)
    index = materialise(
        counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("x"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs).select("lang", "term", F.col("x.source").alias("sources"), F.col("x.n").alias("counts")), "divergence-index")
    totals = (index.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
              .groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total")))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(
        index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.size("sources")).alias("postings")), "lang", "left")
    langs = materialise(langs.select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("postings", F.lit(0)) / BLOCK)).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("n_sources") * F.col("n_sources") / CELLS)).cast("int").alias("slices")), "divergence-langs")
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    peers = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
             .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "slices",
                     F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
             .select("lang", "source", "total", "terms", "slices", "block", slices))
    dealt = (index.join(langs, "lang")
             .select("lang", "term", "sources", "counts", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), slices))

    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lang, block, part = key
        n, of = len(left), int(left["slices"].iloc[0])
        rows = range(n * part // of, n * (part + 1) // of)
        nothing = pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "value": np.zeros(0, dtype=np.int64)})
        out = pd.concat([nothing, *_block(left, right, lang, block, rows, best)], ignore_index=True)
        return out.astype({c: object for c in ("lang", "source", "part", "item")} | {"value": np.int64})

    found = peers.groupBy("lang", "block", "slice").cogroup(dealt.groupBy("lang", "block", "slice")).applyInPandas(
        work, "lang string, source string, part string, item string, value long")
    added = (found.where("part = 'term' or source <> item").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc()))
    return added.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= best)).select(
        "lang", "source", "part", "item", "value", "rank")


def oracle(least_docs: int = LEAST_DOCS, best: int = BEST) -> str:
    """DuckDB SQL for ``audit``: the dense form, every kept term for every pair of sources."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = "1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.terms)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         translate(coalesce(text, ''), '{capitals}', '{small}') AS text FROM documents),
    words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
    cell AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
    v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
    g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN cell USING (lang, source) GROUP BY lang, source),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p} AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v.terms) AS q
              FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM dense WHERE n > 0 AND p > q),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
    SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= {best}"""
