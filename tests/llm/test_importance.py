from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tianguis.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain(text):
    """(words, buckets of all features) with every n-gram built."""
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), collections.Counter(zlib.crc32(b" ".join(w[i:i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(docs, target):
    every, goal = collections.Counter(), collections.Counter()
    for _, t in docs:
        every.update(plain(t)[1])
    for t in target:
        goal.update(plain(t)[1])
    s_all, t_all = sum(every.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10_000) / ((every[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, t in docs:
        n, f = plain(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in f.items())
        rows.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    place = {id(r): k + 1 for k, r in enumerate(fit[:5 * len(fit) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], place.get(id(r))) for r in rows), key=str)


def test_crc_of_a_substring_from_two_prefixes():
    rng = random.Random(3)
    for n in [0, 1, 5, 63, 64, 65, 200, 4097, 70_000]:
        a, b = rng.randbytes(50), rng.randbytes(n)
        before, after = zlib.crc32(a), zlib.crc32(a + b)
        got = after ^ int(importance.shifted(np.array([before], dtype=np.uint32), np.array([n]))[0])
        assert got == zlib.crc32(b), n


@pytest.mark.parametrize("piece", [7, 60, 1 << 20])
def test_features_equal_built_ngrams(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab Z9é漢\n-_") for _ in range(rng.choice([0, 1, 5, 60, 300]))).encode() for _ in range(300)]
    texts += [b"x" * 1000 + b" y" * 100, None, b"", b" \t"]
    words, got = np.zeros(len(texts), dtype=int), [collections.Counter() for _ in texts]
    for rows, buckets, n in importance._scan(texts, 10_000):
        words += n
        for r, b in zip(rows.tolist(), buckets.tolist()):
            got[r][b] += 1
    assert [(int(n), c) for n, c in zip(words, got)] == [plain(t.decode() if t else t) for t in texts]


def some_docs(rng, n):
    return [(i, " ".join(f"w{int(300 * rng.random() ** 2)}" for _ in range(rng.choice([3, 19, 20, 50])))) for i in range(n)]


def rows_of(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_draw_equals_brute_force_whatever_the_partitions(shipped):
    rng = random.Random(11)
    docs, target = some_docs(rng, 400), [t for _, t in some_docs(rng, 20)]
    want = brute(docs, target)
    goal = shipped.createDataFrame([(t,) for t in target], "text string")
    for parts in (1, 5):
        df = shipped.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        assert rows_of(importance.resampled(df, goal)) == want
    picked = importance.drawn(df, goal)
    assert sorted(r["doc_id"] for r in picked.collect()) == sorted(r[0] for r in want if r[4]) and picked.columns == df.columns


def test_oracle_agrees(shipped):
    rng = random.Random(12)
    docs, target = some_docs(rng, 120) + [(900, None), (901, ""), (902, "É é-1")], [t for _, t in some_docs(rng, 5)] + [None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (1, ?)", [(t,) for t in target])
    assert sorted(con.sql(importance.oracle()).fetchall(), key=str) == brute(docs, target)


def test_odd_rows(odd_docs, no_docs, shipped):
    target = odd_docs.where("doc_id = 5").select("text", "kept")
    rows = importance.resampled(odd_docs, target, percent=100, least_words=2).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in rows if r["doc_id"] in (1, 2, 3))
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 8
    assert importance.drawn(odd_docs, target, percent=100, least_words=2).count() == 8
    assert importance.resampled(no_docs, target).collect() == [] and importance.resampled(odd_docs, no_docs).count() == odd_docs.count()
