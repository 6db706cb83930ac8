from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from tianguis.llm import suffixes
from tianguis.llm.suffixes import SPAN, WINDOW


def brute(texts):
    """(bytes, removed, spans, digest of the rest) of each text, from all windows of all texts."""
    raw = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    seen = collections.Counter(t[i:i + WINDOW] for t in raw for i in range(len(t) - WINDOW + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, dtype=bool)
        for i in range(len(t) - WINDOW + 1):
            if seen[t[i:i + WINDOW]] > 1:
                gone[1 + i:1 + i + WINDOW] = True
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def some_texts(rng, n):
    """Random texts with passages of about WINDOW bytes in common, copies, and runs of one letter."""
    def noise(k):
        return "".join(rng.choice("abcdefgh é漢") for _ in range(k))

    shared = [noise(k) for k in (150, 199, 200, 201, 260, 700)]
    out = []
    for _ in range(n):
        parts = [noise(rng.choice([0, 3, 40, 300]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.choice([0, 0, 1, 30])
            parts += [p[a:], noise(rng.choice([0, 1, 20, 250]))]
        out.append("".join(parts))
    return out + out[:3] + ["a" * 199, "b" * 200, "c" * 201, "d" * 1000, "xyz" * 200, noise(100) * 5, "", noise(2500)]


def check(spark, texts, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    want = sorted((i, *row) for i, row in enumerate(brute(texts)))
    assert rows_of(suffixes.deduplicated(df)) == want


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_brute_force(shipped, parts):
    check(shipped, some_texts(random.Random(parts), 60), parts)


def test_crowded_collections_are_narrowed(shipped, monkeypatch):
    """A passage with other surroundings in every text: its edge collections exceed the limit at each width."""
    monkeypatch.setattr(suffixes, "HOT", 4)
    check(shipped, some_texts(random.Random(4), 60))


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    suffixes._hashing.cache_clear()
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd") for _ in range(2000))
    starts = []
    for buf, ends, where in suffixes._chunks([None, b"x" * 100, text, text[:250]]):
        t, first, last, anchor, code = suffixes.anchors(buf, ends)
        offsets = np.concatenate([[0], ends])
        for i, a, b, c in zip(t, first, last, anchor):
            assert 0 <= c - b and c - a < SPAN
            row, at = where[i]
            starts += [(row, at - offsets[i] + s) for s in range(a, b + 1)]
    suffixes._hashing.cache_clear()
    assert sorted(starts) == [(2, s) for s in range(2000 - WINDOW + 1)] + [(3, s) for s in range(51)]


def test_columns_find_equal_windows():
    """Pieces of some collections, lined up on their anchors, against all pairs."""
    rng = random.Random(2)
    pieces, back, group = [], [], []
    for g in range(30):
        core = bytes(rng.choice(b"ab") for _ in range(WINDOW + 300))
        for _ in range(rng.randint(1, 12)):
            o = rng.randint(0, SPAN - 1)
            n = rng.randint(1, o + 1)
            p = bytearray(core[150 - o:150 - o + n + WINDOW - 1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] ^= 3
            pieces.append(bytes(p)), back.append(o), group.append(g)
    got = suffixes.sort_columns(pieces, np.array(back), np.array(group))
    for x, (p, o, g) in enumerate(zip(pieces, back, group)):
        for i in range(SPAN):
            mine = p[o - i:o - i + WINDOW] if i <= o else b""
            want = len(mine) == WINDOW and any(y != x and g == h and i <= u and q[u - i:u - i + WINDOW] == mine
                                               for y, (q, u, h) in enumerate(zip(pieces, back, group)))
            assert got[i, x] == want


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    key = str
    want = sorted(((r["doc_id"], *b) for r, b in zip(rows, brute([r["text"][:5000] if r["text"] and len(r["text"]) > 5000 else r["text"] for r in rows]))), key=key)
    cut = odd_docs.selectExpr("doc_id", "left(text, 5000) AS text", "lang", "kept", "key", "n")
    got = suffixes.deduplicated(cut).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=key) == want
    whole = suffixes.deduplicated(odd_docs).where("doc_id = 4").first()
    assert whole["n_removed"] == whole["n_bytes"] == 300_000 and whole["n_spans"] == 1 and whole["kept"] == b""
    assert suffixes.deduplicated(no_docs).collect() == []
