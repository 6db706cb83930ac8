from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tianguis.llm import bpe, common, minhash, quality


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sets_of(texts, width):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        out.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def brute_components(ids, texts, width, percent=80):
    sets = sets_of(texts, width)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j]:
                n = len(s & sets[j])
                if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least.setdefault(find(i), []).append(x)
    return {x: (len(sets[i]), min(least[find(i)])) for i, x in enumerate(ids)}


def family(rng, n, size, most):
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(size)] = f"v{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "hot"), [(2, None), (5, None), (2, 16)])
def test_components_equal_brute_force(shipped, monkeypatch, width, hot):
    """A large group of near copies around the threshold, copies, texts that share a passage."""
    rng = random.Random(width)
    texts = family(rng, 120, 60, 12) + family(rng, 15, 12, 3) + ["short text"] * 5 + ["one", "ONE", "two", "", " "]
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    rng.shuffle(texts)
    if hot:
        monkeypatch.setattr(minhash, "HOT", hot)
    ids = [10 * k + 3 for k in range(len(texts))]
    docs = shipped.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == brute_components(ids, texts, width)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(1, 1 << 62, int(2000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(1, 1 << 62, 2000 - len(both), dtype=np.uint64)])) for _ in range(2))
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minhash.signature(a)[0], minhash.signature(b)[0]
        differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert abs((1 - 2 * differ / minhash.HASHES) - real) < 0.25


def test_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert {x[1] for x in by[5] + by[6]} == {5} and by[6][0][2] is False
    assert sorted(x[0] for x in by[None]) == [0, 1] and {x[1:] for x in by[None]} == {(None, False)}
    assert minhash.near_duplicates(no_docs, 5).count() == 0


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    out = minhash.deduplicated(odd_docs)
    assert out.schema == odd_docs.schema
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert rows.count((5, "same text here again and again")) == 1 and 6 not in [r[0] for r in rows]
    assert {1, 2, 3, 4, 7, 8, 9, None} <= {r[0] for r in rows} and [r[0] for r in rows].count(7) == 2
    assert minhash.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("finish", [3, 1_000_000])
def test_components_of_a_graph(shipped, monkeypatch, finish):
    monkeypatch.setattr(common, "FINISH_EDGES", finish)
    edges = [(k, k + 1) for k in range(100, 130)] + [(500, k) for k in range(400, 440)] + [(1, 1), (7, 6), (6, 7)]
    df = shipped.createDataFrame([*edges, (None, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, **{k: 400 for k in [*range(400, 440), 500]}, 6: 6, 7: 6}
    assert common.components(df.limit(0)).count() == 0


def test_every_class_of_a_split_bucket_is_listed(shipped, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 8)
    rng = random.Random(12)
    rows = [(k, 50, [rng.getrandbits(63) for _ in range(4)], [7]) for k in range(40)]
    rows += [(100 + k, 50, rows[k][2], [7]) for k in range(20)]
    classes = shipped.createDataFrame(rows, "node long, n int, bits array<long>, bands array<long>")
    listed = minhash.candidate_pairs(classes, 80).where("key = 7").collect()
    assert {r["a"] for r in listed} == {r[0] for r in rows}


def test_a_worker_holds_little_text_at_a_time(shipped, monkeypatch):
    """Texts are cut into small slices, a longer one is a slice of its own; links stay the same."""
    assert minhash.SLICE <= 200_000
    words = [f"w{k}" for k in range(400)]
    docs = shipped.createDataFrame([(k, " ".join(words[k % 5:] + words[:k % 3]) if k % 4 else None) for k in range(40)], "doc_id long, text string")
    whole = sorted(map(str, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "SLICE", 10)
    assert whole == sorted(map(str, minhash.near_duplicates(docs).collect()))
    for n in (5, 70_000, 10):
        assert len(minhash._powers(n)[0]) >= n
    assert len(minhash._POWERS) == 2  # one table, whatever lengths were asked for


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_a_task_holds_nothing_of_other_operators(monkeypatch):
    """A worker serves the tasks of all stages; what the tokenizer learnt there goes when another operator's task begins."""
    monkeypatch.setitem(bpe._ENCODERS, ("some file", ""), "an encoder")
    rows = []

    def run(batches):
        rows.append(len(bpe._ENCODERS))
        yield from batches
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2] and rows == [0]


def test_a_task_gives_its_memory_back():
    def run(batches):
        kept = [[np.zeros(1 << 12) for _ in range(6000)] for _ in range(1)]  # 200 MB in pieces that malloc keeps
        yield held_mb()
        tail = np.zeros(1 << 12)  # above them, so that the heap cannot shrink by itself
        del kept
        yield tail
    peak, tail = common.lean(run)(iter([]))
    assert held_mb() < peak - 100


@pytest.mark.parametrize("make", [
    lambda docs: minhash.described(docs, 5), lambda docs: minhash.full_sets(docs, 5, docs.select(common.text_key().alias("text_key"))),
    lambda docs: quality.packed_counts(docs, 1)])
def test_passes_over_texts_are_lean(shipped, monkeypatch, make):
    """Every pass over whole texts of the two stages goes through ``lean``."""
    met = []
    monkeypatch.setattr(minhash, "lean", lambda run: met.append(run) or common.lean(run))
    monkeypatch.setattr(quality, "lean", lambda run: met.append(run) or common.lean(run))
    docs = shipped.createDataFrame([(1, "a b c d e f g", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert make(docs).count() and len(met) == 1
