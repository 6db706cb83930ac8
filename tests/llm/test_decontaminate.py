from __future__ import annotations

import random

import pytest

from tianguis.llm import decontaminate as D


def distance(p, t):
    """Best edit distance of p to a substring of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for j, x in enumerate(p):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def masks(p):
    out = {}
    for k, c in enumerate(p):
        out[c] = out.get(c, 0) | 1 << k
    return out


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(5000):
        p, t = ("".join(rng.choice("ab ") for _ in range(rng.randint(a, 20))) for a in (1, 0))
        k = rng.randint(0, len(p) - 1)
        got, want = D.myers_search(masks(p), len(p), t, k), distance(p, t)
        assert (got[0] if got else None) == (want if want <= k and t else None)


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 300])
def test_hits_equal_brute_force(shipped, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(8, 30))) for k in range(12)] + [(50, "tiny"), (51, ""), (52, None)]
    docs = []
    for k in range(60):
        t = sentence(rng, rng.randint(0, 80))
        if k % 2:
            passage = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(passage) // D.CHARS_PER_EDIT + 3)):
                passage[rng.randrange(len(passage))] = rng.choice("xyz")
            t = f"{t} {''.join(passage).upper()}! {sentence(rng, 5)}"
        docs.append((k, t))
    want = {}
    for i, t in docs:
        c = f" {D.canonical(t)} "
        want[i] = sorted(j for j, x in items if D.canonical(x) and distance(f" {D.canonical(x)} ", c) <= len(D.canonical(x)) // D.CHARS_PER_EDIT)
    out = D.contamination(shipped.createDataFrame(docs, "doc_id long, text string"), shipped.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in out.collect()} == want


def test_items_start_and_end_where_words_do():
    block = D.ItemBlock([(1, "art"), (2, "state of the art in parsing of long texts")])
    assert block.find("we went to a party") == {} and block.find("Art!") == {1: (0, 3)}
    assert block.find("the state of the art in parsing of long texts") == {1: (0, 20), 2: (0, 45)}
    assert block.find("my estate of the art in parsing of long textsy")[2][0] == 2


def test_blocks_do_not_show(shipped, monkeypatch):
    """One id in several blocks, and items of many blocks, give the rows of one block."""
    rng = random.Random(3)
    items = [(k % 5, sentence(rng, 4)) for k in range(30)]
    docs = [(k, None if k == 7 else " ".join(rng.choice(items)[1] for _ in range(rng.randint(0, 4)))) for k in range(40)] + [(None, items[0][1])] * 2
    d, b = shipped.createDataFrame(docs, "doc_id long, text string"), shipped.createDataFrame(items, "item_id long, text string")
    got, kept = [], []
    for size in (40, 4_000_000):
        monkeypatch.setattr(D, "BLOCK_CHARS", size)
        got.append(sorted(map(str, D.contamination(d, b).collect())))
        kept.append(sorted(map(str, D.clean(d, b).collect())))
    assert got[0] == got[1] and kept[0] == kept[1] and 0 < len(kept[0]) < len(docs)
    assert all(len(set(r["item_ids"])) == len(r["item_ids"]) for r in D.contamination(d, b).collect())


def test_a_worker_builds_a_block_once(monkeypatch):
    built = []
    monkeypatch.setattr(D, "ItemBlock", lambda items: built.append(items) or items)
    monkeypatch.setattr(D, "_OPEN", None)
    for name in ("a", "a", "a", "b", "b"):
        D._opened(name, [name])
    assert built == [["a"], ["b"]]


def test_odd_rows(odd_docs, no_docs, shipped):
    bench = shipped.createDataFrame([(1, "another text under the same id"), (1, "another text under the same id"), (None, "a text without an id"), (2, None)], "item_id long, text string")
    rows = D.contamination(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((str(r["doc_id"]), r["item_ids"]) for r in rows if r["contaminated"]) == [("7", [1]), ("None", [-1])]
    clean = D.clean(odd_docs, bench)
    assert clean.schema == odd_docs.schema and clean.count() == odd_docs.count() - 2
    none = bench.limit(0)
    assert D.clean(odd_docs, none).count() == odd_docs.count() and not any(r["contaminated"] for r in D.contamination(odd_docs, none).collect())
    assert D.contamination(no_docs, bench).count() == 0
