from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from tianguis.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, best=10):
    """Every kept term for every pair of sources."""
    df, cell, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        cell.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (of, t), n in df.items() if of == lang and n >= least]
        sources = sorted(s for of, s in groups if of == lang)
        total = {s: sum(cell[lang, s, t] for t in kept) for s in sources}
        share = {(s, t): 1 + 10 ** 9 * (cell[lang, s, t] + 2) // (total[s] + 2 * len(kept)) for s in sources for t in kept}
        whole = {t: 1 + 10 ** 9 * (sum(cell[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = [(-sum(f(share[s, t], share[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(share[s, t], whole[t]), t) for t in kept if cell[lang, s, t] and share[s, t] > whole[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:best])]
    return sorted(out)


def some_docs(rng, n, sources=7):
    return [(" ".join(rng.choice("The of déjà vu 漢字 to-and Fro WORD9word".split()) + rng.choice(["", "x", "y" * rng.randint(0, 9)])
                      for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None, "xx"]), f"s{int(sources * rng.random() ** 2)}") for _ in range(n)]


@pytest.mark.parametrize(("block", "cells"), [(1 << 18, 1 << 22), (20, 9), (50, 1)])
def test_equals_brute_force_in_any_blocks(shipped, monkeypatch, block, cells):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", cells)
    docs = some_docs(random.Random(7), 300) + [(None, "en", None), ("", "zz", "alone"), ("rare", "zz", "two")]
    df = shipped.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == brute(docs)


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(500):
        total = rng.randint(3, 9 * 10 ** 15)
        count = rng.randint(0, total - 2)
        assert divergence.shares(np.array([count]), total)[0] == 1 + 10 ** 9 * (count + 2) // total


def test_pieces_keep_words_whole(monkeypatch):
    text = "Aé漢b-c dd9ee  f" * 30
    whole = TERM.findall(text.translate(LOWER))
    for piece in (1, 2, 7, 1000):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [w.decode() for part in divergence._words(text.encode()) for w in part] == whole


def test_odd_rows(odd_docs, no_docs):
    plain = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, divergence.audit(odd_docs, least_docs=2).collect())) == brute(plain, least=2)
    assert divergence.audit(no_docs).collect() == []
