from __future__ import annotations

import random
import zlib

import numpy as np

from tianguis.llm import toxicity as X


def test_gradients_are_slopes():
    net = X.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    gates, mask = rng.standard_normal((5, 3, 2, 3 * X.HIDDEN)), np.ones((5, 3))
    mask[3:, 1] = 0
    weight = np.array([1.0, -2.0, 0.5])
    loss = lambda: float((net.forward(gates, mask) * weight).sum())
    _, cache = net.forward(gates, mask, keep=True)
    g, d_gates = net.backward(gates, mask, cache, weight)
    for name in ("u", "a", "v", "o", "c"):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            net.p[name][at] += 1e-4
            up = loss()
            net.p[name][at] -= 2e-4
            down = loss()
            net.p[name][at] += 1e-4
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3
    at = (2, 1, 1, 5)
    gates[at] += 1e-4
    up = loss()
    gates[at] -= 2e-4
    assert abs((up - loss()) / 2e-4 - d_gates[at]) < 1e-3


def test_windows_overlap_and_cover_all_words():
    for n in range(0, 200):
        spans = X.windows(n)
        assert {k for a, b in spans for k in range(a, b)} == set(range(n))
        rows = np.arange(n)
        word, mask, _ = X.window_rows([rows])
        assert [(int(w[0]), int(m.sum())) for w, m in zip(word, mask)] == [(a, b - a) for a, b in spans]


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "re", "th", "in", "ti", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, toxic = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(5, 150))]
        bad = k % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilezor", "gruntak", "vilezan" + word(), "vilez" + word()])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy_and_unseen_forms(shipped):
    texts, toxic = corpus(1, 900)
    docs = shipped.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = shipped.createDataFrame([(k, y) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    rows = X.scored(docs, labels).collect()
    assert len(rows) == 900 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_score_is_that_of_the_highest_window():
    texts, toxic = corpus(2, 300)
    net = X.train(texts, np.array(toxic))
    long = " ".join(texts[1:4])
    whole = X.Scorer(net)([long])[0]
    words = X.words_of(long)
    parts = [X.Scorer(net)([" ".join(words[a:b])])[0] for a, b in X.windows(len(words))]
    assert abs(whole - max(parts)) < 1e-5


def test_pieces_cover_a_long_run():
    rng = random.Random(4)
    for n in (1, 63, 64, 65, 95, 96, 97, 128, 129, 1000):
        run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        found = X.words_of(f"one {run} two")
        assert found[0] == "one" and found[-1] == "two" and all(len(p) <= X.PIECE for p in found)
        assert n > X.PIECE or found[1:-1] == [run]
        assert all(any(run[a:a + 32] in p for p in found[1:-1]) for a in range(max(1, n - 31)))


def test_a_passage_deep_in_text_without_blanks_raises_the_score(monkeypatch):
    texts, toxic = corpus(5, 600)
    scorer = X.Scorer(X.train(texts, np.array(toxic)))
    glued = ["".join(t.split()) for t, y in zip(texts, toxic) if not y]
    glued = [g for g in glued if len(g) > 400][:30]
    deep = [g[:300] + "vilezor" + g[300:] for g in glued]
    high = scorer(deep)
    assert np.mean(high > scorer(glued)) > 0.9 and high.min() > 0.7
    # words taken up in small parts score the same
    monkeypatch.setattr(X, "PART", 7)
    assert np.allclose(X.Scorer(scorer.net)(deep), high, atol=1e-5)


def test_long_runs_count_by_pieces_in_the_sample(shipped):
    docs = shipped.createDataFrame([(1, "ab" * 100), (2, "ab" * 40_000), (3, "a b c")], "doc_id long, text string")
    labels = shipped.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert sorted(X.training_sample(docs, labels)["text"].str.len()) == [n for n, k in ((5, 3), (200, 1)) if zlib.crc32(str(k).encode()) % 5]


def test_odd_rows(odd_docs, no_docs, labels):
    rows = X.scored(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1 and all(r["predicted"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["score"] for r in X.scored(odd_docs, labels.limit(0)).collect()} == {X.Network().base}
    assert X.scored(no_docs, labels).count() == 0
