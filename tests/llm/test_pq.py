from __future__ import annotations

import numpy as np
import pytest

from tianguis.llm import pq


def brute(vectors, cosine=0.95):
    """(links, component) per row; rows with a bad vector stand alone."""
    ok = {}
    for k, v in vectors.items():
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float32).astype(np.float64)
    links = {k: set() for k in vectors}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= cosine:
                links[a].add(b)
    out = {}
    for k in vectors:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[k] = (len(links[k]), min(seen))
    return out


@pytest.mark.parametrize("block", [pq.BLOCK, 24])
def test_links_and_components_equal_brute_force(shipped, monkeypatch, block):
    """A third of the rows are one vector, a dense group lies around it, pairs lie at the threshold."""
    monkeypatch.setattr(pq, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((260, 24))
    rows = [*base, *[base[0]] * 150]
    rows += [base[0] + 0.2 * rng.standard_normal(24) for _ in range(60)] + [base[k] + 0.33 * rng.standard_normal(24) for k in range(1, 61)]
    vectors = {3 * k: [float(np.float32(x)) for x in v] for k, v in enumerate(rows)}
    vectors |= {5001: None, 5002: [], 5003: [0.0] * 24, 5004: [1.0] * 23 + [None], 5005: [float("nan")] * 24, 5006: [float("inf")] + [1.0] * 23,
                5007: [1.0, 2.0], 5008: [2.0, 4.0], 5009: [-1.0, -2.0], 5010: [0.0, -0.0], 5011: [-0.0] + vectors[0][1:]}
    table = shipped.createDataFrame([(k, v, 1, 2, 3) for k, v in vectors.items()], "vec_id long, embedding array<float>, label int, w int, root int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.near_duplicates(table).collect()}
    want = brute(vectors)
    found, real = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.99 * real
    assert got == want


def test_bound_never_drops_a_neighbour():
    rng = np.random.default_rng(5)
    x = pq.unit(rng.standard_normal((500, 32)))
    quant = pq.Quantiser(x, 500)
    probes = quant.lists(x)
    centre = quant.centre(probes[:, 0])
    codes, error = quant.code(x - centre)
    for j in range(0, 500, 50):
        near = np.sqrt(quant.table_distances(x - centre[j], codes[j:j + 1])[:, 0])
        real = np.sqrt(((x - x[j]) ** 2).sum(axis=1))
        assert (near - error[j] <= real + 1e-3).all()


@pytest.mark.parametrize("coarse", [8, 64])
def test_recall_with_many_more_lists_than_probes(shipped, monkeypatch, coarse):
    """About 1,500 lists of which 32 are probed: links at and above the threshold against brute force."""
    monkeypatch.setattr(pq, "LIST_SIZE", 2)
    monkeypatch.setattr(pq, "COARSE", coarse)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 64))
    noise = rng.standard_normal((1500, 64)) * rng.choice([0.05, 0.2, 0.32], size=(1500, 1))
    x = np.concatenate([base, base + noise]).astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    quant = pq.Quantiser(u, len(u))
    sizes = np.bincount(quant.lists(u)[:, 0])
    assert len(quant.centres) * len(quant.fine) >= 1400 and sizes.max() < 100
    table = shipped.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in pq.near_duplicates(table).collect())
    print("recall", found / near.sum())
    assert 0.95 * near.sum() <= found <= near.sum()


def test_doubles_stay_doubles(shipped):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-300, 1e-310]), (4, [0.0, 3e200]), (5, [1.0, 1e-9]), (6, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           pq.near_duplicates(shipped.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_empty_table_and_null_ids(shipped):
    table = shipped.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None)], "vec_id long, embedding array<float>")
    rows = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in pq.near_duplicates(table).collect())
    assert rows == [("2", 0, "2", True), ("4", 1, "4", True), ("None", 0, "None", False), ("None", 1, "4", False)]
    assert pq.near_duplicates(table.limit(0)).count() == 0
