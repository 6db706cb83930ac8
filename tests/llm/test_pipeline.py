from __future__ import annotations

import os
import re

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tianguis.llm import bpe, decontaminate, pii, queries

SF = "/root/testdata/sf0.001"


def test_stages_on_driver_rows(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [decontaminate.canonical(r["text"]) for r in shipped.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(shipped, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > counts[0] * 0.6
    assert set(kept) <= set(before) and not any(i in decontaminate.canonical(t) for t in kept.values() for i in items)
    assert all(t == pii.redact(before[k], pii.find_spans(before[k])) for k, t in kept.items())
    last = corpus_pipeline.STAGES[-1][1](shipped, docs, SF).collect()
    encoder = bpe.Encoder(queries.tokenizer_path())
    assert {r["doc_id"]: r["ids"] for r in last} == {k: encoder.encode([t])[0].tolist() for k, t in kept.items()}


def test_near_duplicate_stage_equals_brute_force(shipped):
    """One row of each component of all pairs with enough 5-word shingles in common."""
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 17 = 3"))  # rows that occur twice
    rows = docs.collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r["doc_id"])
    out = corpus_pipeline.STAGES[1][1](shipped, docs, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(min(g) for g in groups.values()) and len(groups) < len(rows)


def test_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in queries.QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(shipped, odd_docs, labels, tmp_path, empty):
    rows = odd_docs.limit(0) if empty else odd_docs
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), os.path.join(tmp_path, "benchmark.parquet"))
    out = corpus_pipeline.run(shipped, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert out.count() == 0 if empty else 5 <= out.count() <= odd_docs.count() - 2
