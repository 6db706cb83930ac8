from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers

from tianguis.llm import order

END, RANKS = 50_256, public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_permutation_and_inverse():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        slot = order.slots(np.arange(n), n, "key")
        assert sorted(slot.tolist()) == list(range(n)) and (order.numbers_of(slot, n, "key") == np.arange(n)).all()
    a, b = (order.slots(np.arange(1000), 1000, k) for k in ("x", "y"))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_shards_hold_every_sequence_once(odd_docs, no_docs):
    odd_docs = odd_docs.repartition(3)
    written = order.shards(odd_docs, RANKS, END, shard_slots=16)
    rows = written.orderBy("shard").collect()
    records = np.frombuffer(b"".join(r["records"] for r in rows), dtype=order.RECORD)
    assert [r["first_slot"] for r in rows] == [16 * k for k in range(len(rows))] and all(r["n"] == 16 for r in rows[:-1])
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.append(order.encoded(RANKS, [r["text"]])[0], END).astype(int)
        for k in range(0, len(ids), order.LENGTH):
            want.append((r["doc_id"] or 0, r["doc_id"] is None, k // order.LENGTH, ids[k:k + order.LENGTH].tolist()))
    got = [(int(x["doc_id"]), bool(x["flags"] & 1), int(x["part"]), x["ids"][:x["n_tokens"]].tolist()) for x in records]
    assert sorted(got) == sorted(want)
    some = order.read_slots(written, 10, 40, 16).orderBy("slot").collect()
    assert [r["slot"] for r in some] == list(range(10, 40))
    assert b"".join(r["record"] for r in some) == records[10:40].tobytes()
    listed = order.manifest(written).orderBy("slot").collect()
    assert [r["slot"] for r in listed] == list(range(len(records)))
    assert all(r["byte_offset"] == (r["slot"] % 16) * order.STRIDE for r in listed)
    assert order.shards(no_docs, RANKS, END).count() == 0


def test_packed_records_come_back():
    own = pd.DataFrame({"doc_id": ["5", None, "-7"]})
    out = order.records(own, [[1, 2, 3], [], list(range(600))], END)
    assert (order.unpacked(order.packed(out), len(out)) == out).all() and len(out) == 5


def test_split_and_repeated_second_passes_give_the_same_shards(shipped):
    docs = shipped.createDataFrame([(i, f"text {i} " * (i % 90)) for i in range(400)], "doc_id long, text string").repartition(5)
    written = order.sequences(docs, RANKS, END)
    rows = [sorted(map(tuple, order.dealt(w, "k", 32).collect())) for w in (written, written.repartition(7), written.coalesce(1))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 10
