from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from tianguis.llm import quality as Q


def plain_model(sequences):
    """Interpolated modified Kneser-Ney over symbol tuples, with dictionaries."""
    levels = [Counter()]
    for seq in sequences:
        padded = [0] * (Q.ORDER - 1) + seq
        for k in range(Q.ORDER - 1, len(padded)):
            levels[0][tuple(padded[k - Q.ORDER + 1:k + 1])] += 1
    for _ in range(Q.ORDER - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    tables = []
    for level in levels:
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [0.0]
        for k in (1, 2, 3):
            d.append(max(0.05, min(k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and n[k + 1] else 0.5 * k)
        by = defaultdict(dict)
        for g, c in level.items():
            by[g[:-1]][g[-1]] = c
        tables.append((d, by))

    def p(gram):
        if not gram:
            return 1 / Q.SYMBOLS
        d, by = tables[Q.ORDER - len(gram)]
        seen, below = by.get(gram[:-1]), p(gram[1:])
        if not seen:
            return below
        total = sum(seen.values())
        c = seen.get(gram[-1], 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in seen.values()) / total * below
    return p


def plain_symbols(text):
    """The text's symbols and its closing boundary, without vectors."""
    out, last, word, gap = [], None, b"", []
    raw = (text or "").encode() + b"\n"

    def close():
        nonlocal last, word, gap
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        if word:
            if low == last:
                out.append(Q.REPEAT)
            else:
                out.extend(int(Q.TABLE[c]) for c in [*gap, *word])
            last, gap, word = low, [], b""
    for c in raw:
        if c in b" \t\n\x0b\x0c\r":
            close()
            gap.append(c)
        else:
            word += bytes([c])
    out.extend(int(Q.TABLE[c]) for c in gap[:-1])
    return [*out, Q.BOUNDARY]


def counted(spark, codes):
    return spark.createDataFrame([(int(c), int(n)) for c, n in codes], "code long, n long")


def tables_model(model):
    """Probability of an n-gram code from the model's tables, by their definition."""
    seen, free = {}, {}
    for m, level in model.items():
        for r in level.collect():
            seen[m, r["code"]] = r["p"]
            assert free.setdefault((m, r["code"] >> Q.BITS), r["b"]) == r["b"]

    def p(code, m=Q.ORDER):
        if m == 0:
            return 1 / Q.SYMBOLS
        return seen[m, code] if (m, code) in seen else free.get((m, code >> Q.BITS), 1.0) * p(code & ((1 << Q.BITS * (m - 1)) - 1), m - 1)
    return p


def test_symbols_and_probabilities_equal_the_plain_model(shipped):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "The", "of", "end.", "x1", "né", "on|", "abc!!"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    seqs = [plain_symbols(t) for t in texts]
    doc, code = Q.grams(texts)
    for k, seq in enumerate(seqs):
        assert (code[doc == k] & 63).tolist() == seq, texts[k]
    p, own = plain_model(seqs), tables_model(Q.kneser_ney(counted(shipped, Counter(code.tolist()).items())))
    for c in rng.sample(code.tolist(), 60) + [rng.randrange(Q.SYMBOLS ** Q.ORDER) for _ in range(60)]:
        gram = tuple((c >> 6 * k) & 63 for k in range(Q.ORDER - 1, -1, -1))
        assert abs(own(c) - p(gram)) < 1e-12
    for context in [c >> 6 for c in rng.sample(code.tolist(), 20)] + [rng.randrange(Q.SYMBOLS ** 3) for _ in range(20)]:
        assert abs(sum(own(context << 6 | w) for w in range(Q.SYMBOLS)) - 1) < 1e-9


def test_counts_beyond_32_bits_keep_their_shares(shipped):
    rng = np.random.default_rng(5)
    few = {int(c): int(n) for c, n in zip(rng.integers(0, Q.SYMBOLS ** Q.ORDER, 5000), rng.integers(5, 200, 5000))}
    own = tables_model(Q.kneser_ney(counted(shipped, ((c, n << 33) for c, n in few.items()))))
    totals = Counter()
    for c, n in few.items():
        totals[c >> 6] += n
    # without small counts both discount by fixed steps, which vanish beside large counts
    assert max(abs(own(c) - n / totals[c >> 6]) for c, n in few.items()) < 1e-5


def test_blocks_and_shards_do_not_matter(shipped, monkeypatch):
    """Every document's log-probability is the plain model's, also where each slice is a block of its own
    and where no n-gram, or none of the highest order, is known."""
    docs, labels, _ = make_docs(shipped)
    strange = shipped.createDataFrame([(6000, "ÀÀ~~ ÿÿ^^ ~À^ÿ" * 5, "xx"), (6001, "", "xx"), (6002, None, None)], docs.schema)
    docs = docs.unionByName(strange).repartition(7, "doc_id")
    whole = {r["doc_id"]: r["log_perplexity"] for r in Q.classified(docs, labels).collect()}
    monkeypatch.setattr(Q, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(Q, "CHUNK", 50)
    assert whole == {r["doc_id"]: r["log_perplexity"] for r in Q.classified(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    p = plain_model([plain_symbols(texts[k]) for k in range(0, 400, 2)])
    for k in (1, 7, 399, 1000, 1012, 1024, 6000, 6001, 6002):
        seq = [0] * (Q.ORDER - 1) + plain_symbols(texts[k])
        logs = [math.log(p(tuple(seq[j - Q.ORDER + 1:j + 1]))) for j in range(Q.ORDER - 1, len(seq))]
        assert abs(whole[k] + sum(logs) / len(logs)) < 1e-5
    none = Q.classified(docs, labels.limit(0)).collect()
    assert all(abs(r["log_perplexity"] - math.log(Q.SYMBOLS)) < 1e-5 for r in none)


def test_the_plan_joins_shards(shipped):
    """Packed counts meet the model by an exchange on (shard, block); nothing is broadcast there."""
    docs, labels, _ = make_docs(shipped)
    level = Q.kneser_ney(Q.trusted_counts(docs, labels))[Q.ORDER]
    plan = Q.met(Q.packed_counts(docs, 4), level, Q.ORDER, 4)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan
    assert len([x for x in plan.splitlines() if "hashpartitioning(shard" in x and "block" in x]) == 2


def test_thresholds_name_their_source(shipped, monkeypatch):
    docs, labels, _ = make_docs(shipped)
    monkeypatch.setattr(Q, "LEAST", 200)
    other = shipped.createDataFrame([(5000, "une autre langue", "fr"), (5001, None, None)], docs.schema)
    rows = Q.classified(docs.unionByName(other), labels).collect()
    assert all(r["threshold_of"] == ("language" if r["lang"] == "en" else "all") and r["threshold"] is not None for r in rows)
    assert {r["threshold_of"] for r in Q.classified(docs, labels.limit(0)).collect()} == {None}


def test_packing_returns_every_count():
    doc, code = Q.grams(["some text here", "", None, "more more more text", "é"])
    n, total = 5, Counter(zip(doc.tolist(), code.tolist()))
    back = Counter()
    for _, blob in Q.pack(doc, code, n):
        for d, c, m in zip(*Q.unpack(blob)):
            back[(d, c)] += m
    assert back == total


def make_docs(shipped):
    rng = random.Random(8)
    syllables = ["an", "er", "on", "re", "th", "in", "ti", "es", "or", "al"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."
    good = [(k, prose(rng.randint(2, 120)), "en") for k in range(400)]
    junk = [(1000 + k, " ".join(f"{w.upper()}!!" for w in prose(40).split()), "en") for k in range(10)]
    junk += [(1010 + k, "$$$ ".join(prose(40).split()), "en") for k in range(10)] + [(1020 + k, " ".join(["word"] * 90), "en") for k in range(5)]
    docs = shipped.createDataFrame(good + junk, "doc_id long, text string, lang string")
    return docs, shipped.createDataFrame([(k, 1) for k in range(0, 400, 2)], "doc_id long, quality int"), {x[0] for x in junk}


def test_junk_goes_and_clean_text_stays(shipped):
    docs, labels, junk = make_docs(shipped)
    rows = Q.classified(docs, labels).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == junk
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    trusted = [texts[k] for k in range(0, 400, 2)]
    p = tables_model(Q.kneser_ney(counted(shipped, Counter(Q.grams(trusted)[1].tolist()).items())))
    for r in rows[::20]:
        own = Q.grams([texts[r["doc_id"]]])[1].tolist()
        assert abs(-sum(math.log(p(c)) for c in own) / len(own) - r["log_perplexity"]) < 1e-4 and r["n"] == len(own)
    assert {r["doc_id"] for r in Q.accepted(docs, labels).collect()} == set(texts) - junk


def test_odd_rows(odd_docs, no_docs, labels):
    rows = Q.classified(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] for r in rows if r["doc_id"] in (1, 2))
    out = Q.accepted(odd_docs, labels)
    assert out.schema == odd_docs.schema
    assert Q.accepted(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert Q.classified(no_docs, labels).count() == 0 and Q.accepted(no_docs, labels.limit(0)).count() == 0


def byte_texts():
    rng = random.Random(9)
    words = ["the", "The", "THE", "of", "end.", "x1", "x2", "né", "nè", "漢字", "漢語", "\x00\x03", "a\tb", "q;", "q:"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]


def byte_symbols(texts, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(Q, "TABLE", Q.BYTES.table)
        return [plain_symbols(t) for t in texts]


def test_every_byte_is_a_symbol_of_its_own():
    """Texts that differ in one byte have different n-grams: no byte is folded into another."""
    texts = [f"ab{chr(c)}cd" for c in range(128)] + [f"ab{c}cd" for c in "éèñßÀÿ漢字語人Жя"]
    doc, code = Q.grams(texts, Q.BYTES)
    assert len({tuple(code[doc == k].tolist()) for k in range(len(texts))}) == len(texts)
    used = {b for c in range(0x110000) if c % 97 == 0 or c < 0x900 for b in chr(c).encode("utf-8", "surrogatepass")}
    assert not used & {254, 255} and len(set(Q.BYTES.table.tolist())) == 254 and Q.BYTES.symbols == 256


def test_the_byte_model_equals_the_plain_one_however_it_is_dealt(shipped, monkeypatch):
    texts = byte_texts()
    docs = shipped.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = shipped.createDataFrame([(k, 1) for k in range(0, 60, 2)], "doc_id long, quality int")
    seqs = byte_symbols(texts, monkeypatch)
    doc, code = Q.grams(texts, Q.BYTES)
    for k, seq in enumerate(seqs):
        assert (code[doc == k] & 255).tolist() == seq, texts[k]
    monkeypatch.setattr(Q, "LEAST", 10)
    whole = {r["doc_id"]: r["log_perplexity"] for r in Q.classified(docs, labels, Q.BYTES).collect()}
    with monkeypatch.context() as m:
        m.setattr(Q, "SYMBOLS", 256)
        p = plain_model(seqs[:60:2])
        for k in (0, 1, 7, 30, 59, 60, 61):
            seq = [0] * (Q.ORDER - 1) + seqs[k]
            logs = [math.log(p(tuple(seq[j - Q.ORDER + 1:j + 1]))) for j in range(Q.ORDER - 1, len(seq))]
            assert abs(whole[k] + sum(logs) / len(logs)) < 1e-5
    # more shards where the model is large, more blocks where the text is
    assert Q.dealt(0, 0) == (Q.SHARDS, 1) and Q.dealt(0, 5 * Q.SHARDS * Q.SHARD_GRAMS)[0] == 8 * Q.SHARDS
    monkeypatch.setattr(Q, "SHARD_GRAMS", 10)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 3000)
    assert Q.dealt(3000, Q.trusted_counts(docs, labels, Q.BYTES).count())[0] >= 4 * Q.SHARDS
    assert whole == {r["doc_id"]: r["log_perplexity"] for r in Q.classified(docs, labels, Q.BYTES).collect()}


def test_the_registered_query_sees_all_bytes(shipped, tmp_path):
    """Documents that differ in capitals, digits or bytes beyond ASCII only, which FOLDED scores alike."""
    from tianguis.llm import queries

    texts = ["year 1811 was", "year 7392 was", "seen ABBA now", "seen QXZW now", "caf\u00e9s", "caf\u00f9s"]
    docs = shipped.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = shipped.createDataFrame([(k, 1) for k in (0, 2, 4)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    x = {r["doc_id"]: r["log_perplexity"] for r in queries.op1_quality(shipped, str(tmp_path)).collect()}
    assert x[0] < x[1] and x[2] < x[3] and x[4] < x[5]
