from __future__ import annotations

import hashlib
import random
import re

from tianguis.llm import pii

GRAMMAR = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1]))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, r in GRAMMAR.items() for m in r.finditer(text) if valid(k, m.group())]


def test_base_spans_equal_the_grammars():
    rng = random.Random(5)
    for _ in range(40_000):
        t = "".join(rng.choice("0123456789.@+- ()ab%_é\n") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find_spans(t) if s[0] in GRAMMAR] == brute(t), t


def test_added_kinds_and_marks():
    t = 'see https://a.example/x?y=1. token = "1eb9c654e721b4f812088970e66a6345" IBAN: GB82 WEST 1234 5698 7654 32, b@c.de'
    assert [s[0] for s in pii.find_spans(t)] == ["email", "iban", "secret", "url"]
    assert pii.redact(t, pii.find_spans(t)) == 'see <URL>. token = "<SECRET>" IBAN: <IBAN>, <EMAIL>'
    assert pii.find_spans("GB82 WEST 1234") == [] and pii.redact("plain", []) == "plain"


def test_report_on_odd_rows(odd_docs, no_docs):
    rows = pii.report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and pii.report(no_docs).collect() == []
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert (nine["n_email"], nine["n_ip"], nine["n_card"], nine["n_phone"]) == (1, 1, 0, 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in rows if r["doc_id"] in (1, 2, 3))


def test_redacted_keeps_rows_and_columns(odd_docs, no_docs):
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns and out.schema == odd_docs.schema and out.count() == odd_docs.count()
    nine = out.where("doc_id = 9").first()
    assert nine["text"] == "<|endoftext|> x <IP> <EMAIL> <PHONE>" and nine["n_chars"] == len(nine["text"])
    assert out.where("doc_id = 1").first()["text"] is None and pii.redacted(no_docs).count() == 0
