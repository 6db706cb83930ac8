from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tianguis.llm import bpe
from tianguis.llm.queries import tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path())


def awkward_texts():
    rng = random.Random(1)
    ranges = ((9, 14), (28, 128), (0x80, 0x250), (0x300, 0x340), (0x370, 0x400), (0x600, 0x680), (0x2000, 0x2070), (0xAC00, 0xAC20),
              (0x1C80, 0x1C90), (0xA7C0, 0xA7F8), (0x1F600, 0x1F620), (0x10D50, 0x10D80))
    pool = [chr(c) for r in ranges for c in range(*r)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return texts + ["", " ", "aaa", "a" * 5000, "ab" * 400, "<|endoftext|>a<|startoftext|> b", "<|ENDOFTEXT|>", "İΣΑΣ x'S he'll 12", "\x1c\x1d\x85​"]


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_encoder_equals_the_library(with_lexicon):
    texts = awkward_texts()
    lexicon = None
    if with_lexicon:
        raw = sorted({w.encode() for t in texts for w in bpe.words_of(t)})[::2]
        lexicon = bpe.open_lexicon(bpe.Lexicon.compile(dict(zip(raw, bpe.vocabulary(tokenizer_path()).merge(raw)))))
    encoder = bpe.Encoder(tokenizer_path(), lexicon)
    for t, ids in zip(texts, encoder.encode(texts)):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert encoder.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): np.array([k]) for k, w in enumerate(["tap", "taps", "top", "tops", "é", "a"])}
    lexicon = bpe.open_lexicon(bpe.Lexicon.compile(words))
    rank = lexicon.rank([*words, b"", b"ta", b"topsy", b"x" * 100])
    assert sorted(rank[:6]) == list(range(6)) and (rank[6:] == -1).all()
    for w, r in zip(words, rank):
        assert lexicon.ids[lexicon.starts[r]:lexicon.starts[r + 1]].tolist() == words[w].tolist()
    assert len(lexicon.final) == 6  # start; t; ta and to; tap and top; the end of all others; the first byte of é


def test_digests_on_odd_rows(odd_docs, no_docs):
    blob = bpe.build_lexicon(odd_docs, tokenizer_path())
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    want = set()
    for i, t in texts:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = bpe.digests(odd_docs, tokenizer_path(), blob).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == odd_docs.count()
    assert bpe.digests(no_docs, tokenizer_path(), bpe.build_lexicon(no_docs, tokenizer_path())).count() == 0


def test_heavy_words_cover_all_texts(shipped):
    rows = [(k, "common " * 50 + f"rare{k}") for k in range(200)]
    counts = {r["word"]: r["n"] for r in bpe.word_counts(shipped.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert counts["common"] == 200 * 50
