"""BPE encoding and decoding through a word lexicon in a minimal acyclic transducer.

1. Word counts: every task summarises the words of all its texts in a bounded
   heavy-hitter summary (Misra-Gries), Spark adds the summaries up.
2. The ``LEXICON_WORDS`` most frequent words are encoded exactly and compiled on the
   driver into a minimal acyclic automaton with shared suffixes. Each arc carries
   the number of words that sort before it, so a path's sum is the word's rank,
   which selects its token ids in one flat array: the transducer's output.
3. The compiled arrays (bounded by LEXICON_WORDS x MAX_WORD_BYTES) travel as one
   broadcast; a task writes them to a file once and memory-maps it.
4. A task splits whole texts into words, finds each distinct word in the automaton
   (all words of a batch step by step together) and merges the others exactly, by
   merge rank, again all together. Which words the lexicon holds never changes a result.

Tokens agree with the public tokenizer file: normalisation (NFC, white space to a
blank, lower case per character), words, byte alphabet, merges and the special
strings in a text. Decoding joins token strings with blanks, as a file without a
decoder asks.

Defined cases: a null or empty text has no ids and decodes to an empty string; a
null doc_id stays null; repeated rows each get a row; an empty table gives an empty
result; other columns are not looked at; a very long text is handled whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEARNT

LEXICON_WORDS = 65_536   # words in the automaton
SUMMARY_WORDS = 20_000   # counters of a task's summary
MAX_WORD_BYTES = 64      # longer words are never in the lexicon
CACHE_WORDS = 300_000    # words a task remembers; it starts anew beyond


def byte_alphabet() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """Tables of one tokenizer file (word BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[str] = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.base = size
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # open addressing: one probe finds nearly every pair
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        home = self._home(self.keys)
        for k, h in enumerate(home.tolist()):
            while self.slots[h] >= 0:
                h = (h + 1) & ((1 << bits) - 1)
            self.slots[h] = k
        self.slot_key = np.where(self.slots >= 0, self.keys[self.slots], -1)
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split_special = re.compile(f"({names})") if names else None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each pair key among the merges, -1 where there is none."""
        h = self._home(keys)
        got = self.slot_key[h]
        out = np.where(got == keys, self.slots[h], -1)
        todo = np.flatnonzero((got != keys) & (got != -1))
        mask = len(self.slots) - 1
        while len(todo):
            h[todo] = (h[todo] + 1) & mask
            got = self.slot_key[h[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.slots[h[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact BPE of each non-empty word: always the pair of lowest rank, all of
        its occurrences from the left. Short words run together as one matrix."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        edges = [0, 4, 8, 12, 16, 24, 32, MAX_WORD_BYTES]
        for lo, hi in zip(edges, edges[1:]):
            rows = np.flatnonzero((sizes > lo) & (sizes <= hi))
            for part in np.array_split(rows, max(1, len(rows) // 20_000 + 1)):
                if len(part):
                    for k, ids in zip(part.tolist(), self._merge_matrix([words[k] for k in part.tolist()], sizes[part], hi)):
                        out[k] = ids
        for k in np.flatnonzero(sizes > MAX_WORD_BYTES).tolist():
            out[k] = self._merge_long(words[k])
        return out

    def _merge_matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
        n, none = len(words), np.int64(1 << 40)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < sizes[:, None] - 1, self.inner[raw], np.where(at == sizes[:, None] - 1, self.last[raw], -1))
        live = np.arange(n)
        length = sizes.copy()
        full = ids
        while len(live):
            ids = full[live]
            both = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
            found = np.full(both.shape, -1, dtype=np.int64)
            found[both] = self.find(ids[:, :-1][both] * self.base + ids[:, 1:][both])
            rank = np.where(found >= 0, self.rank[found], none)
            best = rank.min(axis=1)
            go = best < none
            live = live[go]
            if not len(live):
                break
            ids, rank, found, best = ids[go], rank[go], found[go], best[go]
            hit = rank == best[:, None]
            for c in range(1, hit.shape[1]):  # runs such as aaa: from the left, without overlap
                hit[:, c] &= ~hit[:, c - 1]
            new = self.made[found[np.arange(len(live)), hit.argmax(axis=1)]]
            ids[:, :-1] = np.where(hit, new[:, None], ids[:, :-1])
            gone = np.zeros(ids.shape, dtype=bool)
            gone[:, 1:] = hit
            order = np.argsort(gone | (ids < 0), axis=1, kind="stable")
            ids = np.take_along_axis(np.where(gone, -1, ids), order, axis=1)
            full[live] = ids
            length[live] -= hit.sum(axis=1)
        return [full[k, :m] for k, m in enumerate(length.tolist())]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long word: a heap of pairs by (rank, position) over a linked list."""
        import heapq

        raw = np.frombuffer(word, dtype=np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.find(np.array(ids[:-1], dtype=np.int64) * self.base + np.array(ids[1:], dtype=np.int64)).tolist()
        heap = [(int(self.rank[m]), k, ids[k], ids[k + 1], m) for k, m in enumerate(first) if m >= 0]
        heapq.heapify(heap)

        def push(k: int) -> None:
            if k >= 0 and right[k] >= 0:
                m = int(self.find(np.array([ids[k] * self.base + ids[right[k]]], dtype=np.int64))[0])
                if m >= 0:
                    heapq.heappush(heap, (int(self.rank[m]), k, ids[k], ids[right[k]], m))

        while heap:
            _, k, a, b, m = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r] = int(self.made[m]), -1
            right[k] = right[r]
            if right[r] >= 0:
                left[right[r]] = k
            push(left[k])
            push(k)
        return np.array([x for x in ids if x >= 0], dtype=np.int64)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# The same words in texts of ASCII and of Latin letters (below U+0250), without property lookups;
# no contraction starts with a letter, so letters may be tried first.
ASCII_WORD = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9]+")
_LATIN = "a-zªµºß-öø-ÿĀ-ɏ"
LATIN_WORD = re.compile(rf"[{_LATIN}]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_LATIN}0-9²³¹¼-¾]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
ANY_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Capitals whose lower case the tokenizer knows and this Python's
# tables do not (first, last, distance to the lower-case letter).
NEW_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
                (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
LOWER = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)}


# Letters and numbers that the word pattern's tables may know and the
# tokenizer's (Unicode 16) do not, as ranges of code points.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 "
    "16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f")


@functools.cache
def _newer() -> tuple[re.Pattern, regex.Pattern]:
    """A class of the code points above, and the word pattern that takes LATER as symbols."""
    some = "".join(f"{chr(int(a, 16))}-{chr(int(b or a, 16))}" for a, _, b in (x.partition("-") for x in LATER.split()))
    return re.compile(f"[{some}{''.join(map(chr, LOWER))}]"), regex.compile(
        rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{some}]]+|[\p{{N}}--[{some}]]|(?:[^\s\p{{L}}\p{{N}}]|[{some}])+")


def words_of(text: str) -> list[str]:
    """Words of a text without special strings, normalised."""
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    lower = text.lower()
    if not BEYOND_LATIN.search(lower):
        return LATIN_WORD.findall(lower)
    rare, pattern = _newer()
    if not rare.search(text):
        return ANY_WORD.findall(lower)
    return pattern.findall(text.translate(LOWER).lower())


class Lexicon:
    """Minimal acyclic automaton over byte strings whose arcs sum to a word's rank."""

    MAGIC = b"DAWG"

    @staticmethod
    def compile(words: dict[bytes, np.ndarray]) -> bytes:
        """Sorted insertion: a finished branch is replaced by an equal state already
        registered, so states with equal futures are shared."""
        ordered = sorted(w for w in words if 0 < len(w) <= MAX_WORD_BYTES)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(key, child)

        last = b""
        for w in ordered:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            settle(same)
            state = path[-1][2] if path else 0
            for byte in w[same:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            last = w
        settle(0)
        number, order, stack = {0: 0}, [0], [0]
        while stack:
            for child in arcs[stack.pop()].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
                    stack.append(child)
        below: dict[int, int] = {}

        def count(top: int) -> int:
            todo = [top]
            while todo:
                s = todo[-1]
                missing = [c for c in arcs[s].values() if c not in below]
                if missing:
                    todo.extend(missing)
                else:
                    below[s] = final[s] + sum(below[c] for c in arcs[s].values())
                    todo.pop()
            return below[top]

        count(0)
        keys, targets, before = [], [], []
        for s in order:
            total = int(final[s])
            for byte, child in sorted(arcs[s].items()):
                keys.append(number[s] * 256 + byte)
                targets.append(number[child])
                before.append(total)
                total += below[child]
        at = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        ids = [np.asarray(words[w], dtype=np.int32) for w in ordered]
        parts = [
            np.array(keys, dtype=np.int64)[at], np.array(targets, dtype=np.int64)[at], np.array(before, dtype=np.int64)[at],
            np.array([final[s] for s in order], dtype=np.int64),
            np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
            np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int64)]
        return Lexicon.MAGIC + struct.pack("<6q", *map(len, parts)) + b"\0" * 4 + b"".join(p.tobytes() for p in parts)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            sizes = struct.unpack("<6q", f.read(52)[4:])
        flat = np.memmap(path, dtype=np.int64, mode="r", offset=56)
        cut = np.cumsum(sizes)[:-1]
        self.keys, self.targets, self.before, self.final, self.starts, self.ids = np.split(flat, cut)

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the lexicon, -1 where it is not in it."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        rows = np.flatnonzero(sizes <= MAX_WORD_BYTES)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, total, step = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(rows):
            done = sizes[rows] == step
            ended = rows[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = total[ended]
            rows = rows[~done]
            key = state[rows] * 256 + flat[start[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            rows, at = rows[ok], at[ok]
            state[rows] = self.targets[at]
            total[rows] += self.before[at]
            step += 1
        return out


@functools.cache
def _mapped(digest: str, size: int):
    """The lexicon of this worker: written to its own temporary file, memory-mapped."""
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{digest}-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        f.write(_BLOB[digest])
    _BLOB.clear()
    lexicon = Lexicon(path)
    os.unlink(path)  # the mapping keeps it alive
    return lexicon


_BLOB: dict[str, bytes] = {}


def open_lexicon(blob: bytes | None) -> Lexicon | None:
    if blob is None:
        return None
    digest = hashlib.sha256(blob).hexdigest()
    _BLOB[digest] = blob
    return _mapped(digest, len(blob))


class Encoder:
    """Encodes texts of one tokenizer file; remembers words between calls."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.vocab = vocabulary(path)
        self.lexicon = lexicon
        self._forget()

    @staticmethod
    def shared(path: str, lexicon: bytes | None = None) -> Encoder:
        """The encoder of this worker: what it has learnt serves its later tasks, too."""
        key = (path, hashlib.sha256(lexicon or b"").hexdigest())
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(path, open_lexicon(lexicon))
        return _ENCODERS[key]

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        for s, i in self.vocab.special.items():
            self.seen[s] = len(self.start) - 1  # a word never equals a special string
            self._add([np.array([i])])

    def _add(self, ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, *ids])

    def _learn(self, missing: list[str]) -> None:
        raw = [w.encode("utf-8") for w in missing]
        rank = self.lexicon.rank(raw) if self.lexicon else np.full(len(raw), -1)
        ids: list[np.ndarray | None] = [None] * len(raw)
        if self.lexicon:
            known = np.flatnonzero(rank >= 0)
            for k, a, b in zip(known.tolist(), self.lexicon.starts[rank[known]].tolist(), self.lexicon.starts[rank[known] + 1].tolist()):
                ids[k] = self.lexicon.ids[a:b]
        rest = np.flatnonzero(rank < 0).tolist()
        for k, x in zip(rest, self.vocab.merge([raw[k] for k in rest])):
            ids[k] = x
        first = len(self.start) - 1
        self.seen.update(zip(missing, range(first, first + len(missing))))
        self._add(ids)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text or self.vocab.split_special is None:
            return words_of(text)
        out = []
        for part in self.vocab.split_special.split(text):
            out += [part] if part in self.vocab.special else words_of(part)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > CACHE_WORDS:
            self._forget()
        split = [self.words(t) for t in texts]
        missing = [w for w in set().union(*split) if w not in self.seen]
        if missing:
            self._learn(sorted(missing))
        out, get = [], self.seen.__getitem__
        for words in split:
            at = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
            a = self.start[at]
            n = self.start[at + 1] - a
            ends = np.cumsum(n)
            if len(at):
                where = np.repeat(a - ends + n, n) + np.arange(ends[-1])
                out.append(self.flat[where])
            else:
                out.append(np.zeros(0, np.int64))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.vocab.strings.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
LEARNT.append(_ENCODERS)


def slices(texts: list, chars: int = 4_000_000) -> Iterator[list]:
    """Runs of a batch of about so many characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) if isinstance(t, str) else 0
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the heavy words of all whole texts. A task keeps SUMMARY_WORDS
    counters over everything it reads (Misra-Gries: every word that makes up more
    than 1 / SUMMARY_WORDS of a task's words is kept, counts are lower bounds)."""
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch["text"].tolist()):
                for t in part:
                    if isinstance(t, str):
                        counts.update(words_of(t))
                if len(counts) > 4 * SUMMARY_WORDS:
                    floor = sorted(counts.values(), reverse=True)[SUMMARY_WORDS]
                    counts = Counter({w: c - floor for w, c in counts.items() if c > floor})
        top = [(w, c) for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY_WORDS] if len(w.encode()) <= MAX_WORD_BYTES]
        yield pd.DataFrame(top, columns=["word", "n"])
    return docs.select("text").mapInPandas(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """Compiled lexicon of the ``size`` most frequent words."""
    rows = word_counts(docs).orderBy(F.desc("n"), "word").limit(size).collect()  # bounded by size
    raw = [r["word"].encode("utf-8") for r in rows]
    return Lexicon.compile(dict(zip(raw, vocabulary(path).merge(raw))))


def encoded(docs: DataFrame, path: str, lexicon: bytes | None) -> DataFrame:
    """One row per document: doc_id, ids (array of int), decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.shared(path, shared.value)
        for batch in batches:
            at = 0
            for part in slices(batch["text"].tolist()):
                ids = encoder.encode(part)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:at + len(part)].tolist(), "ids": [x.astype(np.int32) for x in ids], "decoded": [encoder.decode(x) for x in ids]})
                at += len(part)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, ids array<int>, decoded string").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def digests(docs: DataFrame, path: str, lexicon: bytes | None) -> DataFrame:
    """One row per document: number of ids and digests of the ids and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.shared(path, shared.value)
        for batch in batches:
            at = 0
            for part in slices(batch["text"].tolist()):
                ids = encoder.encode(part)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at:at + len(part)].tolist(), "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode("utf-8")).hexdigest() for x in ids]})
                at += len(part)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
