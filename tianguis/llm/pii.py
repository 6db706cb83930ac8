"""Personal data by anchor expansion.

An Aho-Corasick automaton over a short list of anchors (the at-sign, the plus
sign, digits, URL schemes and identifier cues) walks each whole text once. Each
anchor hands over to a small deterministic parser that expands left and right to
the boundaries of its kind and validates the span. No regular expression runs
over a text; work is linear in it.

Base kinds (email, ip, card, phone) yield the leftmost, non-overlapping spans of
their grammars; a span that fails its validation is dropped and not retried.
The method's own kinds come on top: ``url`` (scheme to the last URL character),
``iban`` (country code, check digits modulo 97) and ``secret`` (the value after
a cue such as ``token =``). Kinds may overlap each other; spans of one kind never do.

Defined cases: a null text is an empty one and has no spans; a null doc_id stays
null; repeated rows each get their own row; an empty table gives an empty result;
other columns are not looked at. Text length is bounded only by memory for one text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "secret", "url")
KINDS = BASE_KINDS + MORE_KINDS

# Character classes of the span grammars.
DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^[]")
SECRET = ALNUM | frozenset("_-+/=.~")
# Identifier cues (each also in capitals and with a first capital).
SECRET_CUES = ("api_key", "apikey", "access_key", "password", "passwd", "secret", "token")
IBAN_CUES = ("iban",)
SCHEMES = ("http://", "https://", "ftp://")


@functools.cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in "0123456789":
        automaton.add_word(c, ("d", 1))
    automaton.add_word("@", ("@", 1))
    automaton.add_word("+", ("+", 1))
    for kind, words in (("url", SCHEMES), ("secret", SECRET_CUES), ("iban", IBAN_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def _digit_run(t: str, i: int, n: int) -> int:
    while i < n and t[i] in DIGITS:
        i += 1
    return i


def parse_email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand around the at-sign; ``floor`` is the end of the previous e-mail."""
    s = at
    while s > floor and t[s - 1] in LOCAL:
        s -= 1
    if s == at:
        return None
    n, i, dots = len(t), at + 1, 0
    while i < n and t[i] in LABEL:
        i += 1
    if i == at + 1:
        return None
    while i + 1 < n and t[i] == "." and t[i + 1] in LABEL:
        i += 1
        while i < n and t[i] in LABEL:
            i += 1
        dots += 1
    return (s, i) if dots else None


def parse_ip(t: str, s: int) -> tuple[int, bool, int]:
    """From the first digit of a run: (end, is an address, where to look next)."""
    n, i, ok, skip = len(t), _digit_run(t, s, len(t)), True, 0
    ok = int(t[s:i]) <= 255 if i - s < 20 else not t[s:i - 3].strip("0") and int(t[i - 3:i]) <= 255
    skip = i
    for _ in range(3):
        if i + 1 >= n or t[i] != "." or t[i + 1] not in DIGITS:
            return i, False, skip
        j = _digit_run(t, i + 1, n)
        part = t[i + 1:j]
        ok = ok and (int(part) <= 255 if len(part) < 20 else not part[:-3].strip("0") and int(part[-3:]) <= 255)
        i = j
    return i, ok, i


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def parse_card(t: str, s: int) -> tuple[int, bool]:
    """From a digit: the longest chain of digits with single blanks or hyphens between."""
    n, i, digits = len(t), s, []
    while True:
        j = _digit_run(t, i, n)
        digits.append(t[i:j])
        i = j
        if i + 1 < n and t[i] in " -" and t[i + 1] in DIGITS:
            i += 1
        else:
            break
    count = sum(map(len, digits))
    return i, 13 <= count <= 19 and luhn("".join(digits))


def parse_phone(t: str, plus: int) -> tuple[int, bool] | None:
    n, i = len(t), plus + 1
    if i >= n or t[i] not in DIGITS:
        return None
    i += 1
    while i < n and t[i] in PHONE:
        i += 1
    while i > plus + 2 and t[i - 1] not in DIGITS:
        i -= 1
    if i - plus < 4:  # plus, digit, something, digit
        return None
    return i, 9 <= sum(c in DIGITS for c in t[plus:i]) <= 15


def parse_url(t: str, s: int, host: int) -> tuple[int, int] | None:
    n, i = len(t), host
    while i < n and t[i] not in URL_STOP and ord(t[i]) > 32:
        i += 1
    while i > host and t[i - 1] in ".,;:!?)*":
        i -= 1
    return (s, i) if i > host else None


def parse_secret(t: str, i: int) -> tuple[int, int] | None:
    """After a cue: ``=`` or ``:``, maybe quoted, then at least 16 key characters
    with a digit among them."""
    n = len(t)
    while i < n and t[i] in " \t\"'":
        i += 1
    if i >= n or t[i] not in "=:":
        return None
    i += 1
    while i < n and t[i] in " \t\"'":
        i += 1
    j = i
    while j < n and t[j] in SECRET:
        j += 1
    while j > i and t[j - 1] in ".=":
        j -= 1
    return (i, j) if j - i >= 16 and not DIGITS.isdisjoint(t[i:j]) else None


def parse_iban(t: str, i: int) -> tuple[int, int] | None:
    """After the cue: two capitals, two check digits, 11 to 30 more, modulo 97 = 1."""
    n = len(t)
    while i < n and t[i] in " \t:=#.":
        i += 1
    if i + 4 > n or t[i] not in UPPER or t[i + 1] not in UPPER or t[i + 2] not in DIGITS or t[i + 3] not in DIGITS:
        return None
    chars, j, ends = [], i, {}
    while j < n and len(chars) < 34:
        if t[j] in DIGITS or t[j] in UPPER:
            chars.append(t[j])
            j += 1
            ends[len(chars)] = j
        elif t[j] == " " and j + 1 < n and (t[j + 1] in DIGITS or t[j + 1] in UPPER):
            j += 1
        else:
            break
    for k in range(len(chars), 14, -1):
        turned = "".join(chars[4:k] + chars[:4])
        if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
            return i, ends[k]
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one whole text, in code points, by kind, then start."""
    t = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    next_ip = next_card = next_phone = next_url = next_secret = next_iban = mail_floor = 0
    for end, (kind, length) in _anchors().iter(t):
        i = end + 1 - length
        if kind == "d":
            if i >= next_ip:
                stop, ok, next_ip = parse_ip(t, i)
                if ok:
                    found["ip"].append((i, stop))
            if i >= next_card:
                next_card, ok = parse_card(t, i)
                if ok:
                    found["card"].append((i, next_card))
        elif kind == "@":
            span = parse_email(t, i, mail_floor)
            if span:
                found["email"].append(span)
                mail_floor = span[1]
        elif kind == "+":
            if i >= next_phone:
                got = parse_phone(t, i)
                if got:
                    next_phone = got[0]
                    if got[1]:
                        found["phone"].append((i, got[0]))
        elif kind == "url":
            span = parse_url(t, i, end + 1) if i >= next_url else None
            if span:
                found["url"].append(span)
                next_url = span[1]
        elif kind == "secret":
            span = parse_secret(t, end + 1) if i >= next_secret else None
            if span:
                found["secret"].append(span)
                next_secret = span[1]
        elif i >= next_iban:
            span = parse_iban(t, end + 1)
            if span:
                found["iban"].append(span)
                next_iban = span[1]
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Each stretch covered by spans becomes one mark: the kind of the span that
    begins it (the longest where several do)."""
    if not spans:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out.append(text[at:s])
            out.append(f"<{k.upper()}>")
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans_column(text):
    """Array of (kind, start, end) for a text column."""
    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts], dtype=object)
    return spans(text)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, all spans."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                spans = find_spans(text if isinstance(text, str) else None)
                base = [x for x in spans if x[0] in BASE_KINDS]
                n = [sum(x[0] == k for x in base) for k in BASE_KINDS]
                rows.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    ).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by a mark; ``n_chars`` follows the new text.
    Columns and their order stay; a null text stays null."""
    mark = F.pandas_udf(lambda texts: pd.Series([redact(t, find_spans(t)) if isinstance(t, str) else None for t in texts], dtype=object), T.StringType())
    out = docs.withColumn("text", mark("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
