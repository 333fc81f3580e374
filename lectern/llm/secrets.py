"""Secret scans: patterns for known forms, and character Markov models for unknown ones.

Two order-1 Markov models over characters are compared: one of random strings, trained from the
values that the patterns label as secrets, and one of ordinary identifiers, trained from all other
long tokens of the corpus. A token whose log-likelihood ratio per character is high is a secret too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import prepare, tidy

# The forms of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

#: What may be a secret of unknown form: a long token with a digit in it.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
#: Characters that the models tell apart; all others are one more symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
BACKOFF = 20.0
SYMBOLS = len(ALPHABET) + 2  # others, and the start
CODE = np.full(256, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def labelled(text: str) -> Iterator[tuple[int, str]]:
    """(1, value) for the secrets that the patterns label; (0, token) for ordinary long tokens."""
    spans = base_spans(text)
    for a, b, kind in spans:
        yield 1, ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b]
    at = 0
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{5,}", text, re.ASCII):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            yield 0, m[0]


def transitions(token: str) -> np.ndarray:
    """Codes of the steps from each character to the next, the start included."""
    codes = CODE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
    return np.concatenate([[SYMBOLS - 1], codes[:-1]]) * SYMBOLS + codes


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(random) - log P(ordinary) of each step, a SYMBOLS x SYMBOLS table.

    All rows are read: each task counts the steps of its own labelled tokens in two fixed tables, and
    only these sums (at most 2 * SYMBOLS ** 2 numbers) reach the driver. A character's
    successors are smoothed with BACKOFF times how frequent each character is in all, and those
    counts start at one, so without any labelled secret random strings are uniform.
    """
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for batch in it:
            tokens: tuple[list, list] = ([], [])
            for text in batch.column(0).to_pylist():
                for label, token in labelled(text or ""):
                    tokens[label].append(token)
            for label in (0, 1):
                raw = np.frombuffer("\n".join(["", *tokens[label], ""]).encode("latin-1", "replace"), np.uint8)
                code = np.where(raw == 10, SYMBOLS - 1, CODE[raw])
                step = code[:-1] * SYMBOLS + code[1:]
                counts[label] += np.bincount(step[code[1:] != SYMBOLS - 1], minlength=SYMBOLS * SYMBOLS)
        label, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[label, step])], names=["label", "step", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(run), "label int, step int, n long")
    table = np.zeros((2, SYMBOLS, SYMBOLS))
    for r in counted.groupBy("label", "step").agg(F.sum("n").alias("n")).collect():
        table[r["label"]].flat[r["step"]] += r["n"]
    single = table.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    p = (table + BACKOFF * single) / (table.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(p[1]) - np.log(p[0])


def markov_spans(text: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, str]]:
    """Tokens with a digit, in all, whose ratio per character is at least ``threshold``."""
    out = []
    for m in TOKEN.finditer(text):
        if DIGIT.search(m[0]) and ratio.flat[transitions(m[0])].mean() >= threshold:
            out.append((m.start(), m.end(), KINDS[3]))
    return out


def apart(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of ``base``, which is sorted by start."""
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    return [s for s in spans if not (k := bisect_left(starts, s[1])) or reach[k - 1] <= s[0]]


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 1.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. A Markov span
    is reported only where it overlaps no base span. A null or empty text has no spans. Whole texts
    are read, however long; repeated rows each get a row; other columns are not read.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = apart(markov_spans(text or "", ratio, threshold), base)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(render(base).encode()).hexdigest(), render(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(text: str | None, spans: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with its spans replaced."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
