"""URL filters: glob rules packed into multiword Shift-And masks and run over all URLs at once.

Rules are globs over the key ``.host/path``. ``*`` stands for any characters but ``/`` and ``**`` for
any characters. Each literal of a rule takes one bit; the bits of all rules stand side by side in
64-bit words. For each position of the URLs, one shift, one mask and one self-loop step over the
words advance every rule on every URL of the batch together (numpy rows are URLs, columns words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import prepare, utf8

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``action`` for a host, all its subdomains, and paths that start with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """Over ``.host/path``: a host label boundary stands before the rule's host."""
        return f"*.{self.host}{self.path}**"


#: The rules of the registered query.
RULES = (
    Rule(BLOCK, "net"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
)


class ShiftAnd:
    """The automaton of many globs.

    State bit p says that the glob's literals up to p have been read. ``step[c]`` has the bits whose
    literal is c; ``stay[c]`` the bits that a wildcard behind them keeps alive on c. A glob's first
    state is a bit of its own, which no shift reaches from the glob before it.
    """

    def __init__(self, globs: list[str]) -> None:
        step: list[set[int]] = [set() for _ in range(256)]
        stay: list[set[int]] = [set() for _ in range(256)]
        first, self.last = [], []
        bit = 0
        for glob in globs:
            first.append(bit)
            raw, k = glob.encode(), 0
            while k < len(raw):
                if raw[k : k + 1] == b"*":
                    deep = raw[k : k + 2] == b"**"
                    for c in range(256):
                        if deep or c != ord("/"):
                            stay[c].add(bit)
                    k += 1 + deep
                else:
                    bit += 1
                    step[raw[k]].add(bit)
                    k += 1
            self.last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.step = np.stack([self._mask(b) for b in step])
        self.stay = np.stack([self._mask(b) for b in stay])
        self.first = self._mask(set(first))
        self.final = self._mask(set(self.last))

    def _mask(self, bits: set[int]) -> np.ndarray:
        out = [0] * self.words
        for b in bits:
            out[b // 64] |= 1 << (b % 64)
        return np.array(out, np.uint64)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean [url, glob]: which globs match the whole of which byte string."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, left = offsets[:-1][order], lengths[order]
        state = np.repeat(self.first[None, :], len(order), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(left[0]) if len(left) else 0):
            alive = int(np.searchsorted(-left, -at, side="left"))  # the URLs longer than `at` come first
            c = data[starts[:alive] + at]
            s = state[:alive]
            shifted = s << one
            shifted[:, 1:] |= s[:, :-1] >> top
            state[:alive] = (shifted & self.step[c]) | (s & self.stay[c])
        out = np.zeros((len(order), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one == 1
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    globs: tuple[tuple[str, str], ...] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """page_id, host, path, rule, verdict, glob for every row.

    The longest matching rule decides (of equally long ones, the first given); else the first
    matching one of ``globs``, pairs of (action, glob over ``.host/path``); else ``default``. A null
    URL, or one without ``://``, has an empty host and path and fits no rule. Whole URLs of any
    length are read; repeated rows each get a row; other columns are not read.
    """
    prepare(pages.sparkSession)
    patterns = [r.glob for r in rules] + [g for _, g in globs]
    by_length = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(patterns)
        for batch in it:
            data, offsets = utf8(batch.column(3))
            hit = automaton.match(data, offsets)
            rule = np.full(len(hit), -1)
            for k in reversed(by_length):
                rule[hit[:, k]] = k
            extra = np.full(len(hit), -1)
            for k in reversed(range(len(globs))):
                extra[hit[:, len(rules) + k]] = k
            extra[rule >= 0] = -1
            names = [rules[k].name if k >= 0 else None for k in rule]
            verdicts = [rules[r].action if r >= 0 else globs[g][0] if g >= 0 else default for r, g in zip(rule, extra, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array([globs[g][1] if g >= 0 else None for g in extra], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "glob"],
            )

    url = F.col(url_col).cast("string")
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = picked.withColumn("key", F.concat(F.lit("."), "host", "path"))
    return keyed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, glob string")
