"""Suffix sorting in two stages, and common prefixes of neighbours.

A suffix smaller than its successor (the suffix one byte on) is of type S, the others of type L. Only
type S is sorted directly. Type L is induced: the buckets of first bytes are scanned in ascending
order, and each suffix met puts its predecessor, if of type L, at the end of the L part of its own
bucket. A bucket holds its L part, then its S part. The scans work on whole buckets at a time.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; within a run of equal bytes, as at its end."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
        rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
        out[:] = np.repeat(rising, np.diff(np.concatenate([[-1], ends])))
    return out


def sort_suffixes(raw: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places where ``wanted`` is true, in the order of the first ``depth`` bytes from there.

    Only these suffixes are sorted, and the ones that they are induced from: the successors of a
    suffix of type L up to the first of type S.
    """
    text = np.frombuffer(raw, np.uint8)
    n = len(text)
    small = smaller_than_next(text)
    # from a wanted place on, all of type L and the first of type S
    at = np.arange(n)
    stop = np.minimum.accumulate(np.where(small, at, n - 1)[::-1])[::-1] if n else at
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[wanted], 1)
    np.add.at(edge, stop[wanted] + 1, -1)
    used = np.cumsum(edge)[:n] > 0

    def prefix(place: int) -> bytes:
        return raw[place : place + depth]

    direct = np.array(sorted(np.flatnonzero(used & small).tolist(), key=prefix), np.int64)
    first = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and used[n - 1] and not small[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))  # the last suffix, the smallest that starts so
    out = []
    for c in range(256):
        part = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        waves = [part]
        while len(waves[-1]):  # predecessors in the same bucket: runs of one byte
            before = waves[-1][waves[-1] > 0] - 1
            waves.append(before[(text[before] == c) & used[before] & ~small[before]])
        bucket = np.concatenate([*waves, direct[first[c] : first[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[used[before] & ~small[before] & (text[before] > c)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for group in np.split(before, cuts):
                induced[text[group[0]]].append(group)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(raw: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """The length, ``depth`` at most, of the prefix that each suffix but the first shares with the one before."""
    padded = raw + bytes(depth + 8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    left, right = order[:-1], order[1:]
    out = np.full(len(right), depth, np.int64)
    live = np.arange(len(right))
    for at in range(0, depth, 8):
        if not len(live):
            break
        differ = words[left[live] + at] ^ words[right[live] + at]
        other = differ != 0
        lowest = differ[other] & (~differ[other] + np.uint64(1))  # the first byte that differs is the lowest
        out[live[other]] = np.minimum(depth, at + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        live = live[~other]
    # a suffix has no bytes beyond the end of the text
    return np.minimum(out, len(raw) - np.maximum(left, right))
