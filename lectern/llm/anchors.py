"""Content-defined anchors: equal strings of a given length hold the same anchor at the same place.

Every string of ``length`` bytes is assigned the place, within it, of the gram of GRAM bytes that has
the smallest hash (of equal ones the last). The choice depends on the string alone, so all its
occurrences have equal grams at equal distances, and the grams' fingerprints bring them together.
Neighbouring strings mostly share their anchor: one in about length / 2 bytes is chosen.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place of a byte array, as far as they fit."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data), 8), (1, 1))
    words = np.ascontiguousarray(whole).view("<u8").reshape(-1)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out = (out ^ words[k : k + n]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    return out ^ (out >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value, the last of equal ones, in each window of ``width`` values.

    Minima from the left and from the right within blocks of ``width`` meet in every window.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    grid = full.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    # the last place with that value: walk each change of the minimum, not each place
    at = np.arange(len(full))
    hit = np.where(full == left, at, -1)  # a value that is its block's minimum so far
    last = np.maximum.accumulate(hit.reshape(blocks, width), axis=1).reshape(-1)[width - 1 : width - 1 + n]
    # from the right, a place that equals the minimum of all after it in its block; the last such place is kept
    back = np.where(full == right, at, len(full)).reshape(blocks, width)
    strict = np.concatenate([grid[:, :-1] == right.reshape(blocks, width)[:, 1:], np.zeros((blocks, 1), bool)], axis=1)
    back[strict] = len(full)
    first = np.minimum.accumulate(back[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    return np.where(left[width - 1 : width - 1 + n] == best, last, first)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, first, last) of each anchor; the strings from first to last are assigned to it."""
    hashes = gram_hashes(data)
    chosen = window_minima(hashes, length - GRAM + 1)
    if not len(chosen):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    place = chosen[first]
    return hashes[place].view(np.int64), place, first, last


def anchors_of_long(data: np.ndarray, length: int, segment: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """``anchors`` with bounded memory: the strings are taken a segment at a time."""
    if len(data) <= segment + length:
        return anchors(data, length)
    parts = []
    for at in range(0, len(data) - length + 1, segment):
        print_, *places = anchors(data[at : at + segment + length - 1], length)
        parts.append((print_, *(p + at for p in places)))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
