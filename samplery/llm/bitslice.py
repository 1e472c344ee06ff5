"""Hamming distances by bit planes: lane l of plane p is bit p of fingerprint l."""

from __future__ import annotations

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(fingerprints: np.ndarray) -> np.ndarray:
    """(64, words) planes of uint64 fingerprints, 64 lanes to a word, with one spare word for shifts."""
    words = len(fingerprints) // 64 + 2
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fingerprints)] = np.unpackbits(fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_to_words(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def shifted(planes: np.ndarray, lanes: int) -> np.ndarray:
    """Planes whose lane l is lane l + ``lanes`` of the given ones."""
    word, bit = divmod(lanes, 64)
    out = np.zeros_like(planes)
    moved = planes[:, word:]
    if not moved.shape[1]:
        return out
    if bit:
        out[:, : moved.shape[1]] = moved >> np.uint64(bit)
        out[:, : moved.shape[1] - 1] |= moved[:, 1:] << np.uint64(64 - bit)
    else:
        out[:, : moved.shape[1]] = moved
    return out


def within(a: np.ndarray, b: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """Words with a 1 for each alive lane in which ``a`` and ``b`` differ in at most ``radius`` bits.

    A carry-save counter of k bits per lane starts at 2**k - 1 - radius, so that it overflows exactly when the
    distance passes the radius. Every 8 planes the words in which all lanes have overflowed are abandoned.
    """
    k = max(1, int(radius).bit_length())
    start = (1 << k) - 1 - radius
    at = np.flatnonzero(alive)
    over = ~alive[at]
    counter = [np.full(len(at), _ALL if start >> j & 1 else np.uint64(0), np.uint64) for j in range(k)]
    for p in range(64):
        carry = a[p, at] ^ b[p, at]
        for j in range(k):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        over |= carry
        if p % 8 == 7:
            live = over != _ALL
            if not live.all():
                at, over, counter = at[live], over[live], [c[live] for c in counter]
                if not len(at):
                    break
    found = np.zeros(len(alive), np.uint64)
    found[at] = ~over
    return found


def pairs_within(fingerprints: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of one group within ``radius``; ``groups`` must be sorted, equal values side by side."""
    n = len(fingerprints)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, int)
    most = int(np.diff(np.r_[first, n]).max()) if n else 0
    planes = planes_of(fingerprints)
    left, right = [], []
    for d in range(1, most):
        alive = lanes_to_words(groups[:-d] == groups[d:], planes.shape[1])
        found = within(planes, shifted(planes, d), alive, radius)
        i = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: n - d])
        left.append(i)
        right.append(i + d)
    empty = np.zeros(0, int)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the given pairs reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
