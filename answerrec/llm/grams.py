"""Hashes of words and n-grams for many texts at once, as numpy arrays.

Texts are UTF-8 bytes in one buffer, each followed by a zero byte. Hashes are polynomials
over 64 bits, so that the hash of any stretch comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(0xC2B2AE3D27D4EB4F)

KEPT_POWERS = 2**19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those of small buffers are kept."""
    found = []
    for i, base in enumerate((BASE, INVERSE)):
        if len(_powers[i]) < n:
            steps = np.full(max(n, KEPT_POWERS), base)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
            if n <= KEPT_POWERS:
                _powers[i] = found[i]
        else:
            found.append(_powers[i])
    return found[0][:n], found[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pieces(texts: list[bytes], limit: int = 2**21) -> Iterator[tuple[int, bytes]]:
    """(index, part) of each text; a text beyond `limit` bytes is cut at spaces after every `limit`.

    The cuts depend on the text alone. Callers that need n-grams across cuts carry words over.
    """
    for i, text in enumerate(texts):
        start = 0
        while len(text) - start > limit:
            cut = text.find(b" ", start + limit)
            if cut < 0:
                break
            yield i, text[start:cut]
            start = cut + 1
        yield i, text[start:]


def packs(texts: list[bytes], limit: int = 2**21, together: int = 2**18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of bounded size: (bytes, first position of each part, index of its text).

    Parts share a buffer up to `together` bytes; a longer one has its own.
    """
    held: list[tuple[int, bytes]] = []
    size = 0
    for item in pieces(texts, limit):
        if held and size + len(item[1]) > together:
            yield pack(held)
            held, size = [], 0
        held.append(item)
        size += len(item[1]) + 1
    if held:
        yield pack(held)


def pack(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) + 1 for _, p in parts])
    buffer = np.frombuffer(b"\0".join([*(p for _, p in parts), b""]), np.uint8)
    return buffer, np.concatenate(([0], np.cumsum(lengths)[:-1])), np.array([i for i, _ in parts])


def windows(buffer: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n bytes from each position, and whether the window holds no zero byte."""
    size = len(buffer) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = np.zeros(size, np.uint64)
    inside = np.ones(size, bool)
    full = buffer != 0
    for j in range(n):
        h = h * BASE + buffer[j : j + size]
        inside &= full[j : j + size]
    return mix(h), inside


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where the mask holds."""
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(buffer: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each stretch of bytes where the mask holds."""
    starts, ends = runs(mask)
    up, down = powers(len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def shingles(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every n successive words of one owner."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, owner.dtype)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * STEP + hashes[j : j + size]
    same = owner[:size] == owner[n - 1 :]
    return mix(h[same]), owner[:size][same]


#: Bytes that belong to words: ASCII letters, digits, underscore, and every byte of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

#: Bytes that are not white space or zero.
SOLID = np.ones(256, bool)
SOLID[[0, *range(9, 14), 32]] = False
