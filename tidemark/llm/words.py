"""Words of flat UTF-8 bytes and their 64-bit hashes, without a loop over words.

A word is a longest run of bytes that are not separators, so every non-ASCII character is part
of a word. Hashes depend on the bytes of the word alone and are the same in every task.
"""

from __future__ import annotations

import hashlib

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LONG_WORD = 256


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Everything in ASCII but digits and lower-case letters.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: White space of ASCII.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~cut[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded.data, 0, (1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per word: eight bytes at a time over all words that go on."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * GOLDEN)
    eight = octets(data)
    most = int(min(size.max(initial=0), LONG_WORD))
    live = np.arange(len(starts))
    for at in range(0, most, 8):
        if at:
            live = live[size[live] > at]
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        part = eight[starts[live] + at] << (np.uint64(64) - np.uint64(8) * left)
        out[live] = mix(out[live] * M2 + part + GOLDEN)
    for i in np.flatnonzero(size > LONG_WORD):
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    return out


def hashed(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and for each row the index of its first word, about a block of bytes at a time.

    Blocks end behind a separator; a longer word is a block of its own.
    """
    if len(data) <= block:
        starts, ends, first = spans(data, offsets, cut)
        return hashes(data, starts, ends), first
    out, first, done, a = [], [], 0, 0
    while a < len(data):
        b = min(a + block, len(data))
        if b < len(data):
            back = np.flatnonzero(cut[data[a:b]])
            if len(back):
                b = a + int(back[-1]) + 1
            else:
                while b < len(data) and not cut[data[b - 1]]:
                    ahead = np.flatnonzero(cut[data[b : b + block]])
                    b = b + int(ahead[0]) + 1 if len(ahead) else min(b + block, len(data))
        inside = offsets[(offsets >= a) & (offsets < b)]
        starts, ends, at = spans(data[a:b], np.concatenate([inside - a, [b - a]]), cut)
        out.append(hashes(data[a:b], starts, ends))
        first.append(at[:-1] + done)
        done += len(starts)
        a = b
    first.append(np.full(int((offsets >= len(data)).sum()), done))
    return np.concatenate(out), np.concatenate(first).astype(np.int64)


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive values; other seeds give independent hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, mix(np.array([seed * 2 + 1], np.uint64) * GOLDEN)[0], np.uint64)
        for j in range(k):
            out = (out ^ words[j : j + n]) * M1
            out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def anchors(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values the place of its least value, the last of equal ones.

    The place depends on the window's content alone, so equal windows agree on it.
    """
    low, block = np.uint64((1 << 24) - 1), 1 << 23
    out = [np.empty(0, np.int64)]
    for a in range(0, len(values) - width + 1, block):  # places are packed into the low bits, block by block
        part = values[a : a + block + width - 1]
        least = sliding_min((part & ~low) | (low - np.arange(len(part), dtype=np.uint64)), width)
        out.append((low - (least & low)).astype(np.int64) + a)
    return np.concatenate(out)
