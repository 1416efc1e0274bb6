"""Words of whole texts as numpy arrays: spans and 64-bit hashes, without a Python object for each word.

A word is a maximal run of bytes other than space and 0x09-0x0D. A span's bytes are taken eight at a time and mixed one lane
after the other, so spans of up to eight bytes of one length never share a hash; spans above LONG bytes are hashed by
BLAKE2b. Hashes of windows combine mixed halves. No step is linear, so texts made of regular patterns meet only by chance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Bytes up to which spans are hashed in lanes of eight.
LONG = 256
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the lowest n bytes

np.seterr(over="ignore")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits depend on all bits of its input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; `which` (0 or 1) chooses one of two functions."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = mix(eight[begin] & LOW[np.minimum(size, 8)] ^ SEEDS[which])
    h = mix(h + size.astype(np.uint64) * ODD)
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(live):
        h[live] = mix(h[live] * STEP + (eight[begin[live] + at] & LOW[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = strong(data[begin[k] : end[k]].tobytes())[which]
    return h


def strong(raw: bytes) -> tuple[int, int]:
    """BLAKE2b of 128 bits as two unsigned integers."""
    digest = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


@dataclass
class Words:
    """The words of some texts: text k has words first[k] to first[k + 1] - 1, with byte spans in data."""

    data: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str], lower: bool = False) -> Words:
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
    bound = np.concatenate([[0], np.cumsum(size + 1)])
    return Words(data, np.searchsorted(begin, bound), begin, end, span_hashes(data, begin, end))


def windows_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring values; the i-th starts at i. Empty if there are fewer than k. Runs of 1, 2, 4, ...
    values are combined to those of which k is the sum."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, offset, done = hashes, 1, 0, None
    while True:
        if k & size:
            part = power[offset : offset + n]
            done = part if done is None else mix(done * ODD + part)
            offset += size
        if 2 * size > k:
            return done
        power = mix(power[: len(power) - size] * STEP + power[size:])
        size *= 2


def shingle_sets(texts: list[str], k: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a text with fewer words has its whole sequence as one."""
    words = words_of(texts, lower)
    grams = windows_of(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(mix(windows_of(words.hash[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
