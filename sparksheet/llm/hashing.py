"""Rolling hashes over whole batches of texts with numpy: substrings, words and word shingles in a few vector steps."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2**64; kept by each process for texts of usual length."""
    if n < len(_powers[0]):
        return _powers
    size = max(n + 1, 1 << 20)
    made = []
    for b in (_BASE, _INVERSE):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size <= 1 << 22:
        _powers[:] = made
    return made


class Rolling:
    """Hashes of any substrings [lo, hi) of one array of character codes, many at once."""

    def __init__(self, codes: np.ndarray):
        self.power, self.inverse = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[: len(codes)], out=self.sums[1:])

    def raw(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.inverse[lo]


#: Of which bytes words and terms consist: all but the blank and controls 9 to 13; or letters, digits and all outside ASCII.
WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def word_hashes(raw: bytes, ends: np.ndarray, made_of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Words (longest runs of the bytes they are made of, A-Z lower-cased) of texts joined in raw, each followed by a newline; ends: where each text's newline stands.  Returns each word's hash and its text's number."""
    a = np.frombuffer(raw, np.uint8)
    a = a + ((a >= 65) & (a <= 90)) * np.uint8(32)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = made_of[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = edge[::2], edge[1::2]
    roll = Rolling(a)
    return mix(roll.raw(lo, hi) ^ mix((hi - lo).astype(np.uint64))), np.searchsorted(ends, lo)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a text of fewer words has its whole sequence as one; a text without words has none."""
    parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    ends = np.cumsum([len(p) for p in parts]) - 1
    words, owner = word_hashes(b"".join(parts), ends)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled = mix(rolled * np.uint64(3) + words[j : j + n])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            out.append(s[np.flatnonzero(np.diff(s, prepend=s[0] ^ np.uint64(1)))])
        elif hi > lo:
            x = np.full(1, hi - lo, np.uint64)
            for w in words[lo:hi]:
                x = mix(x * np.uint64(5) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches_of(texts: list[str], most: int = 1 << 20):
    """Slices of texts of about `most` characters each; a longer text makes one of its own."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield lo, i
            lo, n = i, 0
        n += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
