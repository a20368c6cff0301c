"""Word and shingle hashing over a batch of UTF-8 texts.

Words of up to 16 bytes are hashed together, as two numbers and a length, with
secret numbers added before every mixing step; longer ones by keyed BLAKE2b.
The key is drawn per run, so that nobody can write two words of one hash.
Shingles are mixed from such hashes.  Where a result must not rest on hashes at
all, ``common_shingles`` counts on the words.
"""

from __future__ import annotations

import secrets
from hashlib import blake2b

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def new_key() -> bytes:
    return secrets.token_bytes(16)


def split(text: bytes | None) -> list[bytes]:
    """Words of a text, runs of anything but ``[\\x20\\x09-\\x0D]``, with A-Z
    lower-cased; null has none."""
    return text.lower().split() if text else []


class Hasher:
    """128 bits of hash for every word, under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.lanes = np.frombuffer(blake2b(b"lanes", key=key, digest_size=48).digest(), "<u8").reshape(2, 3)

    def words(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (n, 2) of the words of all texts, and where each text starts
        among them (one more entry than texts)."""
        texts = [t or b"" for t in texts]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        whole = b"\n".join([*texts, b" " * 16]).lower()
        data = np.frombuffer(whole, np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = end - start
        # eight bytes from every place on, little-endian
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        one = eight[start] & _FIRST[np.minimum(n, 8)]
        two = eight[start + 8] & _FIRST[np.clip(n - 8, 0, 8)]
        out = np.empty((len(start), 2), np.uint64)
        for i, (a, b, c) in enumerate(self.lanes):
            out[:, i] = mix(mix(mix(one ^ a) + two + b) ^ (n.astype(np.uint64) + c))
        for i in np.flatnonzero(n > 16).tolist():
            out[i] = np.frombuffer(blake2b(whole[start[i] : end[i]], digest_size=16, key=self.key).digest(), "<u8")
        return out, np.searchsorted(start, begins)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of all k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, _U(k), np.uint64)
    for i in range(k):
        h = mix(h * _U(0xD6E8FEB86659FD93) + hashes[i : i + n])
    return h


def shingle_sets(texts: list[bytes | None], k: int, hasher: Hasher) -> list[tuple[np.ndarray, bytes]]:
    """Per text the sorted distinct shingle hashes, and 128 bits that stand for
    the whole set.

    A text of fewer than ``k`` words, but not none, has its whole word
    sequence as its one shingle.
    """
    hashes, at = hasher.words(texts)
    one, two = (np.ascontiguousarray(hashes[:, i]) for i in (0, 1))
    rolled, more = windows(one, k), windows(two, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s, first = np.unique(rolled[a : b - k + 1], return_index=True)
            t = more[a : b - k + 1][first]
        else:
            s, t = windows(one[a:b], b - a), windows(two[a:b], b - a)
            s, t = s[: b > a], t[: b > a]
        out.append((s, blake2b(t.tobytes() + s.tobytes(), digest_size=16).digest()))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def common_shingles(a: bytes | None, b: bytes | None, k: int) -> tuple[int, int, int]:
    """Sizes of the shingle sets of two texts and of their intersection,
    compared word by word: words are numbered and windows of numbers renumbered
    step by step, so that no two unlike shingles share a number."""
    numbers: dict[bytes, int] = {}
    x, y = ([numbers.setdefault(w, len(numbers)) for w in split(t)] for t in (a, b))
    if len(x) < k or len(y) < k:
        size = lambda z: max(len(z) - k + 1, min(1, len(z)))
        if len(x) < k and len(y) < k:
            return size(x), size(y), int(bool(x) and x == y)
        return *(size(z) if len(z) < k else common_shingles(t, t, k)[0] for z, t in ((x, a), (y, b))), 0
    z = np.array(x + y, np.int64)
    code = z
    for i in range(1, k):
        code = np.unique(code[: len(z) - i] * len(numbers) + z[i:], return_inverse=True)[1]
    left, right = np.unique(code[: len(x) - k + 1]), np.unique(code[len(x) :])
    return len(left), len(right), overlap(left, right)
