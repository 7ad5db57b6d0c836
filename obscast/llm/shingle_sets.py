"""Word shingle sets of many texts at once, on numpy arrays inside a task."""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Keeps the first k bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one by a cryptographic hash.
LONG_WORD = 512


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of all texts in order, and words per text.

    A word is hashed eight bytes at a time, every block folded in by a multiplication and a
    mix of all bits, for all words that are that long at once.
    """
    data = b" ".join(t.translate(_LOWER) for t in texts) + b" " * 9
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, size = edge[0::2], edge[1::2] - edge[0::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    eight = np.ndarray(len(raw) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    with np.errstate(over="ignore"):
        hashes = mix((eight[begin] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _P))
        at, rest = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
        while len(rest):
            block = eight[begin[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]
            hashes[rest] = mix(hashes[rest] * _P ^ block)
            at += 8
            rest = rest[size[rest] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[begin[k] : begin[k] + size[k]], digest_size=8).digest()
        hashes[k] = int.from_bytes(digest, "little")
    return hashes, counts


def _distinct(hashes: np.ndarray) -> np.ndarray:
    ordered = np.sort(hashes)
    new = np.empty(len(ordered), bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text.

    With fewer words than `width` the whole sequence is one shingle; without words none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        whole = words.copy()
        for k in range(1, width):
            whole[:-k] = whole[:-k] * _P + words[k:] if len(words) > k else whole[:-k]
        whole = mix(whole + np.uint64(width))
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(_distinct(whole[end - n : end - width + 1]))
        elif n:
            with np.errstate(over="ignore"):
                h = np.uint64(n)
                for w in words[end - n : end]:
                    h = mix(h * _P + w)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
