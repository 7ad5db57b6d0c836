"""Exact byte-pair merging of many words at once, on numpy arrays inside a task."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: No merge.
NEVER = np.int64(1 << 40)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(shown))
    return [c for _, c in sorted([(b, chr(b)) for b in shown] + [(b, chr(256 + k)) for k, b in enumerate(rest)])]


class PairTable:
    """Ranks of symbol pairs: a two-choice hash table probed for whole arrays."""

    def __init__(self, pairs: np.ndarray, bits: int = 19):
        # Each pair sits at one of two places; the few that lose both places are searched for.
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NEVER, np.int64)
        ranks, left = np.arange(len(pairs), dtype=np.int64), pairs.astype(np.int64)
        for mix in _MIX:
            at = self._place(left, mix)
            free = self.keys[at] < 0
            at, sub, r = at[free], left[free], ranks[free]
            self.keys[at], self.ranks[at] = sub, r
            lost = np.ones(len(left), bool)
            lost[np.flatnonzero(free)[self.keys[at] == sub]] = False
            left, ranks = left[lost], ranks[lost]
        order = np.argsort(left)
        self.rest, self.rest_ranks = left[order], ranks[order]

    def _place(self, keys: np.ndarray, mix: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * mix) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys, _MIX[0])
        out = np.where(self.keys[at] == keys, self.ranks[at], NEVER)
        miss = np.flatnonzero(out == NEVER)
        sub = keys[miss]
        at = self._place(sub, _MIX[1])
        found = np.where(self.keys[at] == sub, self.ranks[at], NEVER)
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, sub), len(self.rest) - 1)
            found = np.where(self.rest[at] == sub, self.rest_ranks[at], found)
        out[miss] = found
        return out


class Merger:
    """Byte-level BPE of a tokenizer file: `words` in, ids out, as the merges rank them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added: list[dict] = spec["added_tokens"]
        model, added = spec["model"], {t["content"]: t["id"] for t in self.added}
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        self.table = PairTable(pairs)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        bytes_of = {s: b for b, s in enumerate(symbols)}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            body = token[: -len(end)] if end and token.endswith(end) else token
            self.token_bytes[i] = bytes(bytes_of[c] for c in body if c in bytes_of)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()

    def encode(self, words: list[bytes], block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty) one after the other, and where each word's begin."""
        parts = [self._encode(words[k : k + block]) for k in range(0, len(words), block)]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "<u4")
        sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        closes = np.zeros(len(sym), bool)
        closes[ends] = True
        rank = np.full(len(sym), NEVER)
        inner = np.flatnonzero(~closes)
        rank[inner] = self.table((sym[inner] << 20) | sym[inner + 1])
        which = np.arange(len(words))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            begins = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, begins)
            done = least == NEVER
            if done.any():
                gone = np.repeat(done, size)
                out.append((which[done], size[done], sym[gone]))
                stay = ~gone
                sym, rank, closes = sym[stay], rank[stay], closes[stay]
                which, size, least = which[~done], size[~done], least[~done]
                if not len(which):
                    break
            # The leftmost pair of the least rank in each word merges.
            at = np.flatnonzero(rank == np.repeat(least, size))
            begins = np.cumsum(size) - size
            at = at[np.searchsorted(at, begins)]
            sym[at] = self.made[rank[at]]
            closes[at] = closes[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = NEVER
            right = at[~closes[at]]
            rank[right] = self.table((sym[right] << 20) | sym[right + 2])
            left = at[at > begins]
            rank[left - 1] = self.table((sym[left - 1] << 20) | sym[left])
            sym, rank, closes = sym[keep], rank[keep], closes[keep]
            size = size - 1
        order = np.concatenate([o[0] for o in out])
        sizes = np.empty(len(words), np.int64)
        sizes[order] = np.concatenate([o[1] for o in out])
        begins = np.cumsum(sizes) - sizes
        done_sizes = sizes[order]
        inside = np.arange(done_sizes.sum()) - np.repeat(np.cumsum(done_sizes) - done_sizes, done_sizes)
        ids = np.empty(sizes.sum(), "<u4")
        ids[np.repeat(begins[order], done_sizes) + inside] = np.concatenate([o[2] for o in out])
        return ids, sizes


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    """One per worker process."""
    return Merger(path)
