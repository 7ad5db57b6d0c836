"""Best-fit packing of token sequences by the sum-of-squares rule.

`token_pieces` encodes every whole text and cuts only documents above the capacity.
`pack` puts pieces into sequences: a piece goes where the sum of the squared counts of
open bins per residual gap becomes smallest (a new bin is one of the choices). Pieces
are dealt by a hash into shards of about `shard_pieces` pieces; a shard is packed by
itself, so the work spreads, a task's memory is bounded by the shard, and only a few
part-filled bins a shard are left over. Only ids and lengths are shuffled, never tokens.

Defined results: a null or empty text is the end token alone; equal lengths are placed
in the order of (doc_id, piece, tie-break hash); repeated doc_ids are packed row by row;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscast.llm.merges import merger
from obscast.llm.shared import cut

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 50_000
#: Words kept encoded during a task and after it; beyond that, words are encoded each time.
MEMO_WORDS, KEPT_WORDS = 200_000, 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


#: Lower-cased words of these characters split alike in the tokenizer's pattern and in SPLIT.
PLAIN = re.compile(r"[!-~\xdf-\xf6\xf8-\xff]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Stops that end a word as a part of its own, however many follow each other.
STOPS = b".,;:!?"
UPPER = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


class WordIds:
    """Ids of words as little-endian 32-bit bytes.

    The tokenizer drops white space and its pattern never crosses it, so a text's ids are
    those of its words one after the other. Plain words are merged together on arrays;
    words with other characters, or that may hold a control token, go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.merger = merger(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        parts: dict[bytes, int] = {}
        single, split, other = [], [], []
        for word in words:
            core = word.rstrip(STOPS)
            if core.isalpha():
                # Letters of ASCII and stops behind them: one part each, as SPLIT has it.
                k = parts.setdefault(core.lower(), len(parts))
                if len(core) == len(word):
                    single.append((word, k))
                else:
                    split.append((word, [k, parts.setdefault(word[len(core) :], len(parts))]))
                continue
            text = word.decode()
            if UPPER.fullmatch(text) and "<|" not in text and PLAIN.fullmatch(low := text.lower()):
                split.append((word, [parts.setdefault(p.encode(), len(parts)) for p in SPLIT.findall(low)]))
            else:
                other.append(word)
        ids, begins = self.merger.encode(list(parts))
        data, at = ids.tobytes(), (begins * 4).tolist()
        found = {w: data[at[k] : at[k + 1]] for w, k in single}
        found |= {w: b"".join([data[at[k] : at[k + 1]] for k in ks]) for w, ks in split}
        if other:
            encoded = self.tokenizer.encode_batch([w.decode() for w in other], add_special_tokens=False)
            found |= {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(other, encoded, strict=True)}
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        lists = [t.split() for t in texts]
        new = set().union(*lists).difference(self.known)
        self.known.update(self._new(list(new)))
        out = [b"".join(map(self.known.__getitem__, words)) for words in lists]
        if len(self.known) > MEMO_WORDS:
            for word in new:
                del self.known[word]
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process."""
    return WordIds(path)


def slices(sizes: list[int], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of rows of about `most` bytes; a longer row is a run of its own."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids if asked for)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, width, end = word_ids(tokenizer), 4 * capacity, np.asarray([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        kinds += [pa.list_(pa.int64())] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for part in slices([len(t) for t in texts]):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[part], words.encode(texts[part]), strict=True):
                    ids += end
                    for k in range(0, len(ids), width):
                        own = ids[k : k + width]
                        row = (doc_id, k // width, k // 4, len(own) // 4, zlib.crc32(own))
                        rows.append((*row, np.frombuffer(own, "<u4").tolist()) if with_ids else row)
                columns = zip(zip(*rows, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)
        # Workers serve other stages after this task: they keep the words seen first only.
        words.known = dict(islice(words.known.items(), KEPT_WORDS))

    schema = PIECES + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the order given.

    With n(g) open bins of residual gap g, putting s into a bin of gap g changes the sum of
    squares by 2 * (n(g - s) - n(g)) + 2; closing a bin exactly (g = s) and opening a new one
    change it by 1 - 2 * n(g) and 1 + 2 * n(capacity - s). Ties go to the smallest gap.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, far = 0, np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        gap = n[s:capacity]
        cost = np.where(gap > 0, 2 * (n[: capacity - s] - gap) + 2, far)
        if s < capacity and gap[0] > 0:
            cost[0] = 1 - 2 * gap[0]
        best = int(cost.argmin()) if len(cost) else -1
        fresh = 1 + 2 * int(n[capacity - s]) if s < capacity else -far
        if best >= 0 and cost[best] <= fresh and cost[best] != far:
            g = best + s
            b = open_bins[g].pop()
            n[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[k], offsets[k] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            n[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset. `pieces` should be stored: it is read twice."""
    shards = max(1, -(-pieces.count() // shard_pieces))

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(part["length"].to_numpy(), capacity)
        return part.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(token_pieces(docs, tokenizer, capacity)), capacity)
