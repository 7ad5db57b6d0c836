"""Byte-level BPE encoding and decoding over a transducer of the corpus's frequent words.

1. `frequent_words` counts the words of all documents (partial counts in each task).
2. `publish_lexicon` compiles the most frequent ones, with their ids, into a minimal
   acyclic transducer, one file that Spark ships to every executor, where tasks map it.
3. `encode` splits whole texts into words, looks them up, and merges the words that the
   lexicon lacks exactly by the tokenizer's ranks. Which words the lexicon holds changes
   the speed, never the ids.
4. `decode` joins the bytes of the ids.

Defined results: a null or empty text has no ids and decodes to the empty text; control
tokens that a text spells out get their own id, as the library does by default; texts of
any length are encoded whole; repeated rows and equal texts are encoded alike; an empty
table gives no rows; of other columns only those named in `keep` are read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obscast.llm.lexicon import Lexicon, compile_lexicon
from obscast.llm.merges import merger
from obscast.llm.packing import slices
from obscast.llm.shared import cut

#: Size of the lexicon, and parts of the count that fits in part.
LEXICON_WORDS, FILL = 50_000, 4096
#: Words kept encoded in a worker process, and chunks that it counts before it reports them.
MEMO_WORDS, COUNTED = 200_000, 100_000
#: Bytes of texts that are strings at a time.
AT_ONCE = 1_000_000

#: Unicode white space (fixed by the tokenizer's pattern).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern's matches never cross the borders of these chunks.
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: White space in front of a space or line break, or white space other than these two.
UNSAFE = re.compile("[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\0\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The pattern of the byte-level pre-tokenizer (fixed).
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
)
#: Marks that end a word and are words of their own after it.
PERIODS = frozenset(".,;:!?|")
#: Characters whose class has been the same in every version of Unicode since 4.0: Latin, Greek,
#: Cyrillic, Hebrew and Arabic letters, general punctuation, kana, Han and Hangul. Chunks with
#: others (emoji, combining marks, rare scripts) go to the library.
STABLE = re.compile(
    "[\\t-\\r -~\\xa0-\u0220\u0222-\u0233\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ce\u05d0-\u05ea\u0621-\u063a\u0641-\u064a"
    "\u2010-\u2027\u2030-\u2038\u203b-\u203e\u20ac\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+"
)


class Encoder:
    """Texts to ids inside a task."""

    def __init__(self, tokenizer: str, lexicon: str | None):
        self.tokenizer = tokenizer
        self.merger = merger(tokenizer)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        added = self.merger.added
        if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("control tokens that take in their surroundings are not supported")
        self.control = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in added}
        self.border = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.control, key=len, reverse=True)) + ")")
        self.known: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """Loaded where a text needs it: it takes as much memory as all else here."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.tokenizer)
        library.no_truncation()
        library.no_padding()
        return library

    def chunks(self, text: str) -> list[str]:
        if not any(t in text for t in self.control):
            return CHUNK.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.border.split(text)):
            out += [part] if k % 2 else CHUNK.findall(part)
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        ranks = self.lexicon.find(words) if self.lexicon else np.full(len(words), -1)
        for k in np.flatnonzero(ranks >= 0).tolist():
            out[k] = self.lexicon.output(ranks[k]).astype("<u4").tobytes()
        rest = np.flatnonzero(ranks < 0).tolist()
        ids, begins = self.merger.encode([words[k] for k in rest])
        data, at = ids.tobytes(), (begins * 4).tolist()
        for j, k in enumerate(rest):
            out[k] = data[at[j] : at[j + 1]]
        return out

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        words: dict[str, int] = {}
        whole, split, other = [], [], []
        for chunk in chunks:
            if not STABLE.fullmatch(chunk):
                other.append(chunk)
            elif chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):
                whole.append((chunk, words.setdefault(chunk, len(words))))
            elif chunk[-1] in PERIODS and chunk[:-1].lstrip(" ").isalpha():
                ks = (words.setdefault(chunk[:-1], len(words)), words.setdefault(chunk[-1], len(words)))
                split.append((chunk, ks))
            else:
                split.append((chunk, [words.setdefault(w, len(words)) for w in PATTERN.findall(chunk)]))
        ids = self._words([w.encode() for w in words])
        found = {c: ids[k] for c, k in whole}
        found |= {c: b"".join([ids[k] for k in ks]) for c, ks in split}
        if other:
            encoded = self.library.encode_batch(other, add_special_tokens=False)
            found |= {c: np.asarray(e.ids, "<u4").tobytes() for c, e in zip(other, encoded, strict=True)}
        return found

    def units(self, text: str) -> list[str]:
        """The text cut into strings that the pattern's matches do not cross.

        A cut is safe before a space or line break unless white space stands in front of
        it. Texts without such a place, the usual ones, are cut there by plain splits; the
        leading spaces stay off, and _key() puts them back where a unit is first seen.
        """
        if UNSAFE.search(text) or any(t in text for t in self.control):
            return [f"\0{c}" for c in self.chunks(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return [f"\0{first}", *rest] if first else rest

    @staticmethod
    def _key(unit: str) -> str:
        mark = unit[:1]
        return unit[1:] if mark == "\0" else unit if mark == "\n" else f" {unit}"

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing below makes cycles, and scanning millions of strings is slow
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        get, found, gaps, missing = self.known.get, [], [], set()
        for text in texts:  # text by text, so that a text's strings are looked up while in cache
            units = self.units(text)
            ids = list(map(get, units))
            at = [k for k, x in enumerate(ids) if x is None]
            for k in at:
                ids[k] = units[k]
            missing.update([units[k] for k in at])
            found.append(ids)
            gaps.append(at)
        new = list(missing)
        pieces = [CHUNK.findall(c) if (c := self._key(u)) not in self.control else [c] for u in new]
        ids_of = dict(self.control) | self._new(list({c for p in pieces for c in p} - self.control.keys()))
        fresh = {u: b"".join([ids_of[c] for c in p]) for u, p in zip(new, pieces, strict=True)}
        for ids, at in zip(found, gaps, strict=True):
            for k in at:
                ids[k] = fresh[ids[k]]
        if len(self.known) < MEMO_WORDS:
            self.known.update(fresh)
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """One per worker process."""
    return Encoder(tokenizer, SparkFiles.get(lexicon) if lexicon else None)


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words of all texts, `most` at most, as the pattern writes them after a space: word, n.

    Chunks between white space are counted over all texts, partial counts in each task, all
    of them added up by a shuffle; each distinct chunk is split into words once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter = Counter()

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.binary()), pa.array(list(chunks.values()), pa.int64())], ["chunk", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                chunks.update((text.as_py() or b"").split())
                if len(chunks) > COUNTED:
                    yield report()
                    chunks.clear()
        yield report()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in PATTERN.findall(f" {chunk.decode()}"):
                    words[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    chunks = docs.select("text").mapInArrow(count, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = cut(chunks.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # A histogram of counts tells from which count on the words fit, so no task sends a list
    # of its own to the driver: 64 steps for each doubling, some thousand rows. The step that
    # fits in part is filled up by a hash of the word.
    step, share = F.floor(F.log2("n") * 64), F.pmod(F.xxhash64("word"), F.lit(FILL))
    sizes = {r.step: r.words for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    held, least = 0, None
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > most:
            break
        held, least = held + sizes[k], k
    else:
        return counted
    part = counted.where(step == k).groupBy(share.alias("share")).agg(F.count("*").alias("words")).collect()  # FILL rows at most
    upto = -1
    for r in sorted(part, key=lambda r: r.share):
        if held + r.words > most:
            break
        held, upto = held + r.words, r.share
    whole = F.lit(False) if least is None else step >= least
    return counted.where(whole | ((step == k) & (share <= upto)))


def publish_lexicon(spark: SparkSession, words: Sequence[str], tokenizer: str) -> str:
    """Compiles the words and ships the file; returns the name under which tasks find it."""
    raw = sorted({w.encode() for w in words if w})
    ids, begins = merger(tokenizer).encode(raw)
    data = compile_lexicon({w: ids[begins[k] : begins[k + 1]] for k, w in enumerate(raw)})
    name = f"lexicon-{hashlib.sha256(data.tobytes()).hexdigest()[:24]}.npy"
    if not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="spark-lexicon-"), name)
        np.save(path, data)
        spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, lexicon)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for part in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), AT_ONCE):
                texts = column.slice(part.start, part.stop - part.start).to_pylist()
                ids = encoder.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                own = [batch.column(k).slice(part.start, len(ids)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), values)], [*keep, "ids"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """`encoded` with ids replaced by the decoded text (null ids: empty)."""
    keep = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = merger(tokenizer).token_bytes
        for batch in batches:
            texts = []
            for ids in batch.column(batch.num_columns - 1):
                values = ids.values.to_numpy().tolist() if ids.is_valid else []
                texts.append(b"".join(map(parts.__getitem__, values)).decode("utf-8", "replace"))
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], [*keep, "text"])

    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return encoded.select(*keep, "ids").mapInArrow(run, schema)
