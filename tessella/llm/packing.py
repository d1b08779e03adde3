"""Packing by power-of-two decomposition (operator 2).

A document's ids are cut into pieces of binary lengths: as many of ``max_len`` as fit, then one for each bit of the
rest. A piece is a sequence of its own, and sequences are bucketed by equal length, so a batch of one bucket needs no
padding and no sequence crosses documents. Nothing moves between partitions: the only state is a cache of words' ids,
bounded in entries, so the plan is one narrow stage that a lost executor repeats with the same result.

Words are cached because the tokenizer drops white space and never joins across it: the ids of a text are those of its
parts between ASCII white space, one after another.

Defined results: a null text is empty; every document ends with ``end_id``, so the empty one is one piece of length 1;
null and repeated ids are each kept as rows; texts of any length are tokenized whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, map_arrow

#: Entries and bytes of a word in the cache of a Python worker; a longer word is tokenized each time.
CACHE_WORDS = 800_000
CACHE_BYTES = 64
#: What may follow the letters of a word as one run of marks.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class WordIds:
    """Ids of white-space-parted words as little-endian unsigned 32-bit bytes, from a bounded cache."""

    def __init__(self, tokenizer_path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.cache_words = self.tokenizer.model, cache_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def text(self, text: bytes) -> bytes:
        w = text.split()
        young = self.young
        try:
            return b"".join([young[x] for x in w])
        except KeyError:
            self.learn([x for x in dict.fromkeys(w) if x not in young])
        out = b"".join([young[x] for x in w])
        for x in [x for x in set(w) if len(x) > CACHE_BYTES]:
            del young[x]
        if len(young) > self.cache_words // 2:  # words in use move from old to young again
            self.old, self.young = young, {}
        return out

    def learn(self, missing: list[bytes]) -> None:
        found = {x: self.old[x] for x in missing if x in self.old}
        self.young.update(found)
        hard = []
        for x in missing:
            if x not in found:
                word = x.decode()
                if max(word) < "\u0100":
                    word = word.lower()
                    letters = word.rstrip(MARKS)
                    if letters.isalpha():
                        self.young[x] = self.part(letters) + (self.part(word[len(letters) :]) if len(letters) < len(word) else b"")
                        continue
                hard.append(x)
        for x, e in zip(hard, self.tokenizer.encode_batch_fast([x.decode() for x in hard], add_special_tokens=False)):
            self.young[x] = np.array(e.ids, "<u4").tobytes()

    def part(self, letters: str) -> bytes:
        """Ids of a run of lower-case Latin-1 letters, or of marks. Such text is its own normal form and one pre-token, so
        the tokenizer's model is asked directly, which spares most of a call's cost."""
        key = letters.encode()
        ids = self.young.get(key) or self.old.get(key)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(key.decode("latin-1").translate(BYTE_LETTERS))], "<u4").tobytes()
            if len(key) <= CACHE_BYTES:
                self.young[key] = ids
        return ids


_WORKER: dict[tuple[str, int], WordIds] = {}


def word_ids(tokenizer_path: str, cache_words: int = CACHE_WORDS) -> WordIds:
    """One per Python worker, tokenizer and size."""
    key = (tokenizer_path, cache_words)
    if key not in _WORKER:
        _WORKER[key] = WordIds(*key)
    return _WORKER[key]


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Binary lengths that sum to n, none above ``max_len`` (a power of two), long ones first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, *, max_len: int = 4096, end_id: int = 2, cache_words: int = CACHE_WORDS, keep_cache: bool = True) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset, bucket): one row per piece.

    ``ids`` holds little-endian unsigned 32-bit ids; ``bucket`` is log2 of the sequence's length. ``sequence_id`` is unique
    over the result; it follows from the partition and the row's place in it. ``cache_words`` bounds each Python worker's memory
    (about 0.2 KB a word) and changes no result; without ``keep_cache`` a worker forgets its words after each partition.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch)
        if not keep_cache:
            _WORKER.clear()

    def cut(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path, cache_words)
        end = np.array([end_id], "<u4").tobytes()
        out = []
        for part in byte_chunks(batch, 8 << 20):
            row, start, length, total, pieces = [], [], [], [], []
            for i, t in enumerate(part.column("text").cast(pa.large_binary())):
                ids = ids_of.text(t.as_py() or b"") + end
                n, at = len(ids) // 4, 0
                for size in piece_lengths(n, max_len):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    pieces.append(ids[4 * at : 4 * (at + size)])
                    at += size
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(pieces, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"]))
        return out

    pieces = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut_all, "doc_id long, start long, length long, ids binary, doc_tokens long", stream=True)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))
