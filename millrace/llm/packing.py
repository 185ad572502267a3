"""Best-fit packing of tokenized documents into training sequences.

Bounded-space online best-fit: each task keeps a fixed number of open sequences. A document goes to the open
sequence whose free space is smallest among those that still hold it. Open sequences are found through one
integer used as a bitset: bit f is set while some open sequence has f tokens free, so the best fit is the lowest
set bit at or above the document's length. When one more sequence would exceed the bound, the fullest closes.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import byte_of_char
from .common import map_batches, without_gc

SEQUENCE_TOKENS = 2048
OPEN_SEQUENCES = 4096
#: Documents of a window, and bytes of their ids after which it ends early.
WINDOW, WINDOW_BYTES = 2000, 32 << 20
#: What a worker remembers of chunks (between spaces) and of pieces, before it starts afresh.
REMEMBER = 600_000
#: Fixed value: the word-level tokenizer's own split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Bins:
    """Open sequences by free space. `place` returns (sequence number, offset)."""

    def __init__(self, size: int, bound: int):
        self.size, self.bound = size, bound
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        if n >= self.size:
            self.made += 1
            return self.made - 1, 0
        fits = self.bits >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            k = self._take(f)
        else:
            if self.open >= self.bound:
                low = self.bits & -self.bits
                self._take(low.bit_length() - 1)
            k, f = self.made, self.size
            self.made += 1
        if f > n:
            self.free[f - n].append(k)
            self.bits |= 1 << (f - n)
            self.open += 1
        return k, self.size - f

    def _take(self, f: int) -> int:
        k = self.free[f].pop()
        self.open -= 1
        if not self.free[f]:
            self.bits &= ~(1 << f)
        return k


class WordTokens:
    """Ids of whole texts by the word-level tokenizer at `path`, as little-endian unsigned 32-bit integers.

    Blanks separate the tokenizer's words and vanish, so a text's ids are those of its chunks between spaces and
    line ends, one after the other, and each distinct chunk is encoded once. Chunks of Latin letters are lower-cased and
    split here and go to the tokenizer's model; any other chunk takes the tokenizer's whole route.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        char = {b: c for c, b in byte_of_char().items()}
        self.table = [char[b] for b in range(256)]
        self.split = regex.compile(SPLIT)
        self.latin = re.compile(r"[\t-\r -~À-ÿ]*\Z").match  # lower case and NFC change these one by one
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.remember = remember
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def _word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            shown = w if w.isascii() and w.isprintable() else "".join(map(self.table.__getitem__, w.encode()))
            ids = self.words[w] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        return ids

    def _chunk(self, c: str) -> bytes:
        if self.latin(c) and not ("<" in c and any(s in c for s in self.specials)):
            low = c.lower()
            if low.isalpha():
                return self._word(low)
            if low[-1] in ".,!" and low[:-1].isalpha():
                return self._word(low[:-1]) + self._word(low[-1])
            return b"".join(map(self._word, self.split.findall(low)))
        return np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        chunks = self.chunks
        parts = text.replace("\n", " ").split(" ")
        got = list(map(chunks.get, parts))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    c = parts[i]
                    v = chunks.get(c)
                    if v is None:
                        v = chunks[c] = self._chunk(c)
                    got[i] = v
            if len(chunks) > self.remember:
                self.chunks = {"": b""}
            if len(self.words) > self.remember:
                self.words = {}
        return b"".join(got)


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per Python worker."""
    return WordTokens(path)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, open_sequences: int = OPEN_SEQUENCES, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize each text, end it with `end_id`, and pack the documents into sequences of at most `size` tokens.

    Returns one row per piece: `id_col`, piece (from 0), start (ids of its document before it), length, ids_crc32
    (of the little-endian unsigned 32-bit ids), sequence_id, offset, and with `with_ids` also ids (array<int>).
    Only a document of more than `size` ids is cut, into full pieces and a rest.

    A null text counts as empty and is one piece of one id. A row is one document, also if its id repeats or is null.
    Sequences are numbered by task and then in order, so that a repeated task gives the same numbers; a task leaves at
    most `open_sequences` of them unfilled, and a closed sequence is never opened again. Other columns of the input
    are left out, whatever their names. An empty input gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = word_tokens(path), Bins(size, open_sequences)
        first = TaskContext.get().partitionId() << 40
        names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: 7 + with_ids]
        kinds = [None, pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())][: len(names)]

        def place(window: list[tuple]) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in names]
            for doc, piece, own in sorted(window, key=lambda w: -len(w[2])):
                k, offset = bins.place(len(own) // 4)
                values = [doc, piece, piece * size, len(own) // 4, zlib.crc32(own), first + k, offset]
                if with_ids:
                    values.append(np.frombuffer(own, "<i4"))
                for col, v in zip(rows, values, strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

        for b in batches:
            kinds[0] = b.schema.field(0).type
            window, docs, held = [], 0, 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                window += [(doc, piece, ids[at : at + step]) for piece, at in enumerate(range(0, len(ids), step))]
                docs, held = docs + 1, held + len(ids)
                if docs >= WINDOW or held >= WINDOW_BYTES:
                    yield place(window)
                    window, docs, held = [], 0, 0
            if window:
                yield place(window)

    kind = df.schema[id_col].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    out = map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("t")), without_gc(run), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint{more}")
    return out.withColumnRenamed("id", id_col)
