"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The merges of a BPE vocabulary give each string exactly one encoding, and any prefix of it is encoded by a
prefix-closed rule: if t is the last token of the encoding of s[:i], the rest of that encoding is the encoding
of s[:i-len(t)]. So one token per prefix, its last one, is all there is to store. For each end i the automaton of
reversed tokens gives every vocabulary entry that is a suffix of s[:i]; exactly one of them goes together with the
stored last token of the shorter prefix, where two tokens go together if BPE leaves their concatenation as just
these two. Following the stored tokens back from the end gives the ids.

All pieces of a batch run side by side: column i of the tables below is the i-th prefix of every piece.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_bytes, map_batches, sha256, without_gc

#: Fixed values of the byte-level pre-tokenizer: its split pattern, and the printable stand-ins of bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Letters and numbers of Unicode versions after the one that the tokenizer library has.
NEWER = "[\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6]"

#: Pieces of more bytes than this take the one-by-one route; the tables of a batch are as wide as its longest piece.
WIDE = 40
#: Distinct pieces whose ids a worker remembers before it starts afresh.
REMEMBER = 600_000


def byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the merge that makes each, and the automaton of reversed tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**model["vocab"], **self.special}
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.bytes[k] = bytes(of[c] for c in name) if name not in self.special else name.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        # a token is usable if BPE of its own bytes gives it back: its parts come from the first merge that makes it
        self.parts: dict[int, tuple[int, int]] = {}
        for (a, b), k in self.made.items():
            self.parts.setdefault(k, (a, b))
        self.single = np.full(256, -1, np.int64)
        for k, t in enumerate(self.bytes):
            if len(t) == 1 and k not in self.special.values():
                self.single[t[0]] = k
        self._automaton()
        self.pairs: dict[int, bool] = {}
        self.codes, self.fits = np.array([-1], np.int64), np.array([False])

    def _automaton(self) -> None:
        """Trie of reversed tokens, level by level, as sorted keys node * 256 + byte."""
        special = set(self.special.values())
        live = [k for k, t in enumerate(self.bytes) if t and k not in special]
        ids = np.array(live)
        lens = np.array([len(self.bytes[k]) for k in live])
        width = int(lens.max())
        back = np.zeros((len(live), width), np.int64)
        for row, k in enumerate(live):
            t = self.bytes[k][::-1]
            back[row, : len(t)] = np.frombuffer(t, np.uint8)
        node = np.zeros(len(live), np.int64)
        keys, nodes, n = [], [], 1
        ends: dict[int, int] = {}
        for d in range(width):
            on = lens > d
            key = node[on] * 256 + back[on, d]
            new, inv = np.unique(key, return_inverse=True)
            keys.append(new)
            nodes.append(np.arange(n, n + len(new)))
            node[on] = n + inv
            n += len(new)
            for row in np.nonzero(lens == d + 1)[0]:
                ends[int(node[row])] = int(ids[row])
        self.keys = np.concatenate(keys)
        order = np.argsort(self.keys)
        self.keys, self.next = self.keys[order], np.concatenate(nodes)[order]
        self.token_at = np.full(n, -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())
        self.longest = width
        # dense first step: most walks end soon
        self.first = np.full(256, -1, np.int64)
        k = np.searchsorted(self.keys, 256)
        self.first[self.keys[:k]] = self.next[:k]
        self.step = dict(zip(self.keys.tolist(), self.next.tolist(), strict=True))

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a, b next to each other: no merge across their border comes before the merges
        that build them. Undo, on either side, the latest merge that touches the border, until nothing is left."""
        code = a << 20 | b
        got = self.pairs.get(code)
        if got is not None:
            return got
        x, y, limit = a, b, 1 << 60
        rank, parts = self.rank, self.parts
        ok = True
        while True:
            r = rank.get((x, y))
            if r is not None and r < limit:
                ok = False
                break
            rx = rank[parts[x]] if x in parts else -1
            ry = rank[parts[y]] if y in parts else -1
            if rx < 0 and ry < 0:
                break
            # the merge made last is undone first; of equal ones, the right one was made last
            if rx > ry:
                limit, x = rx, parts[x][1]
                if limit == 0:
                    break
            else:
                # a merge to the right of the border with the same rank comes after one across it
                limit, y = ry + 1, parts[y][0]
        self.pairs[code] = ok
        return ok

    def encode_one(self, piece: bytes) -> list[int]:
        """The same recurrence for one piece of any length; memory in proportion to it."""
        n = len(piece)
        last = [-1] * (n + 1)
        for i in range(1, n + 1):
            at, d = 0, 0
            while d < i:
                at = self.step.get(at * 256 + piece[i - 1 - d], -1)
                if at < 0:
                    break
                d += 1
                t = int(self.token_at[at])
                if t >= 0 and (d == i or (last[i - d] >= 0 and self.compatible(last[i - d], t))):
                    last[i] = t
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return out[::-1]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if 0 < len(p) <= WIDE]
        for k, p in enumerate(pieces):
            if len(p) > WIDE:
                out[k] = np.array(self.encode_one(p), "<u4").tobytes()
        short.sort(key=lambda k: len(pieces[k]))
        for lo in range(0, len(short), 20_000):
            self._block(short[lo : lo + 20_000], pieces, out)
        return out

    def _block(self, which: list[int], pieces: list[bytes], out: list[bytes]) -> None:
        lens = np.array([len(pieces[k]) for k in which])
        m, width = len(which), int(lens.max())
        flat = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in which]), np.uint8).reshape(m, width).astype(np.int64)
        # matches[d-1][row, i]: the token of d bytes that ends before i, or -1
        matches = []
        row, end = np.nonzero(np.arange(width) < lens[:, None])
        at = self.first[flat[row, end]]
        for d in range(1, width + 1):
            found = np.full((m, width + 1), -1, np.int32)
            found[row, end + 1] = self.token_at[at]
            matches.append(found)
            on = end >= d
            row, end, at = row[on], end[on], at[on]
            if not len(row):
                break
            key = at * 256 + flat[row, end - d]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            row, end, at = row[on], end[on], self.next[k[on]]
            if not len(row):
                break
        last = np.full((m, width + 1), -1, np.int64)
        for i in range(1, width + 1):
            for d in range(min(i, len(matches)), 0, -1):
                t = matches[d - 1][:, i]
                rows = np.nonzero((t >= 0) & (last[:, i] < 0))[0]
                if not len(rows):
                    continue
                if d == i:
                    last[rows, i] = t[rows]
                    continue
                before = last[rows, i - d]
                rows, before = rows[before >= 0], before[before >= 0]
                last_ok = self._fit(before, t[rows])
                last[rows[last_ok], i] = t[rows[last_ok]]
        # back-pointers: fill ids from the right
        ids = np.zeros((m, width), "<u4")
        pos, used = lens.copy(), np.zeros(m, np.int64)
        size = self._sizes
        rows = np.arange(m)
        while len(rows):
            t = last[rows, pos[rows]]
            used[rows] += 1
            ids[rows, width - used[rows]] = t
            pos[rows] -= size[t]
            rows = rows[pos[rows] > 0]
        raw = ids.tobytes()
        line = 4 * width
        for r, (k, u) in enumerate(zip(which, used.tolist(), strict=True)):
            out[k] = raw[(r + 1) * line - 4 * u : (r + 1) * line]

    @functools.cached_property
    def _sizes(self) -> np.ndarray:
        return np.array([len(t) for t in self.bytes])

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() for arrays. Answers stay in sorted arrays, so that only pairs never seen before cost Python time."""
        code, inv = np.unique(a << 20 | b.astype(np.int64), return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        new = self.codes[at] != code
        if new.any():
            fresh = code[new]
            self.codes = np.concatenate([self.codes, fresh])
            self.fits = np.concatenate([self.fits, np.array([self.compatible(c >> 20, c & 0xFFFFF) for c in fresh.tolist()], bool)])
            order = np.argsort(self.codes, kind="stable")
            self.codes, self.fits = self.codes[order], self.fits[order]
            at = np.searchsorted(self.codes, code)
        return self.fits[at][inv]


class Codec:
    """Whole texts to ids and back, as the byte-level tokenizer file at `path` defines them."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT)
        self.newer = regex.compile(NEWER)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces. Letters younger than its Unicode tables count as symbols."""
        if self.newer.search(text) is None:
            return self.split.findall(text)
        out, i = [], 0
        for p in self.split.findall(self.newer.sub("\u2603", text)):
            out.append(text[i : i + len(p)])
            i += len(p)
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Distinct pieces are encoded once for all texts.

        A space before a visible character always starts a piece, so texts fall into chunks at their spaces, and
        a chunk's ids do not depend on its neighbours. Where blanks meet (an empty chunk, or one that begins with
        a blank) this fails, and the text is split as a whole.
        """
        special = self.vocabulary.special
        for s, k in special.items():
            self.known[s] = np.array([k], "<u4").tobytes()
        get = self.chunks.get
        plain = [t.isascii() or self.newer.search(t) is None for t in texts]
        plain = [ok and not any(s in t for s in special) for ok, t in zip(plain, texts, strict=True)]
        parts = [t.split(" ") if ok else [] for ok, t in zip(plain, texts, strict=True)]
        found = [list(map(get, p)) for p in parts]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else [] for f in found]
        missing = {p[i] for p, g in zip(parts, gaps, strict=True) for i in g if i}
        odd = {c for c in missing if not c or c[0].isspace()}
        missing -= odd
        cut = {c: self.split.findall(" " + c) for c in missing}
        whole: dict[int, list[str]] = {}
        for k, t in enumerate(texts):
            if not plain[k]:
                whole[k] = [p for x in (self.special.split(t) if self.special else [t]) for p in ([x] if x in special else self.pieces(x))]
            elif odd and not odd.isdisjoint(parts[k][1:]):
                whole[k] = self.split.findall(t)
        heads = [self.split.findall(p[0]) if p else [] for p in parts]
        self._learn({p for ps in cut.values() for p in ps} | {p for ps in heads for p in ps} | {p for ps in whole.values() for p in ps})
        ids, chunks, out = self.known.__getitem__, self.chunks, []
        for c, ps in cut.items():
            chunks[c] = b"".join(map(ids, ps))
        for k, (p, f, g) in enumerate(zip(parts, found, gaps, strict=True)):
            if k in whole:
                out.append(b"".join(map(ids, whole[k])))
                continue
            for i in g:
                if i:
                    f[i] = chunks[p[i]]
            f[:1] = map(ids, heads[k])
            out.append(b"".join(f))
        if len(self.known) > REMEMBER:
            self.known = {}
        if len(chunks) > REMEMBER:
            self.chunks = {}
        return out

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again: `id_col`, n_tokens, ids_sha256, decoded_sha256, and with
    `with_ids` also ids (array<long>) and decoded.

    A null text counts as empty: no tokens, the digests of nothing. A text is never cut; its pieces are taken from
    the whole of it. Rows, repeated ones too, come out one for one; other columns of the input are left out,
    whatever their names. An empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, a, d, raw, back = [], [], [], [], []
            for lo, hi in by_bytes(texts, 8 << 20):
                for ids in c.encode(texts[lo:hi]):
                    text = c.decode(ids)
                    n.append(len(ids) // 4)
                    a.append(sha256(ids))
                    d.append(sha256(text.encode()))
                    if with_ids:
                        raw.append(np.frombuffer(ids, "<u4").astype(np.int64))
                        back.append(text)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                cols += [pa.array(raw, pa.list_(pa.int64())), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    kind = df.schema[id_col].dataType.simpleString()
    more = ", ids array<bigint>, decoded string" if with_ids else ""
    out = map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("t")), without_gc(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)
