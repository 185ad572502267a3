"""op3, op8 and op10 as registered, over all documents of the smallest table, against plain Python."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import quality_rules, queries
from tests.llm.test_dedup import docs_of, mcd_reference, rules

SF = "/root/testdata/sf0.001"


def encoder(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_packing(spark):
    tokenizer = encoder("word_bpe_49k.json")
    want = {}
    for doc, text in docs_of(spark):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece in range(-(-len(ids) // 2048)):
            part = ids[piece * 2048 : (piece + 1) * 2048]
            want[doc, piece] = (piece * 2048, len(part), zlib.crc32(part.tobytes()))
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    assert len(rows) == len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    # no two sequences of a task that are less than half full: best fit would have joined them
    tasks = collections.Counter(k >> 40 for k, parts in sequences.items() if 2 * sum(n for _, n in parts) <= 2048)
    assert max(tasks.values(), default=0) <= 1


def test_codec(spark):
    tokenizer = encoder("byte_bpe_50k.json")
    want = {}
    for doc, text in docs_of(spark):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe_codec(spark, SF).collect()} == want


def thousandths(x):
    return math.floor(1000 * x + 0.5)


def test_rules(spark):
    """Base counts, groups, estimates, distances and verdicts."""
    q = quality_rules
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    base = {r.doc_id: rules(r.text) for r in rows}
    vector = {}
    for d, (n, chars, symbols, lines, repeats, failed) in base.items():
        if not failed:
            vector[d] = [thousandths(v) for v in (math.log(n), math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(lines / n), math.sqrt(repeats / (6 * n)))]
    place = {r.doc_id: (r.lang, r.source) for r in rows}
    size = collections.Counter(place[d] for d in vector)
    pooled = lambda d: place[d] if size[place[d]] >= q.MIN_GROUP else (place[d][0], "*")
    in_pool, in_lang = collections.Counter(map(pooled, vector)), collections.Counter(place[d][0] for d in vector)
    measure = {d: pooled(d) if in_pool[pooled(d)] >= q.MIN_GROUP else (place[d][0], "+") if in_lang[place[d][0]] >= q.MIN_GROUP else ("+", "+") for d in vector}
    holds = {
        m: [d for d in vector if m == ("+", "+") or (m == (place[d][0], "+")) or m == pooled(d)] for m in set(measure.values())
    }
    estimate = {m: mcd_reference(np.array([vector[d] for d in ds], float), q.STEPS, q.FLOORS) for m, ds in holds.items()}
    cutoff = {}
    for m, ds in holds.items():
        _, mean, cov = estimate[m]
        off = np.array([vector[d] for d in ds], float) - mean
        mid, upper = np.percentile(np.round(np.cbrt(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)), 3), [50, 75])
        cutoff[m] = (max(mid, q.CUBE_MEAN) + q.EXTREME * max((upper - mid) / q.QUARTILE, q.CUBE_SPREAD)) ** 3
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, SF).collect()}
    assert list(next(iter(got.values())).asDict())[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {d: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for d, r in got.items()} == base
    for d, r in got.items():
        if base[d][5]:
            assert r.distance is None and not r.kept
            continue
        _, mean, cov = estimate[measure[d]]
        off = np.array(vector[d], float) - mean
        want = off @ np.linalg.inv(cov) @ off
        assert r.distance == pytest.approx(want, rel=1e-3, abs=1e-3)
        assert r.cutoff == pytest.approx(cutoff[measure[d]], rel=1e-2)
        assert r.kept == (r.distance <= r.cutoff)
    assert {r.kept for r in got.values() if not r.base_failed} == {True, False}
