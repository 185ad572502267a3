"""One text of 50 MB: each operator's Python takes it whole, within a gigabyte."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import langid, near_dedup, quality_cnn

HEAD = """
import resource, sys
import numpy as np
from millrace.llm import langid, near_dedup, quality_cnn, suffix_dedup
from tests.llm.test_long_texts import MODEL, NET
rng = np.random.default_rng(1)
text = rng.choice(np.frombuffer(b"abcdefgh     ", np.uint8), 50_000_000).tobytes()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
WORK = {
    "op1": "p = MODEL().probabilities([text]); assert abs(p.sum() - 1) < 1e-9",
    "op4": "p = quality_cnn.score(NET(), [text]); assert 0 <= p[0] <= 1",
    "op7": "n = sum(len(suffix_dedup.Pass(part).contexts()[0]) for part, _, _ in suffix_dedup._split_long([text], 0, 1)); assert n > 100_000",
    "op9": "h = near_dedup.shingle_hashes([text])[0]; assert len(near_dedup.signature(h)) == near_dedup.VALUES",
}


def MODEL():
    return langid.train([("the and of with that was", "en"), ("der die das und über", "de")] * 20)


def NET():
    return quality_cnn.train([("fine words in a row " * 8, 1), ("### %%% $$$ &&& " * 9, 0)] * 15, 0.4, epochs=2)


@pytest.mark.parametrize("name", WORK)
def test_memory(name):
    code = HEAD + WORK[name] + "\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e6)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 1


@pytest.mark.parametrize("n", [0, 1, 7, 40, 400])
@pytest.mark.parametrize("size", [7, 64, 1000])
def test_passes_give_the_same(monkeypatch, n, size):
    rng = np.random.default_rng(n)
    text = " ".join(rng.choice(["the", "über", "日本", "###", "x" * 40], n)).encode()
    model, net = MODEL(), NET()
    whole = model.logits([text]), quality_cnn.score(net, [text]), near_dedup.shingle_hashes([text, b" b c"])
    monkeypatch.setattr(langid, "PASS_BYTES", size)
    monkeypatch.setattr(quality_cnn, "PASS_SEGMENTS", max(1, size // 30))
    monkeypatch.setattr(near_dedup, "PIECE", size)
    assert np.allclose(model._long(text), whole[0])
    assert np.allclose(quality_cnn._score_long(net, text), whole[1], atol=1e-5)
    assert all(np.array_equal(a, b) for a, b in zip(near_dedup.shingle_hashes([text, b" b c"]), whole[2], strict=True))


def test_training_on_a_long_text_is_bounded():
    """The driver trains; a long text in the sample must not cost it a multiple of a hundred bytes per byte."""
    rows = [("good words " * 50, 1), ("bad " * 20, 0), ("words of a long text " * 400_000, 1)]
    tracemalloc.start()
    try:
        net = quality_cnn.train(rows, 0.5, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * len(rows[2][0])
    assert all(np.isfinite(w).all() for w in net.weights())
