"""The corpus pipeline stage by stage against plain Python on the smallest documents."""

import random

import corpus_pipeline
from tests.llm.test_dedup import groups, removed, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == columns or name == "best_fit_packing"
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        seen.append(name)
        if name == "minhash_near_dedup":
            assert ids == {d for d, g in groups(list(before.items())).items() if g[2]}
            assert all(r.text == before[r.doc_id] for r in rows)
        elif name == "suffix_array_dedup":
            keys = list(before)
            left = {d: n - gone for d, (n, gone, *_) in zip(keys, removed([before[d] for d in keys]), strict=True)}
            assert ids == set(before) and all(len(r.text.encode()) <= left[r.doc_id] <= len(r.text.encode()) + 9 for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "best_fit_packing":
            assert ids == set(before)
        else:
            assert ids <= set(before) and all(r.text == before[r.doc_id] for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    assert len(seen) == 5
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


CLASHES = ("id", "t", "k1", "k2", "text_hash", "n_words", "kept", "distance", "in_0", "doc", "rep", "spans", "score", "x0")


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, an empty and a long text, and columns named as the stages' own; then no rows at all."""
    rng = random.Random(4)
    rows = [(k, words(rng, rng.randrange(60, 120)), "en", "a", None) for k in range(30)]
    rows += [rows[3], rows[3], (None, words(rng, 80), "en", "a", 3), (None, None, None, None, None), (50, "", "de", None, 0), (51, None, "de", "b", 0), (52, words(rng, 60_000), None, "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *CLASHES) for r in rows], schema).repartition(3)
    for df, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            got = out.collect()
            assert name == "best_fit_packing" or len(got) <= n
            if name == "best_fit_packing":
                assert sum(r.piece == 0 for r in got) == n
                continue
            assert out.schema.simpleString() == df.schema.simpleString()
            assert all(tuple(r[c] for c in CLASHES) == CLASHES for r in got)
            if n:
                kept = {"quality_rules": 33, "minhash_near_dedup": 35, "suffix_array_dedup": 37}.get(name)
                assert kept is None or len(got) == kept, name
