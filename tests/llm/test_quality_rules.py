"""The quality rules judge every row that passes the base rules, whatever the size of its group."""

import random

from millrace.llm import quality_rules
from tests.llm.test_dedup import words

SCHEMA = "doc_id long, text string, lang string, source string"


def junk(rng):
    return " ".join(w + "###$$$" for w in words(rng, 200).split())


def test_few_rows_beside_a_large_source_are_judged(spark):
    """20 rows in small sources of a language with a large one, and a language of five rows."""
    rng = random.Random(6)
    rows = [(k, words(rng, rng.randrange(60, 400)), "en", "a") for k in range(200)]
    rows += [(300 + k, words(rng, rng.randrange(60, 400)), "en", f"s{k % 4}") for k in range(20)] + [(400, junk(rng), "en", "s1")]
    rows += [(500 + k, words(rng, rng.randrange(60, 400)), "xx", "a") for k in range(5)] + [(600, junk(rng), "xx", None)]
    got = quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(r.distance is not None for r in got if not r.base_failed)
    assert {r.doc_id for r in got if not r.kept} == {400, 600}


def test_a_table_of_few_rows_is_judged(spark):
    rng = random.Random(7)
    rows = [(k, words(rng, rng.randrange(60, 400)), "en", "a") for k in range(15)] + [(100, junk(rng), "de", "b")]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.distance is not None for r in got.values()) and [k for k, r in got.items() if not r.kept] == [100]
    one = quality_rules.assess(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert one.kept and one.distance == 0


def letters(rng, n, size):
    """n words of about `size` letters."""
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(max(1, size + rng.randrange(-1, 2)))) for _ in range(n))


def test_the_groups_own_spread_decides(spark):
    """One text with long words: extreme where words are alike in length, ordinary where they are not. A distance with fixed
    spreads, whatever they are, would judge it alike."""
    rng = random.Random(8)
    rows = [(k, letters(rng, rng.randrange(60, 400), 6), "en", "tight") for k in range(150)]
    rows += [(1000 + k, letters(rng, rng.randrange(60, 400), rng.randrange(3, 10)), "en", "wide") for k in range(150)]
    long = letters(rng, 150, 9)
    rows += [(2000, long, "en", "tight"), (2001, long, "en", "wide")]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2000].kept, got[2001].kept) == (False, True)
    assert got[2000].distance > 10 * got[2001].distance
    assert all(got[k].kept for k in got if k != 2000)


def test_what_goes_together_in_a_group_decides(spark):
    """Long texts with short words and short ones with long words; a long text with long words has nothing extreme by itself."""
    rng = random.Random(9)
    rows = []
    for k in range(150):
        n = rng.randrange(60, 600)
        mean = 9 * (n / 60) ** -0.5
        rows.append((k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=int(mean + rng.random()))) for _ in range(n)), "en", "a"))
    rows += [(1000, letters(rng, 550, 6), "en", "a")]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[1000].kept and sum(not r.kept for r in got.values()) <= 2
