import pytest
from pyspark.sql import functions as F

from millrace.functions import similarity as sim
from millrace.functions import text


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("LED Monitor &lt;br&gt; 24inch", "led monitor  24inch"),  # only the first run of blanks shrinks
        ("A &amp;lt;b&gt;c", "a c"),  # decoded twice, then a tag
        ("x <a>y</a> z", "x y z"),
        ("x <a>y</a> <b>z", "x y <b>z"),
        ("Cable &#x2013; 6ft – A", "cable - 6ft - a"),
        ("  Two   words  ", "two   words"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, clean):
    assert value(spark, text.clean_text(F.lit(raw).cast("string"))) == clean


def test_hints_and_rules(spark):
    assert value(spark, text.charge_hint(F.lit("6 Feet Cable")))  # a part of a word is enough
    assert not value(spark, text.charge_hint(F.lit("Keyboard")))
    assert not value(spark, text.charge_hint(F.lit(None).cast("string")))
    rules = (("Keyboards", ("keyboard", "kb")), ("Cables", ("wire",)))
    assert value(spark, text.first_rule(F.lit("Wireless KB"), rules, "Other")) == "Keyboards"
    assert value(spark, text.first_rule(F.lit(None).cast("string"), rules, "Other")) == "Other"


def test_keys_and_versions(spark):
    assert value(spark, text.surrogate_key(F.lit("CC_AU_000"))) == "31d724c16fa4adf50550ce6293058b90"
    assert value(spark, text.joined(F.lit("a"), F.lit(None).cast("string"), F.lit(3))) == "a||3"
    assert tuple(value(spark, text.semver(F.lit("v1.12")))) == (1, 12)
    assert tuple(value(spark, text.semver(F.lit("v3")))) == (3, 0)
    assert tuple(value(spark, text.semver(F.lit("1.2")))) == (0, 0)
    assert tuple(value(spark, text.semver(F.lit(None).cast("string")))) == (0, 0)
    assert text.normalized_names([" Final  SKU Name", "Decision"]) == ["final_sku_name", "decision"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_functions():
    import random

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert sim.lcs(a, b) == slow_lcs(a, b)
        if a and b:
            short, long = sorted((a, b), key=len)
            n = len(short)
            best = max(sim.ratio(short, long[max(i, 0) : i + n]) for i in range(1 - n, len(long)))
            if len(a) != len(b):
                assert sim.partial_ratio(a, b) == pytest.approx(best)
    assert sim.ratio("", "") == 100
    assert sim.token_sort_ratio("b a", "a b") == 100
    assert sim.partial_token_set_ratio("usb cable", "cable black") == 100
    assert sim.partial_token_set_ratio("", "x") == 0
    assert sim.partial_token_ratio("abc", "xabcx") == 100


def test_similarity_column(spark):
    df = spark.createDataFrame([("usb cable", "cable 2m"), ("keybord", "keyboard"), (None, "x"), ("a", None)], "a string, b string")
    for name, f in sim.SCORES.items():
        got = [r[2] for r in df.select("a", "b", sim.similarity(name, F.col("a"), F.col("b"))).collect()]
        assert got == pytest.approx([f(a or "", b or "") for a, b in [("usb cable", "cable 2m"), ("keybord", "keyboard"), (None, "x"), ("a", None)]])
