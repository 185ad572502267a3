"""A query string counts to its end, however long it is."""

from pyspark.sql import functions as F

from millrace.llm import warc


def test_long_queries_that_differ_at_the_end(spark):
    long = F.concat(F.lit("http://h/p?a="), F.repeat(F.lit("x"), F.lit((1 << 20) + 10)))
    row = spark.range(1).select(warc.canonical_url(F.concat(long, F.lit("1"))).alias("a"), warc.canonical_url(F.concat(long, F.lit("2"))).alias("b"), warc.canonical_url(F.lit("http://h/p?")).alias("c"))
    got = row.select(F.col("a") == F.col("b"), F.length("a"), "c").first()
    assert tuple(got) == (False, len("h/p?a=") + (1 << 20) + 11, "h/p")
