"""Matching names by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.similarity import similarity
from millrace.functions.text import normalize_text
from millrace.held import held
from millrace.operators.edits import close_pairs  # noqa: F401  a join of names like the others here
from millrace.operators.nearest import bare, contained, counted, grams, nearest

#: Abbreviations that stand for a vendor, compared exactly.
ABBREVIATIONS = {
    "VM": "ViewMaster Corporation", "CP": "ConnectPro Corporation", "DV": "DataVault Corporation", "TF": "TechFlow Corporation", "PC": "ProConnect Corporation", "OL": "OfficeLink Corporation",
}
CUTOFF = 0.6


def best_match(names: DataFrame, column: str, vendors: DataFrame, id_col: str, name_col: str, cutoff: float = CUTOFF, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """One row per distinct name: matched_vendor_id, matched_vendor_name, vendor_fuzz_score (0 to 1).

    A blank name matches nothing, with score 0. An abbreviation stands for its vendor with score 1. Otherwise the most similar
    vendor counts from `cutoff` on; below, only the score stays. Ties go to the smallest id. Names are made distinct
    first, so scoring depends on the number of different names, not of rows; vendors that share a normalized name are
    one candidate.
    """
    short = ABBREVIATIONS if abbreviations is None else abbreviations
    raw = F.col("raw")
    distinct = names.select(F.col(column).alias("raw")).distinct()
    known = vendors.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), normalize_text(F.col(name_col)).alias("norm"))
    known = known.groupBy("norm").agg(F.min_by(F.struct("id", "name"), "id").alias("v")).select("norm", "v.*")
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair]) if short else F.create_map().cast("map<string,string>")
    blank = raw.isNull() | (F.trim(raw) == "")
    marked = distinct.withColumns({"full": table[raw], "blank": blank})
    direct = marked.where("full is not null").withColumn("norm", normalize_text(F.col("full"))).join(known, "norm", "left").select("raw", F.col("id").alias("matched_vendor_id"), F.col("full").alias("matched_vendor_name"), F.lit(1.0).alias("vendor_fuzz_score"))
    empty = marked.where("blank").select("raw", F.lit(None).cast("string").alias("matched_vendor_id"), F.lit(None).cast("string").alias("matched_vendor_name"), F.lit(0.0).alias("vendor_fuzz_score"))
    open_ = held(marked.where("not blank and full is null").select("raw", normalize_text(raw).alias("q")))
    # a shared token makes the score 1: the smallest vendor of each token, then of the name's tokens
    token = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))).alias("token")
    of_token = known.select("id", "name", token("norm")).groupBy("token").agg(F.min(F.struct("id", "name")).alias("v"))
    shared = held(open_.select("raw", token("q")).join(of_token, "token").groupBy("raw").agg(F.min("v").alias("v"), F.lit(1.0).alias("s")))
    every = shared.unionByName(_nearest(open_.join(shared.select("raw", F.col("v.id").alias("below")), "raw", "left"), known))
    best = every.groupBy("raw").agg(F.max("s").alias("s"), F.min_by("v", F.struct(-F.col("s"), F.col("v.id"))).alias("v"))
    hit = F.col("s") >= cutoff
    fuzzy = best.select("raw", F.when(hit, F.col("v.id")).alias("matched_vendor_id"), F.when(hit, F.col("v.name")).alias("matched_vendor_name"), F.col("s").alias("vendor_fuzz_score"))
    return direct.unionByName(empty).unionByName(fuzzy).withColumnRenamed("raw", column)


#: Candidates of a block.
BLOCK = 2048


def _nearest(names: DataFrame, known: DataFrame) -> DataFrame:
    """names: raw, q, below. raw, v, s: the best candidate of a name, as far as shared tokens have not given it the full score; of names
    with `below`, only a candidate with a smaller id that has the full score, too."""
    asked = names.select("raw", "below", bare(F.col("q")).alias("s"))
    # candidates of one spelling score alike: the smallest id comes first
    candidates = held(known.select(bare(F.col("norm")).alias("s"), F.struct("id", "name").alias("v")).groupBy("s").agg(F.min("v").alias("v")).where("s <> ''"))
    spelled = held(asked.groupBy("s").agg(F.max(F.col("below").isNull()).alias("open"), F.max("below").alias("below")).where("s <> ''"))
    best = nearest(spelled.where("open").select("s"), candidates.select("s", F.col("v.id").alias("id")), block=BLOCK)
    within = contained(spelled.where("below is not null").select("s"), candidates.select(F.col("s").alias("c")))
    whole = within.join(candidates.select(F.col("s").alias("c"), "v"), "c")
    by_spelling = asked.where("below is not null").join(whole, "s").where(F.col("v.id") < F.col("below")).groupBy("raw").agg(F.min("v").alias("v"), F.lit(1.0).alias("s"))
    found = best.join(candidates.select(F.col("s").alias("c"), "v"), "c").select("s", "v", (F.col("score") / 100).alias("score"))
    open_ = asked.where("below is null").join(found, "s").select("raw", "v", F.col("score").alias("s"))
    # a candidate or a name without tokens is as far from everything as can be: the smallest id of all
    nothing = known.agg(F.min(F.struct("id", "name")).alias("v")).where("v is not null")
    lost = asked.where("below is null").join(open_.select("raw"), "raw", "left_anti")
    return open_.unionByName(by_spelling).unionByName(lost.crossJoin(F.broadcast(nothing)).select("raw", "v", F.lit(0.0).alias("s")))  # one row


def collect_aliases(canonical: DataFrame, names: DataFrame, canonical_col: str, name_col: str, cutoff: float = 75.0, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """For every canonical name the sorted distinct spellings that reach `cutoff` by ratio, or abbreviate it."""
    short = {v: k for k, v in (abbreviations or {}).items()}
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair]) if short else F.create_map().cast("map<string,string>")
    c, n = canonical.select(F.col(canonical_col).alias("c")).distinct(), names.select(F.col(name_col).alias("n")).where("n is not null").distinct()
    # a ratio of `cutoff` bounds the quotient of the lengths, and the letters that match nothing, of which each breaks a pair of neighbours
    least = cutoff / (200 - cutoff)
    near = (F.col("m") >= F.ceil(F.col("n") * least - 1e-9)) & (F.col("m") <= F.floor(F.col("n") / least + 1e-9))
    common = lambda n, m: F.ceil((n + m) * (1.5 * cutoff / 100 - 1) - 1 - 1e-9)
    c = held(c.select("c", F.length("c").alias("n"), counted(grams(F.lower("c"), 2)).alias("gc")))
    n = held(n.select(F.col("n").alias("s"), F.length("n").alias("m"), counted(grams(F.lower("n"), 2)).alias("gs")))
    need = common(F.col("n"), F.col("n") * least)
    often = n.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    rare = c.where(need >= 1).select("c", "n", F.explode("gc").alias("g")).join(often, "g").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("k", "g"))).alias("o"), F.count(F.lit(1)).alias("known"))
    # of the rarest pairs of neighbours as many as must hold a common one; those that no name has are the rarest
    first = rare.withColumn("o", F.slice("o", F.lit(1), F.greatest(F.lit(0), F.col("known") - need + 1).cast("int")))
    met = first.select("c", F.explode("o.g").alias("g")).join(n.select("s", F.explode("gs").alias("g")).hint("merge"), "g").select("c", "s").distinct()
    met = met.join(c, "c").join(n, "s").where(near & (F.size(F.array_intersect("gc", "gs")) >= common(F.col("n"), F.col("m"))))
    # of short ones only lengths that allow it meet
    brief = c.where(need < 1).select("c", "n", F.explode(F.sequence(F.ceil(F.col("n") * least - 1e-9), F.floor(F.col("n") / least + 1e-9))).alias("m")).join(n, "m")
    close = met.select("c", "s").unionByName(brief.select("c", "s")).where(similarity("ratio", F.lower("c"), F.lower("s")) >= cutoff).select("c", F.col("s").alias("n"))
    exact = c.select("c", table[F.col("c")].alias("n")).where("n is not null").join(n.select(F.col("s").alias("n")), "n").select("c", "n")
    pairs = close.unionByName(exact)
    return c.join(pairs.groupBy("c").agg(F.sort_array(F.collect_set("n")).alias("aliases")), "c", "left").select(F.col("c").alias(canonical_col), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
