"""Curation of product names from the spellings found in orders.

Token counts, typo maps and canonical tokens are joins and aggregates over (key, token) rows; only the final ranking by
string similarity needs Python, on one row per distinct name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import similarity
from millrace.held import held
from millrace.operators.edits import within

#: Common English words that carry no product meaning; a parameter of every function here.
STOP_WORDS = (
    "a", "about", "above", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before", "below", "both", "but", "by", "can", "do", "each", "for", "from", "had", "has", "have", "he", "her",
    "here", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "per", "same",
    "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "why", "will", "with", "you", "your",
)
AUTO_SCORE = 80.0


def words(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words without punctuation and stop words."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]+", " ")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*stop))


def letters(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Of these the ones made of letters only."""
    return F.filter(words(c, stop), lambda w: w.rlike(r"^\p{L}+$"))


def candidates(df: DataFrame, key: str, description: str) -> DataFrame:
    """Distinct descriptions of each key with their number of lines."""
    return df.where(F.col(key).isNotNull() & F.col(description).isNotNull()).groupBy(key, F.col(description).alias("description")).agg(F.count(F.lit(1)).alias("line_order_count"))


def token_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """token, total occurrences, presence (rows that hold it)."""
    tokens = df.select(row, F.explode(F.split(F.lower(column), " ")).alias("token")).where("token <> ''")
    return tokens.groupBy(row, "token").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("presence"))


def typo_map(df: DataFrame, key: str, description: str, max_distance: int = 2, min_length: int = 4, tokens: Column | None = None) -> DataFrame:
    """key, token, representative: the most wanted token of the key within the edit distance that is at least as wanted
    as the token itself, by number, length and spelling; of at least `min_length` letters unless it is the token.

    Candidates meet by key and what close tokens share (see `edits`).
    """
    split = F.filter(F.split(F.lower(F.col(description)), " "), lambda w: w != "") if tokens is None else tokens
    counts = df.select(F.col(key).alias("k"), F.explode(split).alias("token")).groupBy("k", "token").agg(F.count(F.lit(1)).alias("n"))
    counts = held(counts.withColumn("len", F.length("token")))
    wanted = lambda n, size, t: F.struct(F.col(n).alias("n"), F.col(size).alias("s"), F.col(t).alias("t"))
    right = counts.where(F.col("len") >= min_length).select("k", F.col("token").alias("r"), F.col("n").alias("rn"), F.col("len").alias("c"))
    near = within(counts, right, "token", "r", max_distance, ["k"])
    met = near.join(counts, ["k", "token"]).join(right, ["k", "r"]).where(wanted("rn", "c", "r") >= wanted("n", "len", "token"))
    best = met.groupBy("k", "token").agg(F.max_by("r", wanted("rn", "c", "r")).alias("r"))
    return counts.join(best, ["k", "token"], "left").select(F.col("k").alias(key), "token", F.coalesce("r", "token").alias("representative"))


def library_stop_words() -> tuple[str, ...]:
    """The English list of scikit-learn where that is installed, which curation was made with; else STOP_WORDS."""
    try:
        from sklearn.feature_extraction.text import ENGLISH_STOP_WORDS
    except ImportError:
        return STOP_WORDS
    return tuple(sorted(ENGLISH_STOP_WORDS))


def apply_map(df: DataFrame, key: str, row: Sequence[str], tokens: Column, fix: DataFrame) -> DataFrame:
    """key, the columns of `row`, and `canonical`: each row's tokens in order, replaced by those of fix (key, token, representative)
    where it has them. Rows without tokens fall out."""
    spread = df.select(key, *row, F.posexplode(tokens).alias("_i", "token")).join(fix, [key, "token"], "left")
    pairs = F.sort_array(F.collect_list(F.struct("_i", F.coalesce("representative", "token").alias("r"))))
    return spread.groupBy(key, *row).agg(F.transform(pairs, lambda x: x["r"]).alias("canonical"))


def frequent_tokens(df: DataFrame, key: str, tokens: str, top: int) -> DataFrame:
    """key, canonical_tokens: the tokens that most rows of the key hold, longer ones first among equals, then by spelling."""
    presence = df.select(key, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("token")), "token")
    best = presence.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "token"))), lambda x: x["token"]).alias("canonical_tokens"))


def rank_aliases(df: DataFrame, key: str, alias: str, tokens: str, place: str, k: int, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """key, alias, place, score, freq and rank (1 to k): the rows' aliases by token_sort_ratio with the key's tokens (an array on
    every row), then by how often the alias comes with the key, then by place. Blank aliases and keys without tokens have none.
    An alias that comes twice is ranked twice, as in the list that it comes from; it is scored once."""
    rows = df.where((F.trim(alias) != "") & (F.size(tokens) > 0))
    names = rows.groupBy(key, F.col(alias).alias("_a")).agg(F.count(F.lit(1)).alias("freq"), F.first(tokens).alias("_t"))
    target = F.array_join(words(F.array_join("_t", " "), stop), " ")
    names = names.withColumn("score", similarity("token_sort_ratio", F.array_join(words(F.col("_a"), stop), " "), target)).withColumnRenamed(key, "_k").drop("_t")
    met = rows.join(names, (rows[key] == names["_k"]) & (rows[alias] == names["_a"]))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("freq"), place)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, alias, place, "score", "freq", "rank")


def alias_pipeline(df: DataFrame, key: str, alias: str, place: str, max_distance: int = 1, min_length: int = 4, top_tokens: int = 5, top_names: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """One row per key with a non-blank alias: rep_map (token to representative), transformed_aliases (in the order of `place`),
    canonical_tokens, top_k_original (array of alias, score, freq), top_k_canonicalized (with alias_canonicalized) and params.

    Rows are a key's list of aliases; repeats count. Each step is an operator of its own: typo_map, apply_map, frequent_tokens,
    rank_aliases."""
    rows = df.select(F.col(key).alias("k"), F.col(place).alias("i"), F.col(alias).alias("d")).where("k is not null and trim(d) <> ''").withColumn("t", letters(F.col("d"), stop))
    fix = typo_map(rows, "k", "d", max_distance, min_length, F.col("t"))
    changed = rows.join(apply_map(rows, "k", ["i"], F.col("t"), fix), ["k", "i"], "left").withColumn("canonical", F.coalesce("canonical", F.array().cast("array<string>")))
    target = frequent_tokens(changed, "k", "canonical", top_tokens)
    best = rank_aliases(changed.join(target, "k"), "k", "d", "canonical_tokens", "i", top_names, stop)
    text = F.array_join("canonical", " ")
    best = best.join(changed.select("k", "i", text.alias("c")), ["k", "i"])
    listed = F.sort_array(F.collect_list(F.struct("rank", "d", "c", "score", "freq")))
    best = best.groupBy("k").agg(
        F.transform(listed, lambda x: F.struct(x["d"].alias("alias"), x["score"].alias("score"), x["freq"].alias("freq"))).alias("top_k_original"),
        F.transform(listed, lambda x: F.struct(x["d"].alias("alias"), x["c"].alias("alias_canonicalized"), x["score"].alias("score"), x["freq"].alias("freq"))).alias("top_k_canonicalized"))
    maps = fix.groupBy("k").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "representative")))).alias("rep_map"))
    every = changed.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", text.alias("c")))), lambda x: x["c"]).alias("transformed_aliases"))
    out = every.join(maps, "k", "left").join(target, "k", "left").join(best, "k", "left")
    params = {"max_edit_distance": max_distance, "min_rep_len": min_length, "top_m_canonical_tokens": top_tokens, "top_k_original": top_names}
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select(
        F.col("k").alias(key), F.coalesce("rep_map", F.create_map().cast("map<string,string>")).alias("rep_map"), "transformed_aliases",
        *[empty(c).alias(c) for c in ("canonical_tokens", "top_k_original", "top_k_canonicalized")], F.create_map(*[F.lit(x) for p in params.items() for x in p]).alias("params"))


def decide(names: DataFrame, key: str, description: str, max_distance: int = 2, min_length: int = 4, top_tokens: int = 2, top_names: int = 3, auto_score: float = AUTO_SCORE, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """One row per key: raw_names (array), canonical_tokens, match_name, match_score, final_sku_name, decision.

    The alias pipeline over a key's distinct names, in order of spelling. A clear winner above `auto_score` is decided AUTO;
    everything else needs approval.
    """
    rows = names.select(F.col(key).alias("k"), F.col(description).alias("d")).where("k is not null and trim(d) <> ''").distinct().withColumn("i", F.col("d"))
    found = alias_pipeline(rows, "k", "d", "i", max_distance, min_length, top_tokens, top_names, stop)
    raw = rows.groupBy("k").agg(F.sort_array(F.collect_list("d")).alias("raw_names"))
    score = lambda n: F.coalesce(F.get("top_k_canonicalized", F.lit(n))["score"], F.lit(0.0))
    name = F.coalesce(F.get("top_k_canonicalized", F.lit(0))["alias_canonicalized"], F.lit(""))
    sure = (score(0) > score(1)) & (score(0) > auto_score)
    return raw.join(found, "k").select(
        F.col("k").alias(key), "raw_names", "canonical_tokens", name.alias("match_name"), score(0).alias("match_score"), F.when(sure, name).otherwise("").alias("final_sku_name"),
        F.when(sure, "AUTO").otherwise("NEED_APPROVAL").alias("decision"))


def capitalized(tokens: str | Column) -> Column:
    """Tokens as a name for display: each begins with a capital, the rest in lower case."""
    part = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(tokens, part), " ")
