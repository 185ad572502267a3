"""Text cleaning as Column expressions; no UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Entities decode in this order, the ampersand first, so doubly escaped text decodes twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
DASH_ENTITIES = (("&#x2013;", "-"), ("&#x2014;", "-"), ("&#8211;", "-"), ("&#8212;", "-"))
MOJIBAKE = (("Ã¢â‚¬â€œ", "-"), ("Ã¢â‚¬â€", "-"), ('â€"', "-"), ("–", "-"), ("—", "-"), ("Â", ""))
#: Words that hint at a charge rather than a product.
CHARGE_WORDS = (
    "gst", "tax", "shipping", "freight", "delivery", "handling", "fee", "charge", "setup", "installation", "service", "support",
    "warranty", "insurance", "discount", "adjustment", "credit",
)


def replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def strip_first_tag(c: Column) -> Column:
    """Drops the first <...>, then the first </...> of what is left: first matches only."""
    once = F.regexp_replace(c, r"(?s)^(.*?)<[^>]+>", "$1")
    return F.regexp_replace(once, r"(?s)^(.*?)</[^>]+>", "$1")


def squeeze_first_gap(c: Column) -> Column:
    """The first run of blanks becomes one space; later runs stay."""
    return F.regexp_replace(c, r"(?s)^(.*?)[ \t\n\r\f\x0b]+", "$1 ")


def clean_text(c: Column) -> Column:
    """Entities, tags, dashes, broken encodings, blanks, then trimmed lower case."""
    decoded = replace_all(strip_first_tag(replace_all(c, ENTITIES)), DASH_ENTITIES)
    return F.lower(F.trim(squeeze_first_gap(replace_all(decoded, MOJIBAKE))))


def normalize_text(c: Column) -> Column:
    """Lower case, single spaces, no outer blanks; null becomes empty."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the words; false for null."""
    low = F.lower(c)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(False))


def charge_hint(description: Column) -> Column:
    return contains_any(description, CHARGE_WORDS)


def first_rule(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule with a word that the lower-cased text contains."""
    low, out = F.lower(c), F
    for label, words in rules:
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def joined(*cols: Column | str, sep: str = "|") -> Column:
    """The parts as text with a separator; a null part is empty."""
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])


def surrogate_key(*cols: Column | str) -> Column:
    return F.md5(joined(*cols))


def semver(c: Column) -> Column:
    """'v1.2' as a struct (major, minor); anything else is (0, 0)."""
    form = r"^v(\d+)(?:\.(\d+))?$"
    part = lambda k: F.coalesce(F.regexp_extract(F.coalesce(F.trim(c), F.lit("")), form, k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))


def normalized_names(columns: Sequence[str]) -> list[str]:
    """Column names trimmed, in lower case, blanks as underscores."""
    return ["_".join(c.strip().lower().split()) for c in columns]
