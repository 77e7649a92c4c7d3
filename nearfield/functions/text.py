"""Column expressions for lexical search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(text: Column, lowercase: bool) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.lower(t) if lowercase else t


def _run(min_length: int) -> Column:
    # a greedy match takes a whole run, and a shorter run matches nowhere
    return F.lit(f"[a-zA-Z0-9]{{{max(1, min_length)},}}")


def tokens(text: Column, min_length: int = 1, lowercase: bool = True) -> Column:
    """Runs of ASCII letters and digits, lower-cased (by Unicode's rules) before the cut."""
    return F.regexp_extract_all(_text(text, lowercase), _run(min_length), F.lit(0))


def token_count(text: Column, min_length: int = 1, lowercase: bool = True) -> Column:
    """How many tokens there are, without making them."""
    return F.regexp_count(_text(text, lowercase), _run(min_length)).cast("long")


def tokens_among(text: Column, terms: list[str], lowercase: bool = True) -> Column:
    """The tokens that are one of the given terms, in one pass over the text."""
    one = "|".join(sorted(terms))  # terms are letters and digits
    return F.regexp_extract_all(_text(text, lowercase), F.lit(f"(?<![a-zA-Z0-9])(?:{one})(?![a-zA-Z0-9])"), F.lit(0))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """The saturated term frequency; with avgdl 0 the length plays no part."""
    ratio = F.when(avgdl > 0, dl / avgdl).otherwise(F.lit(0.0))
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * ratio))


def tenant_prefix(tenant: Column) -> Column:
    """First four hex digits of the tenant's MD5, and the tenant."""
    return F.concat_ws("_", F.substring(F.md5(tenant.cast("binary")), 1, 4), tenant, F.lit(""))


def shard_for_key(key: Column, shards: int | Column) -> Column:
    """A key's shard, by the first 32 bits of its MD5, so that other engines can agree."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(shards) if isinstance(shards, int) else shards)
