"""Hashes, ids and scores as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    t = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n|\r", "\n")).otherwise(text)
    return F.sha2(F.btrim(t, F.lit(" \t\n\x0b\x0c")), 256)


def citation_id(source: Column, chunk: Column) -> Column:
    return F.concat(F.lit("cit-"), F.substring(F.sha2(F.concat_ws("\u001f", source, chunk), 256), 1, 12))


def stable_id(level: str, *parts: Column) -> Column:
    """A letter for the level and 24 hex digits of a hash over all parts."""
    return F.concat(F.lit(f"{level[0]}_"), F.substring(F.sha2(F.concat_ws("\u0000", F.lit("tarnweave-1"), F.lit(level), *parts), 256), 1, 24))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """SHA-1 of the key as a whole number, modulo ``buckets``: folded digit by digit, so 160 bits are safe."""
    digits = F.split(F.sha1(key.cast("binary")), "")
    return F.aggregate(
        F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("int"), F.lit(buckets)).cast("int")
    )


def confidence(bm25: Column, cosine: Column) -> Column:
    """Evidence in 0..1: the better of 1 - exp(-bm25 / 4) and (cosine - .42) / .58."""
    lexical = 1 - F.exp(-F.greatest(bm25, F.lit(0.0)) / 4)
    dense = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.greatest(cosine, F.lit(0.0)) - 0.42) / 0.58))
    return F.round(F.greatest(lexical, dense), 6)


def age_decay(days: Column, pinned: Column, uses: Column) -> Column:
    decay = F.when(pinned, 1.0).otherwise(F.greatest(F.lit(0.85), F.least(F.lit(1.0), 0.85 + 0.15 * F.pow(F.lit(2.0), -F.greatest(days, F.lit(0.0)) / 180))))
    boost = F.least(F.lit(1.05), 1.0 + 0.01 * F.log1p(F.greatest(uses, F.lit(0))))
    return F.least(F.lit(1.05), decay * boost)


def reliability(successes: Column, failures: Column) -> Column:
    return (successes + 1) / (successes + failures + 2)


def freshness(days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clipped to 0..1; 0 for vectors of different or no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def overlap(query: Column, other: Column) -> Column:
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, other)) / F.size(query))


def p95_nearest(sorted_values: Column) -> Column:
    """Nearest rank: the ceil(.95 n)-th of a sorted array, 0 for none."""
    return F.coalesce(F.get(sorted_values, (F.ceil(F.size(sorted_values) * 0.95) - 1).cast("int")), F.lit(0.0))


def p95_exclusive(sorted_values: Column) -> Column:
    """The 19th of 20 exclusive quantiles: between the places (n + 1) .95 and the next, not beyond the ends."""
    n = F.size(sorted_values)
    place = (n + 1) * 19
    low = F.greatest(F.lit(1), F.least(n - 1, F.floor(place / 20).cast("int")))
    share = (place - low * 20) / 20.0
    between = F.get(sorted_values, low - 1) * (1 - share) + F.get(sorted_values, low) * share
    return F.when(n == 0, F.lit(None)).when(n == 1, F.get(sorted_values, F.lit(0))).otherwise(between)
