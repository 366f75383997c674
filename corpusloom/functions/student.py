"""Features of the small encoder and its rules of abstention, as Column expressions.

Rows: a null text counts as empty and has no features.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FNV_PRIME

#: Characters of a token that count; widths of character n-grams.
TOKEN_CHARS, WIDTHS = 48, (3, 5)
#: Thresholds that a model may override: least features and norm, hard and weak confidence, and what the last forgives.
MIN_FEATURES, NORM_FLOOR, HARD, WEAK, EPSILON = 3, 0.4, 0.05, 0.0, 1e-6


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, cut at 48 characters."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.left(w, F.lit(TOKEN_CHARS)))


def feature_hash(feature: Column, seed: int) -> Column:
    """FNV-1a whose first state is the seed itself, 32 bits in a BIGINT."""
    codes = F.transform(F.filter(F.split(feature, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(seed & 0xFFFFFFFF).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def features(text: Column, most: int) -> Column:
    """The first `most` features in order: of each token the word, its character 3- to 5-grams between ^ and $, and the bigram with the token before."""
    words = tokens(text)

    def of(word: Column, k: Column) -> Column:
        padded = F.concat(F.lit("^"), word, F.lit("$"))
        grams = F.flatten(F.transform(F.sequence(F.lit(WIDTHS[0]), F.lit(WIDTHS[1])), lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda s: F.concat(F.lit("c"), n.cast("string"), F.lit(":"), F.substring(padded, s, n)))).otherwise(F.array().cast("array<string>"))))
        pair = F.when(k > 0, F.array(F.concat(F.lit("b:"), F.get(words, k - 1), F.lit(":"), word))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(F.lit("w:"), word)), grams, pair)

    return F.slice(F.flatten(F.transform(words, of)), 1, most)


def family(feature: Column) -> Column:
    """char for character n-grams, else word."""
    return F.when(feature.rlike("^c[0-9]:"), "char").otherwise("word")


def known_fraction(buckets: Column, known: Column) -> Column:
    """The share of buckets, repeats included, that are known; 0 without buckets."""
    return F.coalesce(F.size(F.filter(buckets, lambda b: F.array_contains(known, b))) / F.nullif(F.size(buckets), F.lit(0)), F.lit(0.0))


def confidence(signals: dict[str, Column], weights: dict[str, float], bias: float) -> Column:
    """The logistic of the weighted signals; missing ones count as 0. Stable for large numbers of either sign."""
    z = F.lit(float(bias))
    for name, w in weights.items():
        z = z + F.coalesce(signals[name].cast("double"), F.lit(0.0)) * float(w)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def verdict(p: Column, n_features: Column, norm: Column, hard: float = HARD, weak: float = WEAK, norm_floor: float = NORM_FLOOR, least: int = MIN_FEATURES) -> Column:
    """none below hard, with too few features or too small a norm; strong from weak on; else weak."""
    refused = (p < hard) | (F.coalesce(n_features, F.lit(0)) < least) | (F.coalesce(norm, F.lit(0.0)) < norm_floor)
    return F.when(refused, "none").when(p + EPSILON >= weak, "strong").otherwise("weak")


def refused_before_search(n_features: Column, norm: Column, norm_floor: float = NORM_FLOOR, least: int = MIN_FEATURES) -> Column:
    """Whether a query is judged without a search."""
    return ~((n_features >= least) & (norm >= norm_floor))
