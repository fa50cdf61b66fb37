"""Pair features from sets of tokens and n-grams, built-in functions only. Results are doubles from 0 to 1 unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.text import col, filled, tokens


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole.cast("double")).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")).otherwise(0.0)


def ngrams(c: str | Column, n: int) -> Column:
    """Distinct n-grams, blanks included; none for shorter texts."""
    c = filled(c)
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: c.substr(i, F.lit(n)))))


def token_jaccard(a, b) -> Column:
    return jaccard(tokens(a), tokens(b))


def ngram_jaccard(a, b, n: int) -> Column:
    return jaccard(ngrams(a, n), ngrams(b, n))


def prefix_share(x: Column, y: Column) -> Column:
    """Share of the tokens x for which one of y is a prefix or the other way round; not symmetric."""
    near = F.filter(x, lambda t: F.exists(y, lambda u: F.startswith(u, t) | F.startswith(t, u)))
    return F.when(F.size(y) > 0, share(F.size(near), F.size(x))).otherwise(0.0)


def prefix_overlap(a, b) -> Column:
    return prefix_share(tokens(a), tokens(b))


def with_digits(of: Column) -> Column:
    return F.filter(of, lambda t: t.rlike(r"\p{Nd}"))


def number_overlap(a, b) -> Column:
    return jaccard(with_digits(tokens(a)), with_digits(tokens(b)))


def rare_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of tokens of at least four characters, with the small denominator term of the original scale."""
    x, y = (F.filter(z, lambda t: F.length(t) >= 4) for z in (x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / (F.size(F.array_union(x, y)) + F.lit(1e-9))).otherwise(0.0)


def rare_overlap(a, b) -> Column:
    return rare_jaccard(tokens(a), tokens(b))


def size_difference(x: Column, y: Column) -> Column:
    return F.abs(F.size(x) - F.size(y)).cast("double")


def token_difference(a, b) -> Column:
    return size_difference(tokens(a), tokens(b))


def length_ratio(a, b) -> Column:
    x, y = F.length(filled(a)), F.length(filled(b))
    return F.least(x, y) / F.greatest(x, y, F.lit(1)).cast("double")


def equal_filled(a, b) -> Column:
    """1 where both are equal and not empty."""
    return ((filled(a) != "") & (filled(a) == filled(b))).cast("double")


def same_first(x: Column, y: Column) -> Column:
    return F.coalesce((F.get(x, F.lit(0)) == F.get(y, F.lit(0))).cast("double"), F.lit(0.0))


def first_token(a, b) -> Column:
    return same_first(tokens(a), tokens(b))


def same(a, b) -> Column:
    return F.coalesce((col(a) == col(b)).cast("double"), F.lit(0.0))


def both(a, b) -> Column:
    return (col(a) & col(b)).cast("double")


def either(a, b) -> Column:
    """1 where just one holds."""
    return (col(a) != col(b)).cast("double")


def dot(a, b) -> Column:
    """Inner product of two vectors in double precision; 0 where one is missing."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
