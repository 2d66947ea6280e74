"""Statistics with the rules that evaluation reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stdev(x: str | Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def decile(sorted_values: Column, k: int) -> Column:
    """The k-th decile of a sorted array by exclusive interpolation; null under two values."""
    n = F.size(sorted_values)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(k) * (n + 1) / 10).cast("int")))
    d = F.lit(k) * (n + 1) - j * 10
    return F.when(n >= 2, (F.get(sorted_values, j - 1) * (10 - d) + F.get(sorted_values, j) * d) / 10.0)


def at_share(sorted_values: Column, share: float) -> Column:
    """The value at a share of a sorted array, no interpolation."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(F.floor(n * F.lit(share)).cast("int"), n - 1))


def entropy(count: str | Column, total: Column) -> Column:
    """The entropy in nats of counts that sum to a total; an aggregate."""
    p = (F.col(count) if isinstance(count, str) else count) / total
    return -F.sum(p * F.log(p))


def cosine(a: str | Column, b: str | Column) -> Column:
    """The cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(F.col(a), F.col(b)), F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


def lcs_length(a: str | Column, b: str | Column) -> Column:
    """The length of the longest common subsequence of two arrays, row by row of the table in a fold."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    zeros = F.array_repeat(F.lit(0), F.size(y) + 1)

    def row(prev: Column, item: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            best = F.when(F.element_at(y, j) == item, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, -1)))
            return F.concat(cur, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(F.lit(0)), cell)

    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.element_at(F.aggregate(x, zeros, row), -1)).otherwise(0)


def overlap_f1(common: Column, n_a: Column, n_b: Column) -> Column:
    """The F1 of a common length against two lengths; 0 where nothing is common."""
    return F.when(common > 0, 2.0 * common / (n_a + n_b)).otherwise(0.0)
