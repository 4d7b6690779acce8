"""Fingerprints and the distances between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_fingerprint(text: Column, indexes: Sequence[int]) -> Column:
    """The symbols of ``text`` at zero-based ``indexes``, in that order."""
    return F.concat(*(F.substring(text, int(i) + 1, 1) for i in indexes)) if len(indexes) else F.lit("")


def bit_fingerprint(text: Column, filters: Sequence[tuple[str, int]]) -> Column:
    """array<int>: +1 where the score of a (pattern, threshold) is above the threshold, else -1.

    A pattern is ``0``/``1``/``N`` text: positions with 1 count for, N against.
    Only the positions that a pattern uses are read.
    """
    return F.array(*(F.when(filter_score(text, pattern) > threshold, 1).otherwise(-1) for pattern, threshold in filters))


def filter_score(text: Column, pattern: str) -> Column:
    """Ones under the pattern's 1 positions less ones under its N positions."""
    score = F.lit(0)
    for symbol, sign in (("1", 1), ("N", -1)):
        at = 0
        while (start := pattern.find(symbol, at)) >= 0:
            at = start
            while at < len(pattern) and pattern[at] == symbol:
                at += 1
            part = F.substring(text, start + 1, at - start)
            score = score + sign * (F.length(part) - F.length(F.translate(part, "1", "")))
    return score


def prefix(fingerprint: Column, n: int, text: bool = False) -> Column:
    """The first ``n`` entries."""
    return F.substring(fingerprint, 1, n) if text else F.slice(fingerprint, 1, n)


def _same_length(a: Column, b: Column, size, value: Column) -> Column:
    return F.when(size(a) == size(b), value).otherwise(F.raise_error(F.lit("fingerprints differ in length")))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two arrays differ; unequal lengths are an error."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, d: s + d)
    return _same_length(a, b, F.size, differ)


def hamming_text(a: Column, b: Column) -> Column:
    """Positions at which two texts differ; unequal lengths are an error."""
    return _same_length(a, b, F.length, hamming(F.split(a, ""), F.split(b, "")))


def weighted_hamming(a: Column, b: Column, confidence: Sequence[float]) -> Column:
    """Confidence of the differing positions over all confidence, times the number of positions."""
    weights = F.array(*(F.lit(float(c)) for c in confidence))
    apart = F.zip_with(F.zip_with(a, b, lambda x, y: x != y), weights, lambda d, c: F.when(d, c).otherwise(0.0))
    total = float(sum(confidence))
    value = F.aggregate(apart, F.lit(0.0), lambda s, d: s + d) / F.lit(total) * len(confidence)
    return _same_length(a, b, F.size, value)


def manhattan(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Sum of absolute differences; terms with a null or NaN are left out."""
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + F.coalesce(F.abs(F.nanvl(a.cast("double"), F.lit(None)) - F.nanvl(b.cast("double"), F.lit(None))), F.lit(0.0))
    return total
