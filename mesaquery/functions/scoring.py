"""Scores, decays and statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_since(ts: Column, as_of: str) -> Column:
    """Whole days from a timestamp to a given moment, rounded down."""
    return F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400)


def decay(ts: Column, as_of: str, half_life: float, least: float = 0.01) -> Column:
    """2 ** -(days / half_life), at least ``least``; 0.5 without a timestamp."""
    return F.coalesce(F.greatest(F.lit(least), F.exp(-days_since(ts, as_of) * math.log(2) / half_life)), F.lit(0.5))


def decay_floor(score: Column, kind: Column, kinds: tuple[str, ...], floor: float = 0.85) -> Column:
    """Kinds that age slowly never fall below ``floor``."""
    return F.when(kind.isin(*kinds), F.greatest(score, F.lit(floor))).otherwise(score)


def freshness(age_days: Column, half_life: float = 60.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.exp(-age_days * math.log(2) / half_life)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(x: Column, a: float, b: float) -> Column:
    return sigmoid(a * x + b)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without trials."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def laplace(ok: Column, n: Column) -> Column:
    return (ok + 1) / (n + 2)


def trust(n: Column) -> Column:
    """How much a rate over n trials is worth, at most 0.95."""
    return F.least(F.lit(0.95), n / (n + 5))


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 if one is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def sign_bits(v: Column) -> Column:
    """The sign bits of a vector of any length, as an array of 64-bit words, the first component highest."""
    bits = F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1)), lambda i: F.slice(bits, i * 64 + 1, 64))
    return F.transform(words, lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def gate(axes: tuple[Column, ...], mean: float = 0.6, worst: float = 0.3) -> tuple[Column, Column]:
    """(score, passed) of a record scored on several axes."""
    score = sum(axes[1:], axes[0]) / len(axes)
    return score, (score >= mean) & (F.least(*axes) >= worst)


def route(answerable: Column, partial: Column, confidence: Column, rounds: Column, answer: float = 0.7, caveat: float = 0.4, most: int = 4) -> Column:
    """answer, caveat, search_more or idk: what a confidence allows, searching on while rounds are left and the case is open."""
    open_ = ((confidence >= caveat / 2) & (confidence < caveat)) | (answerable & (confidence >= caveat / 2) & (confidence < answer))
    return F.when(answerable & (confidence >= answer), "answer").when(partial & (confidence >= caveat), "caveat").when((rounds < most) & open_, "search_more").otherwise("idk")
