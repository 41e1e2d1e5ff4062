"""Comparisons within tolerances, and the scalar functions built on them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the canonical problem.
EPS, EPS_ZERO, FEASTOL, INFINITE = 1e-13, 1e-40, 1e-6, 1e30


def relative_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def is_eq(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.abs(a - b) <= eps


def is_rel_eq(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.abs(relative_difference(a, b)) <= eps


def is_le(a: Column, b: Column, eps: float = EPS) -> Column:
    return a <= b + eps


def is_lt(a: Column, b: Column, eps: float = EPS) -> Column:
    return a < b - eps


def is_rel_le(a: Column, b: Column, eps: float = EPS) -> Column:
    return relative_difference(a, b) <= eps


def is_rel_lt(a: Column, b: Column, eps: float = EPS) -> Column:
    return relative_difference(a, b) < -eps


def is_zero(a: Column, eps: float = EPS_ZERO) -> Column:
    return F.abs(a) <= eps


def is_zero_feas(a: Column) -> Column:
    return F.abs(a) <= FEASTOL


def contains(sorted_values: Column, value: Column) -> Column:
    return F.array_contains(sorted_values, value)


def is_subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def as_double(text: Column) -> Column:
    """A number or null."""
    return F.trim(text).try_cast("double")


def is_only_spaces(text: Column) -> Column:
    return F.trim(text) == ""


def is_left_justified(text: Column, word: str) -> Column:
    return text.startswith(word)


def euclid(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def round_to_pow2(v: Column) -> Column:
    """2 ** floor(log2 |v|), and a half for zero."""
    return F.when(v == 0, F.lit(0.5)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v)))))
