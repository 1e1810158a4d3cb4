"""Column expressions that turn facts about a loan or member into points."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditmill.params import DEFAULT_SCORE, ScoreParams


def _first_match(branches: Iterable[tuple[Column, Column | int]]) -> Column:
    """A CASE expression of (condition, value) pairs, without ELSE."""
    return reduce(lambda case, branch: case.when(*branch), branches, F)


def last_payment_points(paid: Column, instalment: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of the last payment, set against the monthly instalment."""
    return (
        F.when(paid < instalment * 0.5, p.short_payment)
        .when(paid < instalment, p.partial_payment)
        .when(paid == instalment, p.good)
        .when(paid <= instalment * 1.5, p.very_good)
        .when(paid > instalment * 1.5, p.excellent)
        .otherwise(p.unacceptable)
    )


def total_payment_points(received: Column, funded: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of all money received, set against the funded amount; NULL if neither arm decides."""
    half = funded * 0.5
    return (
        F.when(received >= half, p.very_good)
        .when((received > 0) & (received < half), p.good)
        .when(received.isNull() | (received == 0), p.unacceptable)
    )


def count_band_points(count: Column, unknown: int, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of a counter: none, one or two, three to five; ``unknown`` for more or NULL."""
    return (
        F.when(count == 0, p.excellent)
        .when(count.between(1, 2), p.bad)
        .when(count.between(3, 5), p.very_bad)
        .when(count.isNull() | (count > 5), unknown)
    )


def loan_status_points(status: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of the first status phrase the text contains."""
    text = F.lower(status)
    # Status phrases, best first.
    return (
        F.when(text.contains("fully paid"), p.excellent)
        .when(text.contains("current"), p.good)
        .when(text.contains("in grace period"), p.bad)
        .when(text.contains("late (16-30 days)") | text.contains("late (31-120 days)"), p.very_bad)
        .otherwise(p.unacceptable)
    )


def home_points(ownership: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of the home ownership the text ends with; NULL for other text."""
    text = F.lower(ownership)
    return (
        F.when(text.endswith("own"), p.excellent)
        .when(text.endswith("rent"), p.good)
        .when(text.endswith("mortgage"), p.bad)
        .when(text.isNull() | text.endswith("any"), p.very_bad)
    )


def credit_limit_points(funded: Column, limit: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of the funded amount as a share of the member's credit limit."""
    shares = ((0.10, p.excellent), (0.20, p.very_good), (0.30, p.good), (0.50, p.bad), (0.70, p.very_bad))
    return _first_match((funded <= limit * share, points) for share, points in shares).otherwise(p.unacceptable)


def grade_points(grade: Column, sub_grade: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Points of grade and sub-grade; NULL if the two do not belong together."""
    bases = {"A": p.excellent, "B": p.very_good, "C": p.good, "D": p.bad, "E": p.very_bad}
    # Share of the grade's points per sub-grade step.
    steps = {"1": "1.00", "2": "0.95", "3": "0.90", "4": "0.85", "5": "0.80"}
    base = _first_match((grade == letter, F.lit(points)) for letter, points in bases.items())
    step = F.substring(sub_grade, 2, 2)
    share = _first_match((step == number, F.lit(Decimal(factor))) for number, factor in steps.items())
    exact = [Decimal(points) * Decimal(factor) for points in bases.values() for factor in steps.values()]
    scale = max(1, *(-x.normalize().as_tuple().exponent for x in exact))
    return (
        F.when(grade.isin("F", "G"), F.lit(Decimal(p.unacceptable)))
        .when(sub_grade.startswith(grade), base * share)
        .cast(f"decimal({10 + scale},{scale})")
    )


def final_grade(score: Column, p: ScoreParams = DEFAULT_SCORE) -> Column:
    """Letter of a score; NULL for a NULL score."""
    return (
        F.when(score > p.grade_b_to, "A")
        .when(score > p.grade_c_to, "B")
        .when(score > p.grade_d_to, "C")
        .when(score > p.grade_e_to, "D")
        .when(score > p.grade_f_to, "E")
        .when(score <= p.grade_f_to, "F")
    )
