"""Grading scales as column functions. Literals are doubles; rounding is half-even (rint)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, functions as F

# The linear scale, the pass mark, and shares and labels of the rank-based scale.
MIN_GRADE, MAX_GRADE, STEP, PASS = 1.0, 6.0, 0.5, 0.6
PASSING_SHARES = (0.10, 0.25, 0.30, 0.25, 0.10)
PASSING_LABELS = ("A", "B", "C", "D", "E")
ORDERED_LABELS = ("F", "E", "D", "C", "B", "A")


def _linear(z: Column) -> Column:
    grade = F.rint((MIN_GRADE + (MAX_GRADE - MIN_GRADE) * z) / STEP) * STEP
    return F.when(z.isNotNull(), F.least(F.greatest(grade, F.lit(MIN_GRADE)), F.lit(MAX_GRADE)))


def grade_linear_abs(norm: Column) -> Column:
    return _linear(norm)


def pass_fail_abs(norm: Column) -> Column:
    """A missing score counts as failed."""
    return F.coalesce(norm >= PASS, F.lit(False))


def grade_linear_mean_centered(total: Column, most: Column, mean: Column) -> Column:
    """Piecewise linear around the exam's own mean."""
    z = (
        F.when(mean <= 0, F.when(total > 0, 1.0).otherwise(0.0))
        .when(mean >= most, 0.5 * total / mean)
        .when(total <= mean, 0.5 * (total / mean))
        .otherwise(0.5 + 0.5 * F.try_divide(total - mean, most - mean))
    )
    return _linear(F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)))


def pass_fail_from_grade(grade: Column) -> Column:
    return F.coalesce(grade >= MIN_GRADE + (MAX_GRADE - MIN_GRADE) * PASS, F.lit(False))


def points_passed(norm: Column, size: Column) -> Column:
    """The pass mark in points, as the rank-based scale applies it."""
    return norm * size >= size * PASS


def grade_distribution_label(norm: Column, size: Column, rank: Column, passed: Column) -> Column:
    """F below the pass mark; passers get A to E by rank, ties the better label.

    ``rank`` is the rank in the exam, best first (so failed students come last), and ``passed`` how
    many students passed.
    """
    cuts = list(accumulate(PASSING_SHARES))
    label = F.lit(PASSING_LABELS[-1])
    for share, name in reversed(list(zip(cuts[:-1], PASSING_LABELS[:-1], strict=True))):
        label = F.when(rank <= F.ceil(passed * share), name).otherwise(label)
    return F.when(F.coalesce(points_passed(norm, size), F.lit(False)), label).otherwise(ORDERED_LABELS[0])


def distribution_label_ordinal(label: Column) -> Column:
    out = F.when(label == ORDERED_LABELS[0], 0)
    for i, name in enumerate(ORDERED_LABELS[1:], 1):
        out = out.when(label == name, i)
    return out


def grade_abs_n_classes(norm: Column, n: Column) -> Column:
    """0 for failed, then n-1 passing bins of equal width on [0.6, 1]."""
    bins = F.floor((norm - PASS) / (1.0 - PASS) * (n - 1).cast("double")) + 1
    return F.when(norm >= PASS, F.least(F.greatest(bins, F.lit(1)), n - 1)).when(norm.isNotNull(), F.lit(0)).cast("int")


def _share_up_to(x: float) -> float:
    """The share of passers in the best ``x`` of the scale, where each share is spread evenly over its fifth.

    Seats are rounded up from these numbers, so the last digits count: fifths begin at multiples of
    0.2 as doubles, and a share rises by its slope from the sum of those before it.
    """
    step, before = 1 / len(PASSING_SHARES), [0.0, *accumulate(PASSING_SHARES)]
    at = max((j for j in range(len(PASSING_SHARES)) if j * step <= x), default=0)
    if x >= 1:
        return before[-1]
    end = 1.0 if at + 1 == len(PASSING_SHARES) else (at + 1) * step
    return (before[at + 1] - before[at]) / (end - at * step) * (x - at * step) + before[at]


def passing_distribution_interpolated(n: int) -> list[float]:
    """Shares of ``n`` passing classes of equal width on the scale, which sum to one."""
    parts = [_share_up_to((i + 1) * (1 / n)) - _share_up_to(i * (1 / n)) for i in range(n)]
    return [p / sum(parts) for p in parts] if n > 1 else [1.0]
