"""Exact quantiles of a column of any length, by histograms of ever narrower ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import settled


def exact_quantiles(df: DataFrame, column: Column, shares: Sequence[float], bins: int = 4096, enough: int = 100_000) -> list[float | None]:
    """The quantiles at ``shares``, between the two nearest values by position; None without a value.

    The column is written down once. A pass counts the values of each range that still hides a wanted
    rank in ``bins`` parts; the part with the rank, from its smallest to its largest value, is the next
    range. Ranges of at most ``enough`` values are sorted. Nothing grows with the number of values but
    the passes, of which each divides a range by ``bins``.
    """
    values = settled(df.select(column.cast("double").alias("v")).where("v IS NOT NULL"), "values")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    known: dict[int, float] = {}
    # (smallest value, largest value, values before, values inside) -> ranks in it
    ranges = {(low, high, 0, n): sorted({r for p in places for r in (math.floor(p), math.ceil(p))})}
    while ranges:
        wide = {}
        for (lo, hi, before, many), ranks in ranges.items():
            if lo == hi:
                known |= dict.fromkeys(ranks, lo)
            elif many <= enough:
                inside = [r[0] for r in values.where(F.col("v").between(lo, hi)).orderBy("v").collect()]
                known |= {r: inside[r - before] for r in ranks}
            else:
                wide[lo, hi, before, many] = ranks
        if not wide:
            break
        part = F.lit(None).cast("struct<i:int,bin:int>")
        for i, (lo, hi, _, _) in enumerate(wide):
            half = 0.5 if max(abs(lo), abs(hi)) > 1e300 else 1.0  # so that no difference overflows
            share = (F.col("v") * half - lo * half) / (hi * half - lo * half)
            place = F.struct(F.lit(i).alias("i"), F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1)).alias("bin"))
            part = F.when(F.col("v").between(lo, hi), place).otherwise(part)
        counts = values.select("v", part.alias("p")).where("p IS NOT NULL").groupBy("p.i", "p.bin").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = sorted(counts.collect())  # at most ``bins`` rows a range
        ranges = {}
        for i, ((_, _, before, _), ranks) in enumerate(wide.items()):
            for r in (r for r in found if r["i"] == i):
                if inside := [x for x in ranks if before <= x < before + r["n"]]:
                    ranges[r["lo"], r["hi"], before, r["n"]] = inside
                before += r["n"]
    between = lambda p: known[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * known[math.floor(p)] + (p - math.floor(p)) * known[math.ceil(p)]
    return [between(p) for p in places]
