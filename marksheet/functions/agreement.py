"""Agreement measures over groups.

Errors are plain aggregates. The kappas work on counts of (label, label) cells, so a group of any
size becomes at most K x K rows before anything is collected; no confusion matrix is built. tau-b
counts pairs of rows in opposite order by merging, in ranges of values where a group is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import settled


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def accuracy(y: Column, p: Column, weight: Column | None = None) -> Column:
    """Share of equal pairs; ``weight`` says how many rows a row stands for."""
    same = (y == p).cast("double")
    return F.avg(same) if weight is None else F.try_divide(F.sum(same * weight), F.sum(F.when(same.isNotNull(), weight)))


def qwk_fixed(y: Column, p: Column, weight: Column | None = None) -> Column:
    """Quadratic kappa on class codes as they are (gaps keep their distance); both sides constant: 1 or 0."""
    y, p, w = y.cast("double"), p.cast("double"), F.lit(1.0) if weight is None else weight.cast("double")
    n = F.sum(w)
    apart = n * F.sum(w * (y - p) * (y - p))
    spread = n * F.sum(w * y * y) + n * F.sum(w * p * p) - 2 * F.sum(w * y) * F.sum(w * p)
    constant = (F.min(y) == F.max(y)) & (F.min(p) == F.max(p))
    return F.when(constant, (F.min(y) == F.min(p)).cast("double")).otherwise(1.0 - F.try_divide(apart, spread))


def label_cells(df: DataFrame, keys: list[str], y: Column, p: Column, weight: str | None = None) -> DataFrame:
    """How many rows (keys, _y, _p) there are: _n. ``weight`` names a column of counts that rows carry."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys, y.alias("_y"), p.alias("_p")).agg(n.cast("double").alias("_n"))


def qwk_observed(df: DataFrame, keys: list[str], y: str, p: str, name: str = "qwk", weight: str | None = None) -> DataFrame:
    """Quadratic kappa per group on labels re-coded 0..K-1 over the labels seen in the group, and n
    and accuracy. Rows with a null label are left out."""
    cells = label_cells(df, keys, F.col(y), F.col(p), weight)
    grouped = cells.groupBy(*keys).agg(
        F.sum("_n").alias("_total"),
        F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0.0)).alias("_same"),
        F.array_sort(F.collect_set("_y")).alias("_ys"),
        F.array_sort(F.collect_set("_p")).alias("_ps"),
        F.collect_list(F.struct("_y", "_p", "_n")).alias("_cells"),
    )
    labels = F.array_sort(F.array_union("_ys", "_ps"))
    coded = grouped.withColumn("_labels", labels).withColumn("_codes", F.transform("_cells", lambda c: F.struct(F.array_position("_labels", c["_y"]).cast("double").alias("x"), F.array_position("_labels", c["_p"]).cast("double").alias("z"), c["_n"].alias("n"))))
    total = lambda f: F.aggregate("_codes", F.lit(0.0), lambda a, c: a + c["n"] * f(c))
    n = F.col("_total")
    apart = n * total(lambda c: (c["x"] - c["z"]) * (c["x"] - c["z"]))
    spread = n * total(lambda c: c["x"] * c["x"]) + n * total(lambda c: c["z"] * c["z"]) - 2.0 * total(lambda c: c["x"]) * total(lambda c: c["z"])
    constant = (F.size("_ys") == 1) & (F.size("_ps") == 1)
    qwk = F.when(constant, (F.get("_ys", F.lit(0)) == F.get("_ps", F.lit(0))).cast("double")).otherwise(1.0 - F.try_divide(apart, spread))
    return coded.select(*keys, n.cast("long").alias("n"), (F.col("_same") / n).alias("accuracy"), qwk.alias(name))


def inversions(group: np.ndarray, y: np.ndarray, p: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """Per group the number of row pairs with y below and p above, where a row stands for n rows.

    All groups at once: rows are sorted by group and y, then runs of doubling length are merged by p,
    and each row of a right half counts the rows of its left half with a larger p.
    """
    out = np.zeros(groups)
    if not len(y):
        return out
    order = np.lexsort((p, y, group))  # equal y in the order of p: no inversion among them
    group, n, rank = group[order], n[order], np.unique(p, return_inverse=True)[1].reshape(-1)[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.append(first, len(group)))
    place = np.arange(len(group)) - np.repeat(first, length)
    values, width = int(rank.max()) + 1, 1
    while width < length.max():
        # A block of two halves gets a number that grows with group and place.
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (place[1:] // (2 * width) != place[:-1] // (2 * width))))
        block = np.cumsum(new) - 1
        right = (place // width) & 1
        order = np.argsort((block * values + rank) * 2 + right, kind="stable")  # at equal p the left half first
        left = np.where(right[order] == 0, n[order], 0.0)
        upto = np.cumsum(left)
        in_block = np.bincount(block, np.where(right == 0, n, 0.0))
        above = (np.cumsum(in_block)[block[order]] - upto) * n[order]
        out += np.bincount(group[order], np.where(right[order] == 1, above, 0.0), groups)
        width *= 2
    return out


def _inversions_of_lists(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n0 .. _n3, _dis) with the sums of ties and inversions of the lists of cells ``_cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(len(keys)).offsets.to_numpy())
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                # Some 250,000 cells at a time, or one longer list.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 250_000, "right")))
                part = batch.slice(at, to - at)
                y, p, n = (c.to_numpy(zero_copy_only=False).astype(float) for c in part.column(len(keys)).flatten().flatten())
                group = np.repeat(np.arange(to - at), sizes[at:to])
                pairs = lambda v: v * (v - 1) / 2

                def ties(v: np.ndarray) -> np.ndarray:
                    order = np.lexsort((v, group))
                    new = np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (group[order][1:] != group[order][:-1])))[: len(v)]
                    starts = np.flatnonzero(new)
                    return np.bincount(group[order][starts], pairs(np.add.reduceat(n[order], starts)) if len(starts) else None, to - at)

                total = np.bincount(group, n, to - at)
                made = [pairs(total), ties(y), ties(p), np.bincount(group, pairs(n), to - at), inversions(group, y, p, n, to - at)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *(pa.array(m.astype(float)) for m in made)], names=[*keys, *_SUMS])
                at = to

    kinds = "".join(f"`{k}` {grouped.schema[k].dataType.simpleString()}, " for k in keys)
    return grouped.select(*keys, "_cells").mapInArrow(run, f"{kinds}_n0 double, _n1 double, _n2 double, _n3 double, _dis double")


#: Pairs of rows; those tied in y, in p, in both; those in opposite order.
_SUMS = ("_n0", "_n1", "_n2", "_n3", "_dis")


def _tau(sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    n0, n1, n2, n3, dis = (F.col(c) for c in _SUMS)
    spread = (n0 - n1) * (n0 - n2)
    return sums.select(*keys, F.when(spread > 0, (n0 - n1 - n2 + n3 - 2 * dis) / F.sqrt(n0 - n1) / F.sqrt(n0 - n2)).alias(name))


def _lists(cells: DataFrame, keys: list[str], *by: str, y: str = "_y", p: str = "_p") -> DataFrame:
    cell = F.struct(F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"), "_n")
    return cells.groupBy(*keys, *by).agg(F.collect_list(cell).alias("_cells"))


def tau_b_of_cells(df: DataFrame, keys: list[str], y: str, p: str, name: str = "tau_b", weight: str | None = None) -> DataFrame:
    """``kendall_tau_b`` where every group is known to have few distinct pairs of values, as grades
    and totals of an exam have: a group's counts come in one list."""
    cells = label_cells(df, keys, F.col(y).cast("double"), F.col(p).cast("double"), weight)
    return _tau(_inversions_of_lists(_lists(cells, keys), keys), keys, name)


def _block(value: str, side: str, most: int) -> Column:
    """The block of a value among the sorted bounds: 2 i after the i-th, or 2 i - 1 if it is the i-th
    and fills a block alone. Equal values share a block."""
    bounds, v = F.col(f"{side}.bounds"), F.col(value)
    steps = F.lit([1 << k for k in reversed(range(most.bit_length() + 1))])
    at = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.coalesce(F.get(bounds, i + s - 1) <= v, F.lit(False)), i + s).otherwise(i))
    alone = F.array_contains(F.col(f"{side}.alone"), v)
    return F.when(alone, 2 * at - 1).otherwise(2 * at)


def kendall_tau_b(df: DataFrame, keys: list[str], y: str, p: str, name: str = "tau_b", weight: str | None = None, cells_a_block: int = 1 << 17, most_blocks: int = 512) -> DataFrame:
    """tau-b per group for any number of distinct values; null with fewer than two rows or a constant side.

    Rows of equal values are counted first, and the counts are written down. A group of up to ``cells_a_block`` pairs of values is one
    block. A larger one is cut into ranges of y and ranges of p by its quantiles (at most
    ``most_blocks``; a value that several quantiles fall on has a block alone). Pairs of rows in
    opposite order are then in one range of y, or in two of those and one range of p, or in two of
    both. The first and the second are counted inside their ranges, the third from the counts of
    (range, range). No task holds more than a range or those counts.
    """
    cells = settled(label_cells(df, keys, F.col(y).cast("double"), F.col(p).cast("double"), weight), "tau")
    largest = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if largest <= cells_a_block:
        return _tau(_inversions_of_lists(_lists(cells, keys), keys), keys, name)
    parts = F.least(F.ceil(F.count(F.lit(1)) / cells_a_block).cast("int"), F.lit(most_blocks))
    shares = F.lit([i / most_blocks for i in range(1, most_blocks)])
    quantile = lambda c: F.percentile_approx(c, shares, F.lit(20 * most_blocks))
    cut = cells.groupBy(*keys).agg(parts.alias("_parts"), quantile("_y").alias("_qy"), quantile("_p").alias("_qp"))

    def bounds(q: str) -> Column:
        picked = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.get(q, F.floor(i * most_blocks / F.col("_parts")).cast("int") - 1))
        picked = F.when(F.col("_parts") > 1, picked).otherwise(F.array().cast("array<double>"))
        alone = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(picked)), lambda i: F.when((i > 1) & (F.get(picked, i - 1) == F.get(picked, i - 2)), F.array(F.get(picked, i - 1))).otherwise(F.array().cast("array<double>")))))
        return F.struct(F.array_distinct(picked).alias("bounds"), F.when(F.size(picked) > 1, alone).otherwise(F.array().cast("array<double>")).alias("alone"))

    cut = cut.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_parts"), bounds("_qy").alias("_by"), bounds("_qp").alias("_bp"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] or [F.lit(True)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    # A row for each group, with its bounds.
    placed = cells.join(cut, on).select(*keys, "_y", "_p", "_n", "_parts", _block("_y", "_by", most_blocks).alias("_i"), _block("_p", "_bp", most_blocks).alias("_j"))
    zero = [F.lit(0.0).alias(c) for c in _SUMS]
    only = lambda rows, c: rows.select(*keys, *(F.col(x) if x == c else z for x, z in zip(_SUMS, zero, strict=True)))
    several = placed.where("_parts > 1")
    pairs = lambda n: n * (n - 1) / 2
    coarse = several.groupBy(*keys, "_i", "_j").agg(F.sum("_n").alias("_n"))
    found = [
        only(_inversions_of_lists(_lists(placed.where("_i % 2 = 0"), keys, "_i"), keys), "_dis"),
        only(_inversions_of_lists(_lists(several.where("_j % 2 = 0").groupBy(*keys, "_i", "_j", "_p").agg(F.sum("_n").alias("_n")), keys, "_j", y="_i"), keys), "_dis"),
        only(_inversions_of_lists(_lists(coarse, keys, y="_i", p="_j"), keys), "_dis"),
        cells.groupBy(*keys).agg(pairs(F.sum("_n")).alias("_n0"), *zero[1:3], F.sum(pairs(F.col("_n"))).alias("_n3"), zero[4]),
        *(only(cells.groupBy(*keys, c).agg(pairs(F.sum("_n")).alias(to)), to) for c, to in (("_y", "_n1"), ("_p", "_n2"))),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return _tau(every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS)), keys, name)
