"""Paired significance tests between models: exact McNemar and permutation of exam-level kappa."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.agreement import qwk_observed
from ..functions.columns import linear_grade_code, model_short_name, to_numeric
from ..sources.io import settled
from .exam import EXAM, cells_of_states, completeness_filter, graded_columns, reference_by_model, sheet_states, student_exam_totals, student_scales, total_cells, with_scales
from .sheets import answer_sheets, many_parts, number_questions, sitting_counts, sitting_totals, sittings

STUDENT = [*EXAM, "member_id"]
RANKING = ("el_acc_linear_abs", "el_qwk_linear_abs", "el_acc_bologna", "el_qwk_bologna")


_LABELS = ("gold_total", "pred_total", "gold_norm", "pred_norm", "gold_linear_abs", "pred_linear_abs", "gold_bologna", "pred_bologna")


def _labelled(scaled: DataFrame, *more: str) -> DataFrame:
    right = [(F.col(f"gold_{s}") == F.col(f"pred_{s}")).alias(f"correct_{s}") for s in ("linear_abs", "bologna")]
    return scaled.select("model_col", *EXAM, *more, *_LABELS, *right)


def exam_label_table(sat: DataFrame, models: Sequence[str], size: int, cells: DataFrame | None = None) -> DataFrame:
    """Per model and exam-student of one size: totals, norms, both scales and whether the model is right.

    ``cells``: the students of that size, already counted.
    """
    totals = student_exam_totals(sat.where(F.col("test_size") == size), models)
    return _labelled(student_scales(completeness_filter(totals), cells), "member_id")


def _of_size(sat: DataFrame, size: int | None) -> DataFrame:
    return sat if size is None else sat.where(F.col("test_size") == size)


def label_cells(sat: DataFrame, models: Sequence[str], size: int | None = None) -> DataFrame:
    """The label table by counts: n students of a model and exam with the same totals in one row."""
    return _labelled(with_scales(total_cells(student_exam_totals(_of_size(sat, size), models))), "n")


def pair_cells(sat: DataFrame, models: Sequence[str], pairs: DataFrame, size: int | None = None) -> DataFrame:
    """Per pair (a, b) and exam how many students, complete for both, have the same three or four
    totals (n), with both models' grades on both scales. ``pairs`` has a row for two models at most.

    Both models of a student are met in the student's own row; grades are joined to the counts.
    """
    sat = _of_size(sat, size)
    totals = sitting_totals(sat, graded_columns(models))
    full = lambda c: F.col(f"`v_{c}`") == F.col("test_size")
    whole = (F.col("n_rows") == F.col("test_size")) & (F.col("n_questions") == F.col("test_size"))
    of = {m: reference_by_model(m) for m in models}
    each = F.create_map(*(x for m in models for x in (F.lit(m), F.struct((whole & full(of[m]) & full(m)).alias("ok"), F.col(f"`t_{of[m]}`").alias("gold"), F.col(f"`t_{m}`").alias("pred")))))
    met = totals.select(*EXAM, each.alias("_m")).crossJoin(F.broadcast(pairs.select("a", "b")))
    met = met.select("a", "b", *EXAM, F.col("_m")[F.col("a")].alias("x"), F.col("_m")[F.col("b")].alias("y")).where("x.ok AND y.ok")
    counts = met.groupBy("a", "b", *EXAM, *(F.col(f"{v}.{t}").alias(f"{t}_total_{s}") for v, s in (("x", "a"), ("y", "b")) for t in ("gold", "pred"))).agg(F.count(F.lit(1)).alias("n"))
    return _with_grades(counts, label_cells(sat, models, size))


def _with_grades(counts: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.drop("n")
    for s in ("a", "b"):
        side = labels.select(F.col("model_col").alias(s), *EXAM, *(F.col(c).alias(f"{c}_{s}") for c in labels.columns if c not in ("model_col", *EXAM)))
        counts = counts.join(side, [s, *EXAM, f"gold_total_{s}", f"pred_total_{s}"])
    return counts


def sheet_label_cells(exam: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """``label_cells`` straight from the answer sheets."""
    return _labelled(with_scales(cells_of_states(sheet_states(exam, answers, models))), "n")


def sheet_pair_cells(exam: DataFrame, answers: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pair_cells`` straight from the answer sheets: students are counted in the tasks.

    ``labels``: the label cells of all models in ``pairs``, a row for two models at most.
    """
    of = sorted({(r["a"], r["b"]) for r in pairs.collect()})  # models are few
    if not of:  # fewer than two models have students
        none = ", ".join(f"{t}_total_{s} double" for s in "ab" for t in ("gold", "pred"))
        return _with_grades(labels.sparkSession.createDataFrame([], f"a string, b string, test_id string, test_size int, {none}, n long"), labels)
    views = {f"{i}": (reference_by_model(a), a, reference_by_model(b), b) for i, (a, b) in enumerate(of)}
    counts = sitting_counts(exam, answers, views).where(~F.col("more_rows") & (F.col("lacks") == 0))
    named = [F.element_at(F.lit([p[k] for p in of]), F.col("view").cast("int") + 1).alias("ab"[k]) for k in (0, 1)]
    totals = [F.col(f"t{i}").alias(f"{t}_total_{s}") for i, (t, s) in enumerate((t, s) for s in "ab" for t in ("gold", "pred"))]
    return _with_grades(counts.select(*named, *EXAM, *totals, "n"), labels)


def model_ranking(labels: DataFrame) -> DataFrame:
    """Per model the mean over exams of accuracy and kappa on both scales, with its position.

    ``labels``: the label table, or its cells.
    """
    labels = labels if "n" in labels.columns else labels.withColumn("n", F.lit(1))
    pairs = labels.select("model_col", "test_id", "n", F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.col(f"gold_{s}").cast("double").alias("y"), F.col(f"pred_{s}").cast("double").alias("p")) for s in ("linear_abs", "bologna")))).alias("s")).select("model_col", "test_id", "n", "s.*")
    exams = qwk_observed(pairs, ["model_col", "test_id", "scale"], "y", "p", weight="n")
    pick = lambda s, c: F.avg(F.when(F.col("scale") == s, F.col(c)))
    means = exams.groupBy("model_col").agg(*(pick(s, c).alias(f"el_{m}_{s}") for s in ("linear_abs", "bologna") for m, c in (("acc", "accuracy"), ("qwk", "qwk"))))
    rows = labels.groupBy("model_col").agg(F.sum("n").alias("n_exam_student_rows"))
    by = [F.desc_nulls_last(F.round(c, 12)) for c in ("el_acc_linear_abs", "el_qwk_linear_abs", "el_qwk_bologna", "el_acc_bologna")]
    # A row per model.
    return rows.join(means, "model_col").withColumn("model", model_short_name(F.col("model_col"))).withColumn("position", F.row_number().over(Window.orderBy(*by, "model_col")))


def best_model_per_metric(ranking: DataFrame, metrics: Sequence[str] = RANKING) -> DataFrame:
    """The top model for each metric; the other metrics, then the name, break ties."""
    long = ranking.select("*", F.explode(F.array(*(F.struct(F.lit(m).alias("selection_metric"), F.col(m).alias("best_value")) for m in metrics))).alias("s")).select("model_col", *RANKING, "s.*")
    order = [F.desc_nulls_last(F.round(c, 12)) for c in ("best_value", *RANKING)]
    return long.withColumn("_n", F.row_number().over(Window.partitionBy("selection_metric").orderBy(*order, "model_col"))).where("_n = 1").select("selection_metric", F.col("model_col").alias("best_model_col"), "best_value")


def mcnemar_counts(met: DataFrame, scale: str) -> DataFrame:
    """Per pair (a, b): both right, only a, only b, both wrong, discordant. ``met``: ``pair_cells``."""
    a, b = F.col(f"correct_{scale}_a"), F.col(f"correct_{scale}_b")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = met.groupBy("a", "b").agg(F.sum("n").alias("n"), n(a & b).alias("both_right"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("both_wrong"))
    return out.withColumn("discordant", F.col("only_a") + F.col("only_b"))


def binomial_two_sided(only_a: int, only_b: int) -> float:
    """min(1, 2 P(X <= the smaller count)) for X ~ Binomial(only_a + only_b, 1/2); 1 if both are 0.

    Terms are added from the largest down until they no longer count.
    """
    n, k = only_a + only_b, min(only_a, only_b)
    if not n:
        return 1.0
    total, term = 0.0, 1.0
    largest = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    while term > total * 1e-17:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total * math.exp(largest))


def mcnemar_exact_p(counts: DataFrame) -> DataFrame:
    """Two-sided binomial(1/2) p on the discordant pairs, 1 if there are none; a row for each pair of models."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [binomial_two_sided(x, y) for x, y in zip(b.column("only_a").to_pylist(), b.column("only_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p"])

    return counts.mapInArrow(run, f"{kinds}, p double")


def best_against_others(ranking: DataFrame, metric: str) -> DataFrame:
    best = best_model_per_metric(ranking, [metric]).select(F.col("best_model_col").alias("a"))
    return F.broadcast(best).join(ranking.select(F.col("model_col").alias("b")), F.col("a") != F.col("b"))


def mcnemar_all_pairs(sat: DataFrame, models: Sequence[str], size: int) -> DataFrame:
    """The metric's best model against every other, on both scales."""
    ranking = model_ranking(label_cells(sat, models, size))
    out = [mcnemar_exact_p(mcnemar_counts(pair_cells(sat, models, best_against_others(ranking, f"el_acc_{s}"), size), s)).withColumn("scale", F.lit(s)) for s in ("linear_abs", "bologna")]
    return out[0].unionByName(out[1])


def grade_codes(met: DataFrame, scale: str) -> DataFrame:
    """(a, b, exam, n) with the grade codes of the reference and both models, where references agree."""
    code = lambda c: linear_grade_code(F.col(c)) if scale == "linear_abs" else F.col(c)
    rows = met.select("a", "b", *EXAM, "n", *(code(f"{t}_{scale}_{s}").alias(f"{t[0]}_{s}") for t in ("gold", "pred") for s in ("a", "b")))
    return rows.where("g_a = g_b")


#: Students of one cell whose swaps are the bits of one random number.
_CHUNK = 30
_PRIME = (1 << 31) - 1
#: Numbers of students whose swaps one random number settles by a table of quantiles.
TABLE_SIZES = (512, 4096, 32768)


@lru_cache
def quantile_table(size: int) -> tuple[int, tuple[int, ...]]:
    """Quantiles of Binomial(size, 1/2): (least, cuts). A random number u below 2^31 - 1 stands for
    ``least`` plus the number of cuts that are no larger than u.

    What lies seven and a half deviations from the mean has a chance of 10^-13 and gets no cut.
    """
    far = math.ceil(7.5 * math.sqrt(size) / 2)
    least, most = size // 2 - far, size // 2 + far
    log_of = lambda k: math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) - size * math.log(2)
    below = list(accumulate(math.exp(log_of(k)) for k in range(least, most)))
    return least, tuple(min(_PRIME, int(c * _PRIME)) for c in below)


def swap_cells(rows: DataFrame) -> DataFrame:
    """How many exam-students have each (gold, first, second) grade code, and what swapping one changes.

    rows: a, b, exam, g_a, p_a, p_b, n. The kappas of an exam depend on three sums over students, and
    a swap adds a fixed amount to each, so permutations need these counts alone: at most the cube
    of the number of grades for an exam of any size.
    """
    cells = rows.groupBy("a", "b", *EXAM, F.col("g_a").cast("long").alias("g"), F.col("p_a").cast("long").alias("x"), F.col("p_b").cast("long").alias("y")).agg(F.sum("n").alias("n"))
    g, x, y = F.col("g"), F.col("x"), F.col("y")
    return cells.withColumns({"d_apart": (g - y) * (g - y) - (g - x) * (g - x), "d_square": y * y - x * x, "d_sum": y - x})


def p_values(means: DataFrame, *keys: str) -> DataFrame:
    """p = (extreme + 1) / (n + 1) from the mean difference d of every permutation beside the observed one."""
    extreme = F.abs("d") >= F.abs("observed") - 1e-12
    out = means.groupBy(*keys, "observed").agg(F.count_if(extreme).alias("extreme"), F.count(F.lit(1)).alias("n_permutations"))
    return out.withColumn("p", (F.col("extreme") + 1) / (F.col("n_permutations") + 1))


def mixed(*parts: Column) -> Column:
    """A number below 2^31 - 1 from the md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long") % _PRIME


def permutation_test_qwk(sat: DataFrame, models: Sequence[str], size: int, a: str, b: str, n: int, seed: int, scale: str = "linear_abs") -> DataFrame:
    """Observed mean exam kappa difference of two models and p."""
    pair = sat.sparkSession.createDataFrame([(a, b)], "a string, b string")
    return permutation_of_cells(swap_cells(grade_codes(pair_cells(sat, models, pair, size), scale)), n, seed)


def with_draws(cells: DataFrame, seed: int) -> DataFrame:
    """The cells with ``draws``: what their swaps are made of, in functions that any engine can repeat.

    Up to 511 students are the set bits among as many random bits, 30 at a time, and the rest come in
    parts of ``TABLE_SIZES``, the largest first, each a quantile. A draw has the size of its table (1
    for bits, with their mask) and two numbers (h, k): permutation p uses (h p + k) mod 2^31 - 1. So a
    cell costs some 30 numbers and one more for every 32,768 students.
    """
    left, s = F.when(F.col("x") != F.col("y"), F.col("n")).otherwise(0).cast("long"), F.lit(str(seed))
    none = F.array().cast("array<struct<size:int,h:bigint,k:bigint,mask:bigint>>")

    def draws(size: int, first: int, last: Column, mask) -> Column:
        named = lambda j: [s, *EXAM, "g", "x", "y", F.lit(size), j]
        one = lambda j: F.struct(F.lit(size).alias("size"), (mixed(*named(j)) + 1).alias("h"), mixed(*named(j), F.lit("k")).alias("k"), mask(j).alias("mask"))
        return F.when(last >= first, F.transform(F.sequence(F.lit(first).cast("long"), last), one)).otherwise(none)

    parts = []
    for size in reversed(TABLE_SIZES):
        parts.append(draws(size, 1, F.floor(left / size), lambda j: F.lit(0).cast("long")))
        left = left % size
    bits = lambda j, left=left: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(left - j * _CHUNK, F.lit(_CHUNK)).cast("int")) - 1
    chunk = draws(1, 0, F.floor((left + _CHUNK - 1) / _CHUNK) - 1, lambda j: bits(j))
    return cells.withColumn("draws", F.concat(chunk, *parts))


def drawn_swaps(draws: list[dict], p: np.ndarray) -> np.ndarray:
    """How many students of a cell each permutation swaps. ``p``: a number for each."""
    out = np.zeros(len(p), np.int64)
    for d in draws:
        u = (d["h"] * p + d["k"]) % _PRIME
        if d["size"] == 1:
            out += np.bitwise_count(u & d["mask"])
        else:
            least, cuts = quantile_table(d["size"])
            out += least + np.searchsorted(np.array(cuts), u, "right")
    return out


def permutation_of_cells(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """Observed mean exam kappa difference and p of ``swap_cells`` of one pair.

    Each exam's cells and draws come in one row (grades cubed at most). A task adds up the exams it
    has, so one number a permutation leaves it.
    """
    spark, s = cells.sparkSession, F.lit(str(seed))
    # A fixed number of rows, whatever the data: the permutations.
    numbers = [r[0] for r in spark.range(1, n + 1).select((mixed(s, F.col("id")) + 1).alias("p"), "id").orderBy("id").collect()]
    sent = spark.sparkContext.broadcast(np.array(numbers, np.int64))
    exams = with_draws(cells.repartition(many_parts(cells), *EXAM), seed).groupBy(*EXAM).agg(F.array_sort(F.collect_list(F.struct("g", "x", "y", "n", "draws"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        total, count = np.zeros(n + 1), 0
        for batch in batches:
            for exam in batch.column(0).to_pylist():
                swaps = np.zeros((n + 1, len(exam)))  # first the observed order
                for i, c in enumerate(exam):
                    swaps[1:, i] = drawn_swaps(c["draws"], p)
                total += kappa_differences(exam, swaps)
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total), pa.array(np.full(n + 1, count))], names=["perm", "total", "count"])

    means = exams.select("cells").mapInArrow(run, "perm long, total double, count long").groupBy("perm").agg((F.sum("total") / F.sum("count")).alias("d")).where("d IS NOT NULL")
    seen = means.where("perm = 0").select(F.col("d").alias("observed"))
    return p_values(means.where("perm > 0").crossJoin(F.broadcast(seen)))


def kappa_differences(cells: list[dict], swaps: np.ndarray) -> np.ndarray:
    """Kappa of the first minus the second model for each row of swap counts by cell."""
    g, x, y, n = (np.array([c[k] for c in cells], float) for k in ("g", "x", "y", "n"))
    m, s_g, s_gg = n.sum(), (n * g).sum(), (n * g * g).sum()

    def kappa(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        total = lambda f: (n * f(mine)).sum() + swaps @ (f(other) - f(mine))
        apart, spread = m * total(lambda v: (g - v) ** 2), m * (s_gg + total(lambda v: v * v)) - 2 * s_g * total(lambda v: v)
        return np.where(spread == 0, np.where(apart == 0, 1.0, 0.0), 1 - apart / np.where(spread == 0, 1, spread))

    return kappa(x, y) - kappa(y, x)


def permutation_all_pairs(sat: DataFrame, models: Sequence[str], size: int, n: int = 10_000, seed: int = 4242, per_block: int = 2_500) -> DataFrame:
    """The metric's best model against every other on both scales."""
    labels = label_cells(sat, models, size)
    return _permuted_pairs(labels, lambda pairs: pair_cells(sat, models, pairs, size), n, seed, per_block)


def sheet_permutations(exam: DataFrame, answers: DataFrame, models: Sequence[str], n: int = 10_000, seed: int = 4242, per_block: int = 2_500) -> DataFrame:
    """``permutation_all_pairs`` over given exams, straight from the answer sheets."""
    labels = settled(sheet_label_cells(exam, answers, models), "labels")
    return _permuted_pairs(labels, lambda pairs: sheet_pair_cells(exam, answers, pairs, labels), n, seed, per_block)


def _permuted_pairs(labels: DataFrame, met: Callable[[DataFrame], DataFrame], n: int, seed: int, per_block: int) -> DataFrame:
    ranking, cells = model_ranking(labels), None
    for scale in ("linear_abs", "bologna"):
        one = swap_cells(grade_codes(met(best_against_others(ranking, f"el_qwk_{scale}")), scale)).withColumn("scale", F.lit(scale))
        cells = one if cells is None else cells.unionByName(one)
    return permutations_in_blocks(cells, n, seed, per_block)


def permutations_in_blocks(cells: DataFrame, n: int, seed: int, per_block: int) -> DataFrame:
    """Permutations of every (scale, a, b) of ``swap_cells`` with a scale.

    Swap counts are drawn per cell (binomial), exam and block of permutations. A task adds up the
    exams it has: what it holds and emits is one number for each pair and permutation.
    """
    keys = ["scale", "a", "b"]
    exams = cells.groupBy(*keys, *EXAM).agg(F.array_sort(F.collect_list(F.struct("g", "x", "y", "n"))).alias("cells"))  # grades cubed at most
    blocks = cells.sparkSession.range(math.ceil(n / per_block)).select(F.col("id").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                size = min(per_block, n - r["block"] * per_block)
                words = [seed, r["block"], *f"{r['scale']}|{r['a']}|{r['b']}|{r['test_id']}|{r['test_size']}".encode()]
                rng = np.random.default_rng(np.random.SeedSequence(words))
                many = np.array([c["n"] if c["x"] != c["y"] else 0 for c in r["cells"]], np.int64)
                swaps = np.vstack([np.zeros(len(many), np.int64), rng.binomial(many, 0.5, (size, len(many)))])  # first the observed order
                sums = held.setdefault((r["scale"], r["a"], r["b"], r["block"]), np.zeros((2, size + 1)))
                sums += [kappa_differences(r["cells"], swaps), np.ones(size + 1)]
        for (scale, a, b, block), (total, count) in held.items():
            rows = len(total)
            perm = block * per_block + np.arange(rows)
            perm[0] = 0
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * rows, pa.string()) for v in (scale, a, b)), pa.array(perm, pa.int64()), pa.array(total), pa.array(count)], names=[*keys, "perm", "total", "count"])

    grid = exams.crossJoin(F.broadcast(blocks)).repartition(many_parts(exams), *EXAM, "block")  # a fixed number of blocks
    means = grid.mapInArrow(run, "scale string, a string, b string, perm long, total double, count double").groupBy(*keys, "perm").agg((F.sum("total") / F.sum("count")).alias("d"))
    seen = means.where("perm = 0").select(*keys, F.col("d").alias("observed"))
    return p_values(means.where("perm > 0").join(seen, keys), *keys)


def _far(a: str, b: Column) -> Column:
    return F.abs(F.col(a) - b) > 1e-12


def row_checks(size: int) -> dict[str, tuple[str, Column]]:
    """name -> (what is wrong, the rows that are) for checks that look at one row of the label table."""
    total = F.col("test_size").cast("double")
    labels = ("gold_linear_abs", "pred_linear_abs", "gold_bologna", "pred_bologna")
    any_null = F.greatest(*(F.col(c).isNull() for c in labels))
    return {
        "labels_not_null": ("rows without a label", any_null),
        "single_test_size": (f"rows of another size than {size}", F.col("test_size") != size),
        "totals_in_range": ("totals outside of the exam's points", (F.col("gold_total") < 0) | (F.col("gold_total") > total) | (F.col("pred_total") < 0) | (F.col("pred_total") > total)),
        "gold_norm_matches": ("norms that are not total / size", _far("gold_norm", F.col("gold_total") / total)),
        "pred_norm_matches": ("norms that are not total / size", _far("pred_norm", F.col("pred_total") / total)),
        "linear_in_range": ("grades outside of 1 to 6", ~F.col("pred_linear_abs").between(1, 6) | ~F.col("gold_linear_abs").between(1, 6)),
        "linear_on_step": ("grades off the steps of a half", (F.col("pred_linear_abs") * 2 != F.rint(F.col("pred_linear_abs") * 2)) | (F.col("gold_linear_abs") * 2 != F.rint(F.col("gold_linear_abs") * 2))),
        "bologna_ordinals": ("ordinals outside of 0 to 5", ~F.col("pred_bologna").between(0, 5) | ~F.col("gold_bologna").between(0, 5)),
        "correct_linear_flag": ("flags that differ from the labels", F.col("correct_linear_abs") != (F.col("gold_linear_abs") == F.col("pred_linear_abs"))),
        "correct_bologna_flag": ("flags that differ from the labels", F.col("correct_bologna") != (F.col("gold_bologna") == F.col("pred_bologna"))),
        "fail_below_pass_mark": ("passes below the pass mark", (F.col("pred_norm") * total < total * 0.6) & (F.col("pred_bologna") > 0)),
    }


def sheet_students(exam: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """How many exam-students (n) are complete for the same models, with the same totals of the references.

    Straight from the answer sheets: whether a grade is there is summed as a grade, so students are
    counted in the tasks whatever they lack. Totals are called t_ and the reference.
    """
    columns, references = graded_columns(models), sorted({reference_by_model(m) for m in models})
    number = {c: to_numeric(F.col(f"`{c}`")) for c in columns}
    whole = {f"t_{c}": F.coalesce(number[c], F.lit(0.0)) for c in references} | {f"has_{c}": number[c].isNotNull().cast("double") for c in columns}
    view = list(whole)
    counts = sitting_counts(exam, answers.select("member_id", "question_id", *(c.alias(n) for n, c in whole.items())), {"students": view}).where(~F.col("more_rows"))
    full = {c: F.col(f"t{view.index(f'has_{c}')}") == F.col("test_size") for c in columns}
    held = F.array_sort(F.array_compact(F.array(*(F.when(full[m] & full[reference_by_model(m)], F.lit(m)) for m in models))))
    named = counts.select(*EXAM, held.alias("models"), *(F.col(f"t{view.index(f't_{c}')}").alias(f"t_{c}") for c in references), "n")
    return named.where("size(models) > 0").groupBy(*EXAM, "models", *(f"t_{c}" for c in references)).agg(F.sum("n").alias("n"))


def sheet_checks(exam: DataFrame, answers: DataFrame, models: Sequence[str], labels: DataFrame) -> dict[str, DataFrame]:
    """The checks of ``sanity_checks`` that look at a student's rows of several models, from answer sheets: name -> offending.

    ``labels``: the label cells of the same exams.
    """
    from .joins import key_sets_of_states, not_unique

    students = settled(sheet_students(exam, answers, models), "students")
    gold = labels.select("model_col", *EXAM, "gold_total", "gold_linear_abs", "gold_bologna").distinct()
    references = [c[2:] for c in students.columns if c[:2] == "t_"]
    of = F.coalesce(*(F.when(F.col("model_col").isin([m for m in models if reference_by_model(m) == c]), F.col(f"t_{c}")) for c in references))
    states = [*EXAM, "models", *(f"t_{c}" for c in references), "n"]
    met = students.select(*states, F.explode("models").alias("model_col")).withColumn("gold_total", of).join(gold, ["model_col", *EXAM, "gold_total"])
    differ = met.groupBy(*states).agg(F.count_distinct("gold_linear_abs", "gold_bologna").alias("_labels")).where("_labels > 1")
    # A sitting is a sheet and an exam, so a model has an exam-student twice only where a student has several sheets.
    sheets = answer_sheets(answers, number_questions(exam), [])
    several = answers.join(not_unique(sheets, ["member_id"]).select("member_id"), "member_id", "left_semi")
    twice = not_unique(completeness_filter(student_exam_totals(sittings(exam, several, graded_columns(models)), models)), ["model_col", *STUDENT])
    count = lambda df, n: df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("offending"))
    return {"rows_unique": count(twice, F.lit(1)), "gold_labels_agree": count(differ, F.col("n")), "same_exam_students": count(key_sets_of_states(students.select("models", "n")).where("missing > 0 OR extra > 0"), F.lit(1))}


def sanity_checks(labels: DataFrame, models: Sequence[str], size: int, selection: Sequence[str] = RANKING, ranking: DataFrame | None = None, pairs: DataFrame | None = None, exams: int | None = None, students: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Named checks: name, severity, offending, passed, details.

    ``labels``: the label table, or its cells with ``students``, the ``sheet_checks`` that cells cannot tell.
    ``ranking``: a published ranking to hold against a new one; ``pairs``: the comparisons (a, b) that
    were made, which must be the best model of each ``selection`` metric with every other; ``exams``:
    how many exams there should be. What is not given is not compared.
    """
    from .joins import expected_models_present, model_key_sets, not_unique

    if students is None:
        if "n" in labels.columns:
            raise ValueError("cells need the checks of students")
        rows = {"rows_unique": not_unique(labels, ["model_col", *STUDENT]), "gold_labels_agree": labels.groupBy(*STUDENT).agg(F.count_distinct("gold_linear_abs", "gold_bologna").alias("n")).where("n > 1"), "same_exam_students": model_key_sets(labels).where("missing > 0 OR extra > 0")}
        students = {k: df.agg(F.count(F.lit(1)).alias("offending")) for k, df in rows.items()}
    labels = labels if "n" in labels.columns else labels.withColumn("n", F.lit(1))
    rules = row_checks(size)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    one = labels.agg(*(n(c).alias(name) for name, (_, c) in rules.items()))
    found = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("critical").alias("severity"), F.col(n).alias("offending"), F.lit(d).alias("details")) for n, (d, _) in rules.items()))).alias("x")).select("x.*")
    again = settled(model_ranking(labels), "ranking")
    best = best_model_per_metric(again, [m for m in selection if m in again.columns])
    per_exam = labels.groupBy("model_col", "test_id").agg(F.sum("n").alias("n"))
    per_model = labels.groupBy("model_col").agg(F.sum("n").alias("n"), F.count_distinct("test_id").alias("exams"))
    total = labels.agg(n(F.lit(True)).alias("n"), n(F.col("test_size") == size).alias("of_size"))
    gone = labels.sparkSession.createDataFrame([(m,) for m in selection if m not in again.columns], "metric string")
    of_students = [
        ("rows_unique", "critical", "exam-students that a model has twice"), ("gold_labels_agree", "critical", "exam-students whose reference differs between models"),
        ("same_exam_students", "warning", "models with other exam-students than the first"),
    ]
    counted = [
        ("expected_models", "critical", expected_models_present(labels, models), "models missing or extra"),
        ("selection_metrics_exist", "critical", gone, "selection metrics that the ranking lacks"),
        ("test_size_exists", "critical", total.where("of_size = 0"), "no row of the size asked for"),
        ("labels_not_empty", "critical", total.where("n = 0"), "no row at all"),
        ("exam_students_counted", "critical", per_exam.groupBy("test_id").agg(F.count(F.lit(1)).alias("n")).join(labels.agg(F.count_distinct("model_col").alias("m")), F.col("n") != F.col("m")), "exams that not every model has"),
        ("equal_row_counts", "warning", per_model.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo != hi"), "models have different numbers of rows"),
    ]
    if exams is not None:
        counted.append(("exam_count", "warning", per_model.where(F.col("exams") != exams), f"models with another number of exams than {exams}"))
    if ranking is not None:
        other = ranking.select("model_col", *(F.col(m).alias(f"_{m}") for m in RANKING)).join(again, "model_col", "full")
        differs = reduce(lambda a, b: a | b, (~F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= 1e-12, F.col(m).isNull() & F.col(f"_{m}").isNull()) for m in RANKING))
        counted.append(("ranking_recomputes", "critical", other.where(differs), "models whose ranking metrics come out otherwise"))
    if pairs is not None:
        want = best.select(F.col("best_model_col").alias("a")).distinct().join(again.select(F.col("model_col").alias("b")), F.col("a") != F.col("b"))
        have = pairs.select("a", "b").distinct()
        counted.append(("best_paired_with_all", "critical", want.exceptAll(have), "comparisons of a best model that are missing"))
    counts = [(name, severity, students[name], details) for name, severity, details in of_students] + [(name, severity, bad.agg(F.count(F.lit(1)).alias("offending")), details) for name, severity, bad, details in counted]
    for name, severity, offending, details in counts:
        found = found.unionByName(offending.select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), "offending", F.lit(details).alias("details")))
    return found.select("name", "severity", "offending", (F.col("offending") == 0).alias("passed"), "details")


def raise_on_critical(checks: DataFrame) -> DataFrame:
    """Raise after the table of checks exists, naming the critical ones that failed."""
    failed = [r["name"] for r in checks.where("severity = 'critical' AND NOT passed").collect()]
    if failed:
        raise ValueError(f"critical checks failed: {', '.join(sorted(failed))}")
    return checks
