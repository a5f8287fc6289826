"""Exam-level evaluation: student totals, completeness, scales, agreement, summaries.

Totals come from answer sheets (``sheets.sittings``) without a shuffle: all models of an exam-student
are summed in one row and only then turned into rows, which are counted before they move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scales as S
from ..functions.agreement import accuracy, kendall_tau_b, mae, mse, qwk_fixed, qwk_observed, tau_b_of_cells
from ..functions.columns import to_numeric
from ..sources.io import settled
from .joins import key_sets_of_states
from .sheets import EXAM, many_parts, sitting_counts, sitting_ranks, sitting_totals

SCALES = ("linear_abs", "pass_linear_abs", "linear_mean", "pass_linear_mean", "bologna")
METRICS = ("el_tau_b", *(f"el_{m}_{s}" if not s.startswith("pass_") else f"el_pass_{m}_{s[5:]}" for s in SCALES for m in ("acc", "qwk")))
COUNTS = ("n_students", "students_raw", "students_complete", "students_dropped_incomplete", "students_missing_human", "students_missing_prediction")


def reference_by_model(model: str, reference: str = "human_grade", first: str = "human_expert_one_gold", second: str = "human_expert_two") -> str:
    """The reference column: grader one where the 'model' is grader two."""
    return first if model == second else reference


def graded_columns(models: Sequence[str]) -> list[str]:
    """The grade columns that totals of these models need: references and models."""
    return sorted({reference_by_model(m) for m in models} | set(models))


def student_exam_totals(sat: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model, exam and student: rows, distinct questions, valid grades and totals (missing adds 0).

    ``sat``: the sittings with the ``graded_columns`` of the models.
    """
    totals = sitting_totals(sat, graded_columns(models))
    of = lambda m: F.struct(F.lit(m).alias("model_col"), F.col(f"`v_{reference_by_model(m)}`").alias("human_valid"), F.col(f"`v_{m}`").alias("pred_valid"), F.col(f"`t_{reference_by_model(m)}`").alias("gold_total"), F.col(f"`t_{m}`").alias("pred_total"))
    return totals.select(*EXAM, "member_id", "n_rows", "n_questions", F.explode(F.array(*map(of, models))).alias("_m")).select("_m.model_col", *EXAM, "member_id", "n_rows", "n_questions", "_m.human_valid", "_m.pred_valid", "_m.gold_total", "_m.pred_total")


def is_complete() -> Column:
    size = F.col("test_size")
    return (F.col("n_rows") == size) & (F.col("n_questions") == size) & (F.col("human_valid") == size) & (F.col("pred_valid") == size)


def completeness_filter(totals: DataFrame) -> DataFrame:
    return totals.where(is_complete())


def exam_states(totals: DataFrame) -> DataFrame:
    """How many students (n) of a model and exam are complete with each pair of totals, or lack what.

    The one table that exam metrics read. What is shuffled is bounded by pairs of totals, not by how
    many students sat an exam; it is written down, as counts, grades and tau-b each read it again.
    """
    states = totals.groupBy(
        "model_col", *EXAM, is_complete().alias("complete"), (F.col("human_valid") < F.col("test_size")).alias("lacks_human"), (F.col("pred_valid") < F.col("test_size")).alias("lacks_prediction"),
        *(F.when(is_complete(), F.col(c)).alias(c) for c in ("gold_total", "pred_total")),
    ).agg(F.count(F.lit(1)).alias("n"))
    return settled(states, "states")


def sheet_states(exam: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """``exam_states`` straight from the answer sheets: students are counted in the tasks."""
    counts = sitting_counts(exam, answers, {m: (reference_by_model(m), m) for m in models})
    return settled(
        counts.select(
            F.col("view").alias("model_col"), *EXAM, (~F.col("more_rows") & (F.col("lacks") == 0)).alias("complete"), (F.col("lacks").bitwiseAND(1) > 0).alias("lacks_human"), (F.col("lacks").bitwiseAND(2) > 0).alias("lacks_prediction"),
            F.col("t0").alias("gold_total"), F.col("t1").alias("pred_total"), "n",
        ),
        "states",
    )


def sheet_key_sets(exam: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """``joins.model_key_sets`` of complete exam-students, from how many sittings lack which grades."""
    columns = graded_columns(models)
    counts = sitting_counts(exam, answers, {"grades": columns}, sums=False)
    bits = {m: (1 << columns.index(m)) | (1 << columns.index(reference_by_model(m))) for m in models}
    held = F.array(*(F.when(~F.col("more_rows") & (F.col("lacks").bitwiseAND(F.lit(b)) == 0), F.lit(m)) for m, b in bits.items()))
    return key_sets_of_states(counts.select(F.array_compact(held).alias("models"), "n"))


def counts_of_states(states: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    done = n(F.col("complete"))
    return states.groupBy("model_col", *EXAM).agg(done.alias("n_students"), F.sum("n").alias("students_raw"), done.alias("students_complete"), n(~F.col("complete")).alias("students_dropped_incomplete"), n(F.col("lacks_human")).alias("students_missing_human"), n(F.col("lacks_prediction")).alias("students_missing_prediction"))


def completeness_counts(totals: DataFrame) -> DataFrame:
    return counts_of_states(exam_states(totals))


def cells_of_states(states: DataFrame) -> DataFrame:
    return states.where("complete").select("model_col", *EXAM, "gold_total", "pred_total", "n")


def total_cells(totals: DataFrame) -> DataFrame:
    """How many complete students of a model and exam have each pair of totals: n.

    All scales depend on totals alone. A group has at most as many cells as there are pairs of
    totals, however many students sat the exam, so everything after this works on bounded groups.
    """
    return cells_of_states(exam_states(totals))


def by_exam(cells: DataFrame) -> DataFrame:
    """The cells dealt by model and exam to many tasks; what is worked out for an exam moves no more."""
    return cells.repartition(many_parts(cells), "model_col", *EXAM)


def _standing(cells: DataFrame) -> DataFrame:
    """Norms and, for both sides, the exam's mean, the rank (ties the better) and how many passed."""
    exam = Window.partitionBy("model_col", *EXAM)
    size, n = F.col("test_size").cast("double"), F.col("n")
    out = by_exam(cells).withColumns({f"{s}_norm": F.col(f"{s}_total") / size for s in ("gold", "pred")})
    made = {}
    for s in ("gold", "pred"):
        norm = F.col(f"{s}_norm")
        best = exam.orderBy(F.desc(f"{s}_norm"))
        up_to = F.sum(n).over(best)  # with all peers
        made[f"_{s}_mean"] = F.sum(F.col(f"{s}_total") * n).over(exam) / F.sum(n).over(exam)
        made[f"_{s}_rank"] = up_to - F.sum(n).over(best.rangeBetween(Window.currentRow, Window.currentRow)) + 1
        made[f"_{s}_passed"] = F.sum(F.when(S.points_passed(norm, size), n).otherwise(0)).over(exam)
        made[f"_{s}_norm_passed"] = F.sum(F.when(norm >= S.PASS, n).otherwise(0)).over(exam)
    return out.withColumns(made)


def with_scales(cells: DataFrame) -> DataFrame:
    """Norms and the grades of all scales for both sides of ``total_cells``."""
    out, size, made = _standing(cells), F.col("test_size").cast("double"), {}
    for s in ("gold", "pred"):
        norm = F.col(f"{s}_norm")
        made[f"{s}_linear_abs"] = S.grade_linear_abs(norm)
        made[f"{s}_pass_linear_abs"] = S.pass_fail_abs(norm).cast("int")
        made[f"{s}_linear_mean"] = S.grade_linear_mean_centered(F.col(f"{s}_total"), size, F.col(f"_{s}_mean"))
        made[f"{s}_bologna_label"] = S.grade_distribution_label(norm, size, F.col(f"_{s}_rank"), F.col(f"_{s}_passed"))
    out = out.withColumns(made)
    out = out.withColumns({f"{s}_pass_linear_mean": S.pass_fail_from_grade(F.col(f"{s}_linear_mean")).cast("int") for s in ("gold", "pred")} | {f"{s}_bologna": S.distribution_label_ordinal(F.col(f"{s}_bologna_label")) for s in ("gold", "pred")})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def student_scales(complete: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The scales of every complete student: those of the student's cell (``cells``: already counted)."""
    if cells is None:
        cells = complete.groupBy("model_col", *EXAM, "gold_total", "pred_total").agg(F.count(F.lit(1)).alias("n"))
    # Cells are too many to be sent, whatever their estimated size.
    return complete.join(with_scales(cells).drop("n").hint("merge"), ["model_col", *EXAM, "gold_total", "pred_total"])


def scale_pairs(scaled: DataFrame) -> DataFrame:
    """Long: one row per cell and scale with both sides as doubles, and n."""
    pair = lambda s: F.struct(F.lit(s).alias("scale"), F.col(f"gold_{s}").cast("double").alias("y"), F.col(f"pred_{s}").cast("double").alias("p"))
    return scaled.select("model_col", *EXAM, "n", F.explode(F.array(*map(pair, SCALES))).alias("_s")).select("model_col", *EXAM, "_s.*", "n")


def scale_agreement(scaled: DataFrame) -> DataFrame:
    """Accuracy and kappa of every scale per model and exam, side by side, as ``qwk_observed`` of ``scale_pairs`` gives them.

    A scale has few grades, so a bit of a mask tells that an exam has one, and a grade's code is how
    many bits are set below its own. A cell stays one row for all scales.
    """
    keys, out = ["model_col", *EXAM], scaled
    exam = Window.partitionBy(*keys)
    bit = lambda g: F.call_function("shiftleft", F.lit(1), g)
    place, seen = {}, {}
    for s in SCALES:
        # Linear grades go in half steps from the least.
        place[s] = [((F.col(f"{side}_{s}") - S.MIN_GRADE) / S.STEP if s.startswith("linear") else F.col(f"{side}_{s}")).cast("int") for side in ("gold", "pred")]
    both = {s: y.isNotNull() & p.isNotNull() for s, (y, p) in place.items()}
    for s, (y, p) in place.items():
        seen[s] = F.bit_or(F.when(both[s], bit(y).bitwiseOR(bit(p)))).over(exam)
    out = out.select(*keys, F.col("n").cast("double").alias("n"), *(a for s, (y, p) in place.items() for a in (F.when(both[s], y).alias(f"y_{s}"), F.when(both[s], p).alias(f"p_{s}"), seen[s].alias(f"seen_{s}"))))
    sums, made = [], []
    for s in SCALES:
        y, p = F.col(f"y_{s}"), F.col(f"p_{s}")
        x, z = (F.bit_count(F.col(f"seen_{s}").bitwiseAND(bit(g) - 1)).cast("double") for g in (y, p))
        n = F.when(y.isNotNull(), F.col("n"))
        each = {"n": F.sum(n), "same": F.sum(F.when(y == p, n).otherwise(0.0)), "apart": F.sum(n * (x - z) * (x - z)), "squares": F.sum(n * (x * x + z * z)), "x": F.sum(n * x), "z": F.sum(n * z), "gold": F.bit_or(bit(y)), "pred": F.bit_or(bit(p))}
        sums += [f.alias(f"{k}_{s}") for k, f in each.items()]
        of = {k: F.col(f"{k}_{s}") for k in each}
        constant = (F.bit_count(of["gold"]) == 1) & (F.bit_count(of["pred"]) == 1)
        qwk = F.when(constant, (of["gold"] == of["pred"]).cast("double")).otherwise(1.0 - F.try_divide(of["n"] * of["apart"], of["n"] * of["squares"] - 2.0 * of["x"] * of["z"]))
        made += [c.alias(f"el_{m}_{s}" if not s.startswith("pass_") else f"el_pass_{m}_{s[5:]}") for m, c in (("acc", F.try_divide(of["same"], of["n"])), ("qwk", qwk))]
    return out.groupBy(*keys).agg(*sums).select(*keys, *made)


def exam_metrics(sat: DataFrame, models: Sequence[str]) -> DataFrame:
    """Six counts and eleven metrics per model and exam; exams without a complete student keep null metrics."""
    return metrics_of_states(exam_states(student_exam_totals(sat, models)))


def metrics_of_states(states: DataFrame) -> DataFrame:
    """``exam_metrics`` of counted students."""
    keys = ["model_col", *EXAM]
    cells = cells_of_states(states)
    tau = tau_b_of_cells(by_exam(cells), keys, "gold_total", "pred_total", "el_tau_b", "n")
    return counts_of_states(states).join(tau, keys, "left").join(scale_agreement(with_scales(cells)), keys, "left").select(*keys, *COUNTS, *METRICS)


def exam_metrics_wide(metrics: DataFrame, models: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """One row per exam with ``<model>__<metric>`` columns."""
    return metrics.groupBy(*EXAM).agg(*(F.first(F.when(F.col("model_col") == m, F.col(c)), ignorenulls=True).alias(f"{m}__{c}") for m in models for c in names))


def exam_summary(metrics: DataFrame, keys: Sequence[str] = ("model_col", "test_size"), names: Sequence[str] = METRICS) -> DataFrame:
    """Instances, distinct runs, counts and metric means, deviations, n and missing."""
    stats = [a for c in names for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_missing"))]
    return metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_instances"), F.count_distinct("test_id").alias("n_runs"), F.avg("n_students").alias("n_students_mean"), F.stddev_samp("n_students").alias("n_students_std"), F.sum("n_students").alias("n_students_sum"), *stats)


def report_rollup(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same averages per size, overall, per test and size, and per test, by grouping sets."""
    sets = [[F.col("model_col"), F.col("test_size")], [F.col("model_col")], [F.col("model_col"), F.col("test_id"), F.col("test_size")], [F.col("model_col"), F.col("test_id")]]
    return metrics.groupingSets(sets, "model_col", "test_id", "test_size").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_instances"), *(F.avg(c).alias(f"{c}_mean") for c in names))


def rank_by_total(totals: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Position by predicted total, ties by student: students ahead of the total plus the place among its own.

    ``cells``: the same students, already counted.
    """
    keys = ["model_col", *EXAM]
    n = F.count(F.lit(1)) if cells is None else F.sum("n")
    counts = (totals if cells is None else cells).groupBy(*keys, "pred_total").agg(n.alias("_n"))
    ahead = counts.select(*keys, "pred_total", (F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("pred_total"))) - F.col("_n")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy(*keys, "pred_total").orderBy("member_id"))
    return totals.join(ahead.hint("merge"), [*keys, "pred_total"]).withColumn("rank", (F.col("_ahead") + place).cast("int")).drop("_ahead")


def sheet_ranks(exam: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """``rank_by_total`` of the complete students straight from the answer sheets: students are numbered in the tasks."""
    ranks = sitting_ranks(exam, answers, {m: (reference_by_model(m), m) for m in models})
    return ranks.select(F.col("view").alias("model_col"), *EXAM, "member_id", F.col("total").alias("pred_total"), "rank")


def student_scale_export(sat: DataFrame, model: str, cells: DataFrame | None = None) -> DataFrame:
    """Complete students with totals, grades, pass flags and rank for one score column (``cells``: already counted)."""
    return rank_by_total(student_scales(completeness_filter(student_exam_totals(sat, [model])), cells), cells)


def scope_semi_join(metrics: DataFrame, scope: DataFrame) -> DataFrame:
    return metrics.join(scope.select(*EXAM).distinct(), EXAM, "left_semi")


def item_metrics(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model on the original rows: n, valid, missing, errors, tau-b and kappa."""
    pair = lambda m: F.struct(F.lit(m).alias("model_col"), to_numeric(F.col(f"`{reference_by_model(m)}`")).alias("y"), to_numeric(F.col(f"`{m}`")).alias("p"))
    long = df.select(F.explode(F.array(*map(pair, models))).alias("_m")).select("_m.*")
    return grouped_item_metrics(long, ["model_col"])


def grouped_item_metrics(long: DataFrame, keys: list[str]) -> DataFrame:
    """Item metrics of (keys, y, p) rows."""
    y, p = F.col("y"), F.col("p")
    both = y.isNotNull() & p.isNotNull()
    vy, vp = F.when(both, y), F.when(both, p)
    base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_source_n"), F.count_if(both).alias("item_n"), F.count_if(~both).alias("item_missing"), mae(vy, vp).alias("item_mae"), mse(vy, vp).alias("item_mse"), F.sqrt(mse(vy, vp)).alias("item_rmse"))
    tau = kendall_tau_b(long, keys, "y", "p", "item_tau_b")
    kappa = qwk_observed(long, keys, "y", "p", "item_qwk").select(*keys, "item_qwk")
    return base.join(tau, keys, "left").join(kappa, keys, "left")


def annotator_agreement(df: DataFrame) -> DataFrame:
    """Kappa and tau-b between the two human graders."""
    return item_metrics(df, ["human_expert_two"]).select("item_n", "item_qwk", "item_tau_b")


def exam_confusion(scaled: DataFrame) -> DataFrame:
    """Counts of human against model grade per scale over exam-students."""
    return scale_pairs(scaled).groupBy("model_col", "scale", F.col("y").alias("gold"), F.col("p").alias("pred")).agg(F.sum("n").alias("n"))


def granularity_labels(cells: DataFrame, classes: Sequence[int] = tuple(range(2, 11))) -> DataFrame:
    """Human and model classes for every number of classes on the absolute and the rank-based scale.

    Rows of ``total_cells`` in, and rows that count n students each out.
    """
    out = _standing(cells)
    cuts = {n: [float(x) for x in __import__("itertools").accumulate(S.passing_distribution_interpolated(n - 1))] for n in classes}
    dimension = out.sparkSession.createDataFrame([(n, c) for n, c in cuts.items()], "n_classes int, cuts array<double>")
    out = out.crossJoin(F.broadcast(dimension))  # one small fixed row per class count

    def by_rank(s: str) -> Column:
        # The first cut that reaches the rank; the last cut always does.
        before = F.size(F.filter(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda c: F.ceil(F.col(f"_{s}_norm_passed") * c) < F.col(f"_{s}_rank")))
        return F.when(F.col(f"{s}_norm") >= S.PASS, F.col("n_classes") - 1 - before).otherwise(F.lit(0))

    absolute = F.struct(F.lit("absolute").alias("scale"), S.grade_abs_n_classes(F.col("gold_norm"), F.col("n_classes")).alias("y"), S.grade_abs_n_classes(F.col("pred_norm"), F.col("n_classes")).alias("p"))
    ranked = F.struct(F.lit("distribution").alias("scale"), by_rank("gold").cast("int").alias("y"), by_rank("pred").cast("int").alias("p"))
    long = out.select("model_col", *EXAM, "n_classes", "n", F.explode(F.array(absolute, ranked)).alias("_s"))
    return long.groupBy("model_col", *EXAM, "n_classes", "_s.scale", "_s.y", "_s.p").agg(F.sum("n").alias("n"))


def granularity_sweep(cells: DataFrame, classes: Sequence[int] = tuple(range(2, 11))) -> DataFrame:
    """Accuracy, fixed-class kappa and tau-b per model, exam, scale and number of classes."""
    keys = ["model_col", *EXAM, "scale", "n_classes"]
    labels = granularity_labels(cells, classes)
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    base = labels.groupBy(*keys).agg(F.sum("n").alias("n"), accuracy(y, p, n).alias("accuracy"), qwk_fixed(y, p, n).alias("qwk"))
    return base.join(tau_b_of_cells(labels, keys, "y", "p", "tau_b", "n"), keys, "left")


def granularity_summary(sweep: DataFrame) -> DataFrame:
    """Means and deviations over exams, and the order of models at the finest scale."""
    out = sweep.groupBy("model_col", "scale", "n_classes").agg(F.count(F.lit(1)).alias("n_exams"), *(a for c in ("accuracy", "qwk", "tau_b") for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count_if(F.col(c).isNull()).alias(f"{c}_missing"))))
    finest = out.where(F.col("n_classes") == 10).withColumn("model_order", F.row_number().over(Window.partitionBy("scale").orderBy(F.desc_nulls_last(F.round("qwk_mean", 9)), "model_col")))
    return out.join(F.broadcast(finest.select("model_col", "scale", "model_order")), ["model_col", "scale"], "left")


def scale_split_self_join(summary: DataFrame) -> DataFrame:
    """Rows with six classes, absolute and rank-based side by side."""
    six = summary.where(F.col("n_classes") == 6)
    side = lambda s: six.where(F.col("scale") == s).select("model_col", F.col("qwk_mean").alias(f"qwk_{s}"), F.col("accuracy_mean").alias(f"accuracy_{s}"))
    return side("absolute").join(side("distribution"), "model_col")
