"""Joins, duplicates, set comparisons. Sizes are left to the planner: small sides broadcast by AQE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as C
from ..sources.io import settled


def join_members_answers(members: DataFrame, answers: DataFrame) -> DataFrame:
    m = members.select(F.col("id").alias("member_id"), "name", "subject_id")
    a = answers.select(F.col("id").alias("answer_id"), "shared_member_id", "question_id", "content")
    return m.join(a, m["member_id"] == a["shared_member_id"]).drop("shared_member_id")


def join_with_gradings(joined: DataFrame, gradings: DataFrame) -> DataFrame:
    return joined.join(gradings.select(F.col("id").alias("grading_id"), "answer_id", "accuracy"), "answer_id")


def join_with_feedback(joined: DataFrame, feedback: DataFrame) -> DataFrame:
    return joined.join(feedback.select("grading_id", "rating", "comment"), "grading_id", "left")


def lost_rows_count(base: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Non-null keys without a partner (NOT IN over non-null keys)."""
    left = base.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    return left.join(other.select(F.col(other_key).alias("_k")).distinct(), "_k", "left_anti").agg(F.count(F.lit(1)).alias("lost"))


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat, with their counts: empty when a join on them is to-one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], shown: int = 50) -> DataFrame:
    """Raise with up to ``shown`` repeated keys; a job over counts only."""
    found = not_unique(df, keys).limit(shown).collect()
    if found:
        raise ValueError(f"repeated {tuple(keys)}: {[tuple(r) for r in found]}")
    return df


def question_metadata_join(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Bloom level and topic by question id as text."""
    m = meta.select(F.col("id").cast("string").alias("question_id"), F.col("bloom").alias("bloom_level"), F.col("topic").alias("question_topic"))
    return df.withColumn("question_id", F.col("question_id").cast("string")).join(m, "question_id", "left")


def id_overlap_stats(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = (d.select(F.col(key).cast("string").alias("k")).where("k IS NOT NULL").distinct() for d in (a, b))
    both = x.withColumn("in_a", F.lit(1)).join(y.withColumn("in_b", F.lit(1)), "k", "full")
    return both.agg(F.count("in_a").alias("ids_left"), F.count("in_b").alias("ids_right"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("ids_both"), F.count_if(F.col("in_b").isNull()).alias("missing_after_join"))


def shadow_key(text):
    """Text reduced to a-z and 0-9."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def shadow_key_join(master: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels onto master rows by question and reduced text; the first label per key in order of its value."""
    keyed = labels.withColumn("_shadow", shadow_key(F.col("answer"))).groupBy("question_id", "_shadow").agg(F.min("label").alias("label"))
    return master.withColumn("_shadow", shadow_key(F.col("answer"))).join(keyed, ["question_id", "_shadow"], "left").drop("_shadow")


def dedup_first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in an explicit total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(not_unique(df, keys).drop("n"), list(keys), "left_semi")


def silver_label_merge(master: DataFrame, result: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Only the columns the master lacks; the first row of a key wins."""
    new = [c for c in result.columns if c not in master.columns]
    return master.join(dedup_first_by_key(result, [key], order).select(key, *new), key, "left")


def audited_grade_merge(predictions: DataFrame, audit: DataFrame) -> DataFrame:
    """Both graders' grades onto predictions, one to one; a missing grade is an error when the plan runs."""
    out = predictions.join(audit.select("answer_id", "human_1", "human_2"), "answer_id", "left")
    return out.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no audited grade for "), F.col("answer_id"))).cast("double")).otherwise(F.col(c)) for c in ("human_1", "human_2")})


def audit_grade_consistency(audit: DataFrame, grade: str, label: str) -> DataFrame:
    """Rows whose stored grade differs from the mapped label; both missing counts as equal."""
    mapped = C.grade_label_to_number(F.col(label), strict=False)
    return audit.withColumn("mapped", mapped).where(~F.col(grade).eqNullSafe(F.col("mapped")))


def paired_model_join(labels: DataFrame, a: str, b: str, keys: Sequence[str] = ("test_id", "test_size", "member_id")) -> DataFrame:
    """Two models side by side on the same exam-student, with whether their reference labels agree."""
    side = lambda m, s: labels.where(F.col("model_col") == m).select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in labels.columns if c not in (*keys, "model_col")))
    return side(a, "a").join(side(b, "b"), list(keys))


def item_exam_metric_join(item: DataFrame, exam: DataFrame) -> DataFrame:
    return item.join(exam, "model_col", "left")


def resume_anti_join(todo: DataFrame, done: DataFrame, key: str = "grading_id") -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def duplicate_report(exam: DataFrame, answers: DataFrame) -> DataFrame:
    """Student-question pairs of an exam answered more than once."""
    return exam.join(not_unique(answers, ["member_id", "question_id"]), "question_id").select("test_id", "test_size", "member_id", "question_id", F.col("n").alias("n_answers"))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    for d in others:
        first = first.unionByName(d, allowMissingColumns=True)
    return first


def question_leakage(df: DataFrame) -> DataFrame:
    """Questions in both splits: should be empty."""
    of = lambda s: df.where(F.col("split") == s).select("question_id")
    return of("train").intersect(of("test"))


def model_key_sets(labels: DataFrame, keys: Sequence[str] = ("test_id", "test_size", "member_id")) -> DataFrame:
    """Per model: exam-students missing from and extra to those of the first model by name."""
    held = labels.groupBy(*keys).agg(F.collect_set("model_col").alias("models"))
    return key_sets_of_states(held.groupBy("models").agg(F.count(F.lit(1)).alias("n")))


def key_sets_of_states(held: DataFrame) -> DataFrame:
    """``model_key_sets`` of (models, n): how many keys n have the same set of models."""
    held = settled(held.groupBy(F.array_sort("models").alias("models")).agg(F.sum("n").alias("n")), "key_sets")
    one = held.select(F.explode("models").alias("model_col")).distinct()
    first = held.agg(F.min(F.array_min("models")).alias("_first"))
    based, own = F.array_contains("models", F.col("_first")), F.array_contains("models", F.col("model_col"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    # A row per model, and a row per set of models.
    return held.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(one)).groupBy("model_col").agg(count(based & ~own).alias("missing"), count(~based & own).alias("extra"))


def expected_models_present(labels: DataFrame, models: Sequence[str]) -> DataFrame:
    """Missing and extra models."""
    want = labels.sparkSession.createDataFrame([(m,) for m in models], "model_col string")
    have = labels.select("model_col").distinct()
    return want.exceptAll(have).withColumn("state", F.lit("missing")).union(have.exceptAll(want).withColumn("state", F.lit("extra")))
