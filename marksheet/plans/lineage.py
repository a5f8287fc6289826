"""The dataset release as a chain of table steps, each ``df -> df``; versions may be saved on the way."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..operators import clean as K, joins as J
from ..sources.io import sink_parquet


def export(members: DataFrame, answers: DataFrame, gradings: DataFrame, feedback: DataFrame) -> DataFrame:
    return J.join_with_feedback(J.join_with_gradings(J.join_members_answers(members, answers), gradings), feedback)


def steps(meta: DataFrame, denied_members: DataFrame, denied_question: str) -> Mapping[str, Callable[[DataFrame], DataFrame]]:
    """Version name to step, in order."""
    return {
        "metadata": lambda df: J.question_metadata_join(df, meta),
        "dedup": lambda df: J.dedup_first_by_key(df, ["answer_id"], ["grading_id"]),
        "deny": lambda df: K.deny_question(K.deny_list(df, "member_id", denied_members), denied_question),
        "grade": lambda df: K.derive_label_type_split(df.withColumn("grade", F.when(F.col("rating").isNotNull(), F.col("accuracy")))),
        "teacher": lambda df: K.fill_grade_from_teacher(df, "accuracy"),
        "clamp": lambda df: df.withColumn("grade", C.clamp_grade(F.col("grade"))),
        "release": lambda df: K.schema_evolution(df, drop=["comment", "rating", "accuracy", "content"], rename={"name": "student_name"}),
    }


def release(raw: DataFrame, chain: Mapping[str, Callable[[DataFrame], DataFrame]], save_to: str | None = None) -> DataFrame:
    """All steps in one lazy plan, or with a table per version under ``save_to``."""
    df = raw
    for name, step in chain.items():
        df = df.transform(step)
        if save_to:
            df = sink_parquet(df, f"{save_to}/{name}.parquet")
    return df
