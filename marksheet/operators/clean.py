"""Filters, projections and schema changes on whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import columns as C


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise with the missing names; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def infer_model_columns(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    """Columns with a model prefix that hold at least one number, by one aggregate over all of them."""
    named = [c for c in df.columns if c.startswith(tuple(prefixes))]
    if not named:
        return []
    counts = df.agg(*(F.count(C.to_numeric(F.col(f"`{c}`"))).alias(c) for c in named)).first()
    return [c for c in named if counts[c]]


def valid_key_filter(df: DataFrame) -> DataFrame:
    """Rows whose question, member and answer ids are not blank, with the ids normalised. Empty answer text stays."""
    keys = ("question_id", "member_id", "answer_id")
    out = df.withColumns({k: C.normalize_key(F.col(k)) for k in keys})
    return out.where(" AND ".join(f"{k} <> ''" for k in keys))


def key_filter_counters(df: DataFrame) -> DataFrame:
    blank = lambda c: C.normalize_key(F.col(c)) == ""
    ok = ~blank("question_id") & ~blank("member_id") & ~blank("answer_id")
    return df.agg(
        F.count(F.lit(1)).alias("rows_raw"), F.count_if(blank("question_id")).alias("missing_question"), F.count_if(blank("member_id")).alias("missing_member"),
        F.count_if(blank("answer_id")).alias("missing_answer"), F.count_if(blank("answer")).alias("empty_text"), F.count_if(ok).alias("rows_valid"),
    )


def valid_grade_filter(df: DataFrame, column: str = "grade") -> DataFrame:
    return df.where(C.to_numeric(F.col(column)).isin(*C.GRADES))


def clamp_grades(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The clipped table, and how many values changed."""
    clipped = C.clamp_grade(F.col(column))
    return df.withColumn(column, clipped), df.agg(F.count_if(clipped != F.col(column)).alias("n_clamped"))


def derive_label_type_split(df: DataFrame) -> DataFrame:
    graded = F.col("grade").isNotNull()
    return df.withColumns({"label_type": F.when(graded, "gold").otherwise("silver"), "split": F.when(graded, "test").otherwise("train")})


def fill_grade_from_teacher(df: DataFrame, teacher: str) -> DataFrame:
    return df.withColumn("grade", F.coalesce("grade", F.col(teacher)))


def deny_list(df: DataFrame, key: str, denied: DataFrame) -> DataFrame:
    """Rows whose key is not listed; null keys stay."""
    return df.join(denied.select(F.col(denied.columns[0]).alias(key)), key, "left_anti")


def deny_question(df: DataFrame, question: str) -> DataFrame:
    return df.where(~F.col("question_id").eqNullSafe(F.lit(question)))


def reduce_to_gold_test(df: DataFrame) -> DataFrame:
    return df.where("label_type = 'gold' AND split = 'test'")


def gold_scope(df: DataFrame) -> DataFrame:
    low = lambda c: F.lower(C.trim(F.col(c)))
    return df.where((low("label_type") == "gold") & (low("split") == "test"))


def schema_evolution(df: DataFrame, add: Mapping[str, T.DataType] | None = None, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Add missing columns as null, drop, rename, then order."""
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in (add or {}).items() if c not in df.columns}).drop(*drop).withColumnsRenamed(dict(rename or {}))
    return out.select(*order) if order else out


def select_model_category(models: DataFrame, excluded: DataFrame) -> DataFrame:
    return models.join(excluded, "model_col", "left_anti")


def annotator_swap_fix(df: DataFrame, first: str) -> DataFrame:
    """Grader one's values in slot 1 where a row has the two graders switched."""
    switched = F.col("grader_name_2") == first
    pairs = [("grader_name_1", "grader_name_2"), ("human_grade_1", "human_grade_2"), ("is_llm_1", "is_llm_2")]
    return df.withColumns({a: F.when(switched, F.col(b)).otherwise(F.col(a)) for a, b in pairs} | {b: F.when(switched, F.col(a)).otherwise(F.col(b)) for a, b in pairs})


def training_text_assembly(df: DataFrame) -> DataFrame:
    """Model input and JSON target for silver train and gold test rows with a grade of the scale."""
    chosen = df.where(((F.col("label_type") == "silver") & (F.col("split") == "train")) | ((F.col("label_type") == "gold") & (F.col("split") == "test")))
    text = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    return valid_grade_filter(chosen).select("answer_id", "split", text.alias("input_text"), F.concat(F.lit('{"grade":'), F.col("grade").cast("string"), F.lit("}")).alias("target"))


def prediction_postprocess(df: DataFrame, raw: str) -> DataFrame:
    return df.withColumns({"clipped": C.clamp_grade(F.col(raw)), "snapped": C.snap_to_grade(F.col(raw))})
