"""Reproducible samples: exams, gold questions, balanced feedback."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .ranks import global_position
from .sheets import eligible, sittings


def question_pool(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Sorted distinct questions; fewer than the largest size is an error when the plan runs."""
    pool = df.where(F.col("question_id").isNotNull()).select("question_id").distinct()
    n = pool.agg(F.count(F.lit(1)).alias("n_questions"))
    need = max(sizes)
    return n.select("n_questions", F.when(F.col("n_questions") < need, F.raise_error(F.lit(f"fewer than {need} questions")).cast("boolean")).otherwise(True).alias("enough"))


def sample_exam_questions(questions: DataFrame, runs: int, sizes: Sequence[int], seed: int, exact_numpy: bool = False) -> DataFrame:
    """(test_id, test_size, question_id, question_order): ``size`` questions without replacement for
    each run and size, sizes independent of each other.

    The default ranks an md5 of (seed, run, size, question), which any engine can repeat.
    ``exact_numpy`` draws with NumPy from SeedSequence([seed, run, size]) instead.
    """
    spark = questions.sparkSession
    pool = questions.select("question_id").distinct()
    exams = spark.range(runs).select(F.col("id").cast("int").alias("run")).crossJoin(spark.createDataFrame([(int(s),) for s in sizes], "test_size int"))
    if exact_numpy:
        names = sorted(r["question_id"] for r in pool.collect())  # the question dimension

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for run, size in zip(frame["run"], frame["test_size"], strict=True):
                    rng = np.random.default_rng(np.random.SeedSequence([seed, int(run), int(size)]))
                    picked = sorted(rng.choice(names, size=int(size), replace=False).tolist())
                    yield pd.DataFrame({"test_id": f"test_{run}", "test_size": int(size), "question_id": picked, "question_order": range(1, int(size) + 1)})

        return exams.mapInPandas(draw, "test_id string, test_size int, question_id string, question_order int")
    ranked = exams.crossJoin(F.broadcast(pool)).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "run", "test_size", "question_id").cast("binary")))
    # The literal bound lets the plan keep the first questions of a group while it sorts.
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("run", "test_size").orderBy("_h", "question_id"))).where((F.col("_n") <= max(sizes)) & (F.col("_n") <= F.col("test_size")))
    return question_order_in_exam(ranked.select(F.concat(F.lit("test_"), "run").alias("test_id"), "test_size", "question_id"))


def question_order_in_exam(exam: DataFrame) -> DataFrame:
    return exam.withColumn("question_order", F.row_number().over(Window.partitionBy("test_id", "test_size").orderBy("question_id")))


def eligible_students(exam: DataFrame, answers: DataFrame) -> DataFrame:
    """Students with an answer to every question of an exam (relational division by bitmaps)."""
    return eligible(sittings(exam, answers))


def exam_structure_join(exam: DataFrame, students: DataFrame) -> DataFrame:
    return exam.join(students, ["test_id", "test_size"])


def exam_env_join(exam: DataFrame, students: DataFrame, answers: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """Exam questions x eligible students, with answers (question, member) and grades (answer)."""
    out = exam_structure_join(exam, students).join(answers, ["question_id", "member_id"], "left")
    return out.join(grades, "answer_id", "left") if grades is not None else out


def exam_structure_sums(exam: DataFrame, students: DataFrame) -> DataFrame:
    """Per exam and student of ``exam_structure_join``: n_questions and the sum of orders.

    Both are the exam's own, so they are worked out once an exam. ``students`` has a student of an exam once.
    """
    sums = exam.groupBy("test_id", "test_size").agg(F.count_distinct("question_id").alias("n_questions"), F.sum("question_order").alias("orders"))
    # A row for each exam.
    return students.join(F.broadcast(sums), ["test_id", "test_size"]).select("test_id", "test_size", "member_id", "n_questions", "orders")


def question_sets(exam: DataFrame, rows: DataFrame, key: str = "member_id") -> DataFrame:
    """(key, questions): which of all exams' questions each key has rows of, in order; keys without any are left out."""
    pool = exam.select("question_id").distinct()
    return rows.where(F.col(key).isNotNull()).join(F.broadcast(pool), "question_id").groupBy(key).agg(F.array_sort(F.collect_set("question_id")).alias("questions"))


def sets_in_exams(exam: DataFrame, sets: DataFrame) -> DataFrame:
    """(exam, questions, n, met) of the sets that share questions with an exam: n keys have that set, met questions are shared.

    Keys of equal sets are one, so the work follows the number of different sets, which is at most that of keys.
    """
    counts = sets.groupBy("questions").agg(F.count(F.lit(1)).alias("n"))
    met = exam.select("test_id", "test_size", "question_id").distinct().join(counts.select("questions", "n", F.explode("questions").alias("question_id")), "question_id")
    return met.groupBy("test_id", "test_size", "questions").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("met"))


def sets_that_sit(exam: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``sets_in_exams`` whose sets have all of an exam's ``test_size`` questions."""
    whole = exam.groupBy("test_id", "test_size").agg(F.count_distinct("question_id").alias("_q")).where("_q = test_size").select("test_id", "test_size")
    return met.where("met = test_size").join(whole, ["test_id", "test_size"])


def exam_env_sums(exam: DataFrame, answers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``exam_env_join`` over the eligible students, summed by exam and question without laying it out.

    n, answer_chars, first_answer, last_answer_id, students, and how many values (_n) and what sum
    (_sum) each column has. Answers are summed by question and set of questions that their students
    answered, and an exam adds up the sets that sit it.
    """
    sets = question_sets(exam, answers)
    by_set = answers.join(sets.hint("merge"), "member_id").groupBy("questions", "question_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("answer")).alias("answer_chars"), F.min("answer").alias("first_answer"), F.max("answer_id").alias("last_answer_id"), F.count_distinct("member_id").alias("students"),
        *(a for c in columns for a in (F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_sum"))),
    )
    sit = sets_that_sit(exam, sets_in_exams(exam, sets)).select("test_id", "test_size", "questions")
    met = exam.select("test_id", "test_size", "question_id").join(sit, ["test_id", "test_size"]).join(by_set, ["questions", "question_id"])
    total = lambda c: {"first_answer": F.min, "last_answer_id": F.max}.get(c, F.sum)(c).alias(c)
    return met.groupBy("test_id", "test_size", "question_id").agg(*(total(c) for c in by_set.columns if c not in ("questions", "question_id")))


def sample_gold_questions(df: DataFrame, share: float = 0.1, least: int = 10, seed: int = 7) -> DataFrame:
    """About ``share`` of the questions that have ``least`` answers, by hash rank; all their answers stay."""
    counts = df.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    keyed = counts.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("question_id")).cast("binary")))
    total = counts.agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("_k"))
    picked = global_position(keyed, ["_h", "question_id"], "_r").crossJoin(F.broadcast(total)).where("_r <= _k")
    return df.join(picked.select("question_id"), "question_id", "left_semi")


def feedback_eligibility(long: DataFrame) -> DataFrame:
    """Base answers that have a grade and a feedback text from some model, once each."""
    return long.where(F.col("model_grade").isNotNull() & F.col("model_feedback").isNotNull()).select("answer_id", "question_id").distinct()


def sample_balanced_feedback(long: DataFrame, seed: int = 1, slot_seed: int = 2, each: int = 2) -> DataFrame:
    """``each`` answers per question and model by hash rank, then dealt so that models share none.

    A question with fewer answers than models ask for leaves the last slots open.
    """
    h = lambda s: F.md5(F.concat(F.lit(f"{s}|"), F.col("answer_id")).cast("binary"))
    per = Window.partitionBy("question_id")
    models = long.select("model_name").distinct().withColumn("_slot", F.row_number().over(Window.orderBy("model_name")) - 1)  # a row a model
    base = models.agg((F.count(F.lit(1)) * each).alias("_base"))
    chosen = feedback_eligibility(long).withColumn("_r", F.row_number().over(per.orderBy(h(seed), "answer_id"))).crossJoin(F.broadcast(base)).where("_r <= _base").drop("_base")
    slots = chosen.withColumn("_slot", ((F.row_number().over(per.orderBy(h(slot_seed), "answer_id")) - 1) / each).cast("int"))
    paired = slots.join(F.broadcast(models), "_slot").select("answer_id", "question_id", "model_name")
    return paired.join(long.select("answer_id", "model_name", "model_grade"), ["answer_id", "model_name"])


def question_model_row_index(sample: DataFrame) -> DataFrame:
    return sample.withColumn("row_index", F.row_number().over(Window.partitionBy("question_id", "model_name").orderBy("answer_id")))
