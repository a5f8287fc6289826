"""Analytics tables: dataset statistics, distributions, difficulty, summaries of metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import columns as C
from ..functions.quantiles import exact_quantiles
from ..sources.io import settled
from .exam import METRICS, grouped_item_metrics
from .ranks import global_position
from .sampling import question_sets, sets_in_exams, sets_that_sit

GRADE_ROWS = C.GRADES
# Answer length bins [low, high) and their labels; Bloom levels in order.
LENGTH_BINS = ((0, 1, "0"), (1, 3, "1-2"), (3, 5, "3-4"), (5, 10, "5-9"), (10, 20, "10-19"), (20, 40, "20-39"), (40, 80, "40-79"), (80, 160, "80-159"), (160, None, "160+"))
BLOOM = ("remember", "understand", "apply", "analyse")
RUBRIC = ("diag", "ground", "align", "action", "spec", "tone")


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def _as_text(c: str, kind: T.DataType) -> Column:
    """A column as a string that is equal for equal values only; zeros of both signs are equal, NaNs too."""
    v = F.col("`" + c.replace("`", "``") + "`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = v + F.lit(0.0)
    elif isinstance(kind, T.TimestampType):  # as printed, an hour would come twice when clocks go back
        v = F.unix_micros(v)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(v, {"ignoreNullFields": "false"})
    return v.cast("string")


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing, distinct, share of distinct among non-null.

    One scan: a row becomes one short row (column number, value) for each of its columns, tasks count
    theirs before the shuffle, and missing values are one more value. Distinct counts are exact. A
    table without rows has 0 everywhere and no share; one without columns gives no rows. Zeros of
    both signs inside arrays and structs count as two values.
    """
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "_i int, column_name string, type string")
    if not df.columns:
        cells = names.select("_i", F.lit("").alias("_v"))
    else:
        cells = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), _as_text(f.name, f.dataType).alias("_v")) for i, f in enumerate(df.schema)))))
    values = cells.groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = values.groupBy("_i").agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_v").isNull(), F.col("_n")).otherwise(0)).alias("m"), F.count("_v").alias("d"))
    n, m, d = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "m", "d"))
    return F.broadcast(names).join(found, "_i", "left").select("column_name", "type", m.alias("missing"), d.alias("n_distinct"), (F.try_divide(d.cast("double"), (n - m).cast("double")) * 100).alias("unique_pct"), n.alias("n_rows"))


def _label_type() -> Column:
    return F.lower(C.trim(F.coalesce("label_type", F.lit(""))))


def label_type_counts(df: DataFrame) -> DataFrame:
    t = _label_type()
    return df.agg(F.count_if(t == "gold").alias("gold"), F.count_if(t == "silver").alias("silver"), F.count_if(~t.isin("gold", "silver")).alias("other"))


def response_language_split(df: DataFrame) -> DataFrame:
    """Responses by question language; unknown counts as English and is reported too."""
    lang = df.select(C.detect_language(F.col("question")).alias("l"))
    pct = lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))
    de, unknown = F.col("l") == "de", F.col("l") == "unknown"
    return lang.agg(F.count_if(~de).alias("english"), F.count_if(de).alias("german"), F.count_if(unknown).alias("unknown_counted_as_english"), pct(~de).alias("english_pct"), pct(de).alias("german_pct"), pct(unknown).alias("unknown_pct"))


def per_group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def core_dataset_statistics(df: DataFrame) -> DataFrame:
    """The figures of the full table and of its gold rows, one row per scope.

    One aggregate over the rows, and one each over the sizes of questions and of students.
    """
    t, lang, length = _label_type(), C.detect_language(F.col("question")), C.token_count_whitespace(F.col("answer"))
    scopes = F.explode(F.when(t == "gold", F.array(F.lit("full"), F.lit("gold"))).otherwise(F.array(F.lit("full"))))
    rows = df.select(scopes.alias("scope"), "member_id", "question_id", t.alias("_t"), lang.alias("_l"), length.alias("_w"))
    de, unknown, one = F.col("_l") == "de", F.col("_l") == "unknown", F.count(F.lit(1))
    pct = lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))
    base = rows.groupBy("scope").agg(
        F.count_distinct("member_id").alias("students"), one.alias("responses"), F.avg("_w").alias("mean_length"), median(F.col("_w")).alias("median_length"), F.count_distinct("question_id").alias("questions"),
        F.count_if(~de).alias("english"), F.count_if(de).alias("german"), F.count_if(unknown).alias("unknown_counted_as_english"), pct(~de).alias("english_pct"), pct(de).alias("german_pct"), pct(unknown).alias("unknown_pct"),
        F.count_if(F.col("_t") == "gold").alias("gold"), F.count_if(F.col("_t") == "silver").alias("silver"), F.count_if(~F.col("_t").isin("gold", "silver")).alias("other"),
    )
    for key, p in (("question_id", "question"), ("member_id", "student")):
        sizes = rows.groupBy("scope", key).agg(F.count(F.lit(1)).alias("n"))
        base = base.join(sizes.groupBy("scope").agg(F.avg("n").alias(f"mean_per_{p}"), median(F.col("n")).alias(f"median_per_{p}")), "scope")
    return base


def release_statistics(df: DataFrame) -> DataFrame:
    """As above for the release; missing text has no length."""
    length = F.when(F.col("answer").isNotNull(), C.token_count_whitespace(F.col("answer")))
    base = df.agg(F.count_distinct("member_id").alias("students"), F.count(F.lit(1)).alias("responses"), F.count_distinct("question_id").alias("questions"), F.count_if(F.col("label_type") == "gold").alias("gold"), F.avg(length).alias("mean_length"), median(length).alias("median_length"))
    for p, k in (("student", "member_id"), ("question", "question_id")):
        base = base.crossJoin(per_group_sizes(df.where(F.col(k).isNotNull()), k).agg(F.avg("n").alias(f"mean_per_{p}"), median(F.col("n")).alias(f"median_per_{p}")))
    return base


def _rows(df: DataFrame, values: Sequence[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(list(values), schema))


def grade_distribution_by_scope(df: DataFrame) -> DataFrame:
    """Count and percent of every grade for all, gold and silver rows; grades without rows count 0."""
    scopes = df.select("grade", F.explode(F.array(F.lit("full"), _label_type())).alias("scope")).where("scope IN ('full', 'gold', 'silver')")
    counts = scopes.groupBy("scope", "grade").agg(F.count(F.lit(1)).alias("c"))
    grid = _rows(df, [(s, g) for s in ("full", "gold", "silver") for g in GRADE_ROWS], "scope string, grade double")
    out = grid.join(counts, ["scope", "grade"], "left").withColumn("n", F.coalesce("c", F.lit(0)))
    return out.select("scope", "grade", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy("scope"))), F.lit(0.0)).alias("pct"))


def bands(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """How many keys have under ``low``, ``low`` to ``high`` - 1, and ``high`` rows or more."""
    return per_group_sizes(df, key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") < low).alias("low"), F.count_if((F.col("n") >= low) & (F.col("n") < high)).alias("middle"), F.count_if(F.col("n") >= high).alias("high"))


def engagement_by_week(df: DataFrame, ts: str, weeks: int = 18) -> DataFrame:
    """Responses in each week since the first, weeks without any count 0."""
    first = df.agg(F.min(ts).alias("_first"))
    week = F.floor(F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 86_400_000_000) / 7) + 1
    counts = df.crossJoin(F.broadcast(first)).groupBy(week.cast("int").alias("week")).agg(F.count(F.lit(1)).alias("c"))
    return df.sparkSession.range(1, weeks + 1).select(F.col("id").cast("int").alias("week")).join(counts, "week", "left").select("week", F.coalesce("c", F.lit(0)).alias("n"))


def describe_column(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a column of any length."""
    v = F.col(c).cast("double")
    quartiles = dict(zip(("q25", "q50", "q75"), exact_quantiles(df, v, (0.25, 0.5, 0.75)), strict=True))
    stats = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return stats.select("count", "mean", "std", "min", *(F.lit(q).cast("double").alias(n) for n, q in quartiles.items()), "max")


def bloom_difficulty(df: DataFrame) -> DataFrame:
    work = df.withColumn("bloom_level", F.lower(C.trim(F.col("bloom_level")))).where(F.col("bloom_level").isin(*BLOOM))
    return work.groupBy("bloom_level").agg(F.count(F.lit(1)).alias("responses"), F.count_distinct("question_id").alias("questions"), F.count_distinct("member_id").alias("students"), F.avg("grade").alias("mean_score"), median(F.col("grade")).alias("median_score"), (1 - F.avg("grade")).alias("difficulty"))


def bloom_model_metrics(df: DataFrame, models: Sequence[str]) -> DataFrame:
    long = df.select("bloom_level", F.explode(F.array(*(F.struct(F.lit(m).alias("model_col"), F.col("grade").alias("y"), F.col(f"`{m}`").alias("p")) for m in models))).alias("m")).select("bloom_level", "m.*")
    out = grouped_item_metrics(long, ["model_col", "bloom_level"])
    return out.select("model_col", C.model_family(F.col("model_col")).alias("family"), "bloom_level", F.col("item_n").alias("n"), F.col("item_mae").alias("mae"), F.col("item_mse").alias("mse"), F.col("item_qwk").alias("qwk"), F.col("item_tau_b").alias("tau_b"))


def bloom_family_metrics(m: DataFrame) -> DataFrame:
    return m.groupBy("family", "bloom_level").agg(F.count_distinct("model_col").alias("n_models"), F.avg("n").alias("n_items_mean"), *(F.avg(c).alias(f"{c}_mean") for c in ("mae", "mse", "qwk", "tau_b")))


def length_by_grade(df: DataFrame) -> DataFrame:
    stats = df.select("grade", C.token_count_whitespace(F.col("answer")).alias("w")).groupBy("grade").agg(F.count(F.lit(1)).alias("c"), F.avg("w").alias("mean_words"), median(F.col("w")).alias("median_words"), F.percentile("w", F.lit(0.75)).alias("p75_words"))
    return _rows(df, [(g,) for g in GRADE_ROWS], "grade double").join(stats, "grade", "left").select("grade", F.coalesce("c", F.lit(0)).alias("n"), "mean_words", "median_words", "p75_words")


def group_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count of each value and its percent of the group."""
    out = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(group)))


def question_difficulty(df: DataFrame) -> DataFrame:
    """Questions hardest first; ties by id."""
    out = df.groupBy("question_id", "bloom_level").agg(F.avg("grade").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return global_position(out, ["mean_score", "question_id"])


def question_grade_share(df: DataFrame) -> DataFrame:
    return group_share(df, "question_id", "grade").join(question_difficulty(df).select("question_id", "position"), "question_id")


def student_performance(df: DataFrame, bins: int = 15) -> DataFrame:
    out = df.groupBy("member_id").agg(F.avg("grade").alias("mean_score"), median(F.col("grade")).alias("median_score"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("bin", F.least(F.floor(F.col("mean_score") * bins), F.lit(bins - 1)).cast("int"))


def llm_rate_by_length(df: DataFrame, answer: str, flag: str) -> DataFrame:
    """Nine length bins with rows, LLM rows, rate and mean and median length; empty bins are shown."""
    work = df.select(C.token_count_whitespace(F.col(answer)).alias("w"), (C.yes_no_unknown(F.col(flag)) == "Yes").cast("int").alias("yes"))
    of = F.lit(None).cast("string")
    for low, _, label in LENGTH_BINS:
        of = F.when(F.col("w") >= low, label).otherwise(of)
    stats = work.groupBy(of.alias("length_bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("yes").alias("y"), F.avg("w").alias("mean_tokens"), median(F.col("w")).alias("median_tokens"))
    return _rows(df, [(label,) for *_, label in LENGTH_BINS], "length_bin string").join(stats, "length_bin", "left").select("length_bin", F.coalesce("c", F.lit(0)).alias("responses"), F.coalesce("y", F.lit(0)).alias("llm_count"), F.try_divide(F.col("y") * 100.0, F.col("c")).alias("llm_rate_pct"), "mean_tokens", "median_tokens")


def teacher_evaluation(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model: rows, valid, missing, questions, students, errors, tau-b and kappa."""
    long = df.select("question_id", "member_id", F.explode(F.array(*(F.struct(F.lit(m).alias("model_col"), C.to_numeric(F.col("grade")).alias("y"), C.to_numeric(F.col(f"`{m}`")).alias("p")) for m in models))).alias("m")).select("question_id", "member_id", "m.*")
    both = F.col("y").isNotNull() & F.col("p").isNotNull()
    who = long.where(both).groupBy("model_col").agg(F.count_distinct("question_id").alias("questions"), F.count_distinct("member_id").alias("students"))
    return grouped_item_metrics(long, ["model_col"]).join(who, "model_col", "left")


def confusion_long(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Gold against predicted counts, zeros for unseen pairs of the labels a model's rows show."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model_col"), F.col("grade").alias("gold"), F.col(f"`{m}`").alias("pred")) for m in models))).alias("m")).select("m.*").where("gold IS NOT NULL AND pred IS NOT NULL")
    counts = long.groupBy("model_col", "gold", "pred").agg(F.count(F.lit(1)).alias("c"))
    seen = counts.select("model_col", F.explode(F.array("gold", "pred")).alias("v")).distinct()
    grid = seen.withColumnRenamed("v", "gold").join(seen.withColumnRenamed("v", "pred"), "model_col")  # grade labels only
    return grid.join(counts, ["model_col", "gold", "pred"], "left").select("model_col", "gold", "pred", F.coalesce("c", F.lit(0)).alias("n"))


def feedback_quality(df: DataFrame) -> DataFrame:
    """Rubric means, overall, content, tone gap and percent low quality per model and over all."""
    def mean_of(cols: Sequence[str]) -> Column:
        values = F.array_compact(F.array(*cols))
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))

    work = df.withColumns({"mean": mean_of(RUBRIC), "content": mean_of(RUBRIC[:-1])})
    work = work.withColumns({"gap": F.col("tone") - F.col("content"), "low": F.coalesce((F.col("diag") <= 2) & (F.col("align") <= 2), F.lit(False)).cast("int")})
    stats = [*(F.avg(c).alias(c) for c in (*RUBRIC, "mean", "content", "gap")), (F.avg("low") * 100).alias("low_quality_rate")]
    return work.groupBy("model").agg(*stats).unionByName(work.agg(*stats).withColumn("model", F.lit("overall")))


def family_summary(summary: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Mean of model means per family and size."""
    return summary.groupBy(C.model_family(F.col("model_col")).alias("family"), "test_size").agg(F.count_distinct("model_col").alias("n_models"), *(F.avg(f"{c}_mean").alias(c) for c in names))


def metric_curves(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, deviation, n and missing of model means per size and metric."""
    long = summary.select("test_size", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"{c}_mean").alias("v")) for c in names))).alias("m")).select("test_size", "m.*")
    return long.groupBy("test_size", "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"))


def size_delta(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """Change of each metric from the smallest to the largest size per model."""
    return summary.groupBy("model_col").agg(*((F.max_by(f"{c}_mean", "test_size") - F.min_by(f"{c}_mean", "test_size")).alias(f"{c}_delta") for c in names))


def calibration_gap(summary: DataFrame) -> DataFrame:
    return summary.select("model_col", "test_size", (F.col("el_qwk_bologna_mean") - F.col("el_qwk_linear_abs_mean")).alias("gap"))


def tau_gain(item: DataFrame, summary: DataFrame) -> DataFrame:
    return summary.join(item.select("model_col", "item_tau_b"), "model_col").select("model_col", "test_size", "item_tau_b", (F.col("el_tau_b_mean") - F.col("item_tau_b")).alias("gain"))


#: Columns whose values an exam tells of, by what they are called there.
DISTRIBUTIONS = {"bloom_distribution": "bloom_level", "topic_distribution": "question_topic"}


def exam_metadata(exam: DataFrame, raw: DataFrame, valid: DataFrame) -> DataFrame:
    """Per exam: its questions, rows, students, answers and empty answers among all, valid and eligible
    rows, the eligible students by name, and what Bloom levels and topics all rows have, where ``raw`` has those.

    Rows are counted by question, and students and answer ids by the set of questions that they have
    rows of, before exams are met. An exam without rows has zeros.
    """
    keys = ["test_id", "test_size"]
    exam = settled(exam.select(*keys, "question_id").distinct(), "exams")
    empty = F.col("answer").isNull() | (C.trim(F.col("answer")) == "")
    counts = [F.count(F.lit(1)).alias("_rows"), F.count_if(empty).alias("_empty")]

    def part(name: str, met: DataFrame, *more) -> DataFrame:
        return met.groupBy(*keys).agg(F.sum("_rows").alias(f"rows_{name}"), F.sum("_empty").alias(f"empty_{name}"), *more)

    def distinct(rows: DataFrame, key: str, name: str) -> DataFrame:
        return sets_in_exams(exam, question_sets(exam, rows, key)).groupBy(*keys).agg(F.sum("n").alias(name))

    # Different sets get numbers; students and rows carry those.
    sets = settled(question_sets(exam, valid), "sets")
    numbered = settled(sets.select("questions").distinct().withColumn("set", F.monotonically_increasing_id()), "numbers")
    students = settled(sets.join(numbered, "questions").select("member_id", "set"), "students")
    sit = settled(sets_that_sit(exam, sets_in_exams(exam, sets)).join(numbered, "questions").select(*keys, "set", "n"), "sit")
    rows = valid.join(students.hint("merge"), "member_id")
    by_set = rows.groupBy("set", "question_id").agg(*counts)
    # An answer id is mostly used for one question by students of one set; such ids are counted with the rows.
    used = rows.where("answer_id IS NOT NULL").groupBy("answer_id").agg(F.array_sort(F.collect_set(F.struct("set", "question_id"))).alias("uses"))
    used = settled(used.groupBy("uses").agg(F.count(F.lit(1)).alias("_answers")), "uses")
    once = used.where("size(uses) = 1").select(F.col("uses")[0]["set"].alias("set"), F.col("uses")[0]["question_id"].alias("question_id"), "_answers")
    often = used.where("size(uses) > 1").withColumn("_id", F.monotonically_increasing_id()).select("_answers", "_id", F.explode("uses").alias("_u")).select("_answers", "_id", "_u.*")
    seats = exam.join(sit.select(*keys, "set"), keys)
    several = seats.join(often, ["set", "question_id"]).select(*keys, "_id", "_answers").distinct().groupBy(*keys).agg(F.sum("_answers").alias("_several"))
    eligible = part("eligible", seats.join(by_set.join(once, ["set", "question_id"], "left"), ["set", "question_id"]), F.sum("_answers").alias("_once"))
    # Names come in arrays, so that an exam meets few rows.
    names = students.groupBy("set", F.pmod(F.xxhash64("member_id"), F.lit(64)).alias("_part")).agg(F.collect_list(F.col("member_id").cast("string")).alias("_m"))
    sitting = sit.join(names, "set").groupBy(*keys).agg(F.array_join(F.sort_array(F.flatten(F.collect_list("_m"))), ",").alias("student_ids"))
    out = exam.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col("question_id").cast("string"))), ",").alias("question_ids"))
    for more in (
        part("all", exam.join(raw.groupBy("question_id").agg(*counts), "question_id")), distinct(raw, "member_id", "students_all"), distinct(raw, "answer_id", "answers_all"),
        part("valid", exam.join(valid.groupBy("question_id").agg(*counts), "question_id")), distinct(valid, "member_id", "students_valid"), distinct(valid, "answer_id", "answers_valid"),
        eligible, several, sit.groupBy(*keys).agg(F.sum("n").alias("eligible_students")), sitting, *(distribution_text(exam_value_distribution(exam, raw, c), name) for name, c in DISTRIBUTIONS.items() if c in raw.columns),
    ):
        out = out.join(more, keys, "left")
    return out.na.fill(0).na.fill("").withColumn("answers_eligible", F.col("_once") + F.col("_several")).drop("_once", "_several")


def distribution_text(shares: DataFrame, name: str) -> DataFrame:
    """An exam's values as lines of ``value=n (share)``, the most frequent first, the share to four places."""
    exam = Window.partitionBy("test_id", "test_size")
    part = F.rint(F.col("n") * 10_000.0 / F.sum("n").over(exam)).cast("long")
    line = F.concat("value", F.lit("="), F.col("n").cast("string"), F.lit(" ("), F.floor(F.col("_p") / 10_000).cast("string"), F.lit("."), F.lpad((F.col("_p") % 10_000).cast("string"), 4, "0"), F.lit(")"))
    lines = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "value", line.alias("line"))))
    return shares.withColumn("_p", part).groupBy("test_id", "test_size").agg(F.array_join(lines["line"], "\n").alias(name))


def exam_value_distribution(exam: DataFrame, raw: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values by exam; values are counted by question before exams are met."""
    value = C.trim(F.col(column).cast("string"))
    by_question = raw.select("question_id", value.alias("value")).where("value <> ''").groupBy("question_id", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = exam.select("test_id", "test_size", "question_id").join(by_question, "question_id").groupBy("test_id", "test_size", "value").agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("test_id", "test_size")))


def metric_min_rank(m: DataFrame, names: Sequence[str]) -> DataFrame:
    """Minimum rank of each metric, larger better, missing last. ``m`` has a row per model."""
    return m.select("model_col", *(F.rank().over(Window.orderBy(F.desc_nulls_last(c))).alias(f"{c}_rank") for c in names))


def metric_ordinal_rank(m: DataFrame, c: str, ascending: bool = False) -> DataFrame:
    order = F.asc(c) if ascending else F.desc(c)
    return m.where(F.col(c).isNotNull()).select("model_col", c, F.row_number().over(Window.orderBy(order, "model_col")).alias("position"))


def natural_test_order(exams: DataFrame) -> DataFrame:
    """Position with test_2 before test_10; ids without a number last."""
    number = F.regexp_extract("test_id", r"(\d+)$", 1).try_cast("long")
    return exams.select("test_id").distinct().withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last(number), "test_id")))


def gold_release_checks(df: DataFrame) -> DataFrame:
    """Rows that break each release rule, in one aggregate."""
    status = C.audit_status(F.col("human_expert_one_gold"), F.col("human_expert_two"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("grade").isin(*C.GRADES)).alias("off_scale"), F.count_if(status != "within_threshold").alias("open_audit"), F.count_if(F.col("grade").isNull()).alias("missing_grade"),
        F.count_if(C.token_count_whitespace(F.col("answer")) == 0).alias("empty_answers"), F.count_if(C.yes_no_unknown(F.col("gold_is_llm")) == "Yes").alias("llm_answers"), *(F.count_if(F.col("bloom_level") == b).alias(f"n_{b}") for b in BLOOM),
    )
