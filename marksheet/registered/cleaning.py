"""Queries of cleaning, joins, duplicates, sources and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import fixtures as X
from ..functions import columns as C
from ..functions.agreement import mae, mse, rmse
from ..operators import clean as K, exam as E, joins as J
from ..operators.significance import sheet_label_cells, sheet_pair_cells
from ..sources import io, snapshots
from .common import r, rounded
from .exam import ITEM_SQL, METRICS_SQL, MODELS, SAMPLE_SQL, SCALED_SQL, exam_questions, exams_and_answers, metrics, responses, scaled


def _v(name: str):
    return lambda s, d: X.view(s, d, name)


def _folder(spark: SparkSession) -> str:
    return io.new_path(spark, "query")


dirty, meta = _v("responses_dirty"), _v("question_meta")
members, answers, gradings, feedback = _v("members"), _v("answers"), _v("gradings"), _v("feedback")


def _map(view: str, keys: list[str], **made):
    """A query of column functions over one adapter."""
    return lambda s, d: rounded(X.view(s, d, view).select(*keys, *(f().alias(n) for n, f in made.items())))


_DKEY = ["m", "q"]
_DIRTY = X.cte("responses_dirty")


def _dsql(**made: str) -> str:
    return f"WITH {_DIRTY} SELECT m, q, {', '.join(f'{e} AS {n}' for n, e in made.items())} FROM responses_dirty"


def _rsql(select: str, extra: str = "") -> str:
    return f"WITH {X.cte('responses')}{extra} SELECT {select} FROM responses"


_DENY = "SELECT member_id FROM responses WHERE question_id = 'q3' AND grade = 0"


def _denied(s, d, key):
    return responses(s, d).where("question_id = 'q3' AND grade = 0").select(key)


def _written(write, read):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = _folder(s)
        write(s, d, path)
        return read(s, path)

    return run


_EXAM_COLS = ["test_id", "test_size", "question_id", "question_order"]


def scan_exam_partitions(s, d):
    path = _folder(s)
    io.sink_partitioned_by_size(exam_questions(s, d), path)
    return io.scan_exam_partitions(s, path, [5, 10]).select(*_EXAM_COLS)


def shadow(s, d):
    df = responses(s, d)
    labels = df.where("label_type = 'gold'").select("question_id", F.upper("answer").alias("answer"), C.grade_number_to_label(F.col("grade")).alias("label"))
    return J.shadow_key_join(df.select("answer_id", "question_id", "answer"), labels)


def silver(s, d):
    df = responses(s, d)
    result = df.where("split = 'train'").select("answer_id", "grade", F.col("new_grade_a").alias("teacher_grade")).unionByName(df.where("split = 'train'").select("answer_id", "grade", F.lit(2.0).alias("teacher_grade")))
    return J.silver_label_merge(df.select("answer_id", "grade"), result, "answer_id", ["teacher_grade"])


def audited(s, d):
    df = responses(s, d)
    audit = df.select("answer_id", F.col("human_expert_one_gold").alias("human_1"), F.col("human_expert_two").alias("human_2"))
    return J.audited_grade_merge(df.select("answer_id", "new_grade_a"), audit)


def paired(s, d):
    """Exam-students of two models by exam and grades, and whether the reference grades agree."""
    pair = s.createDataFrame([("new_grade_a", "grade_prior_c")], "a string, b string")
    grades = [f"{t}_linear_abs_{x}" for x in ("a", "b") for t in ("gold", "pred")]
    exam, answers = exams_and_answers(s, d, ["new_grade_a", "grade_prior_c"])
    met = sheet_pair_cells(exam, answers, pair, sheet_label_cells(exam, answers, ["new_grade_a", "grade_prior_c"])).groupBy("test_id", "test_size", *grades).agg(F.sum("n").alias("n"))
    return met.withColumn("gold_agrees", F.col("gold_linear_abs_a") == F.col("gold_linear_abs_b"))


def duplicates(s, d):
    twice = responses(s, d).select("member_id", "question_id").union(responses(s, d).where("grade = 0.5").select("member_id", "question_id"))
    return J.duplicate_report(exam_questions(s, d), twice)


def column_checks(s, d):
    out = K.require_columns(responses(s, d), ["answer_id", "grade"])
    return out.agg(F.count(F.lit(1)).alias("n"))


def env_reuse(s, d):
    """Whether the exam tables can be used again: before any build, as built, with another seed, with another row."""
    path, settings, source = _folder(s), dict(seed=X.SEED, runs=X.RUNS, sizes=X.SIZES), responses(s, d)
    same = snapshots.fingerprint(settings, {"responses": source})
    before = snapshots.is_fresh(s, path, same)
    snapshots.publish(exam_questions(s, d), path, same)
    other = snapshots.fingerprint(settings | {"seed": 1}, {"responses": source})
    moved = snapshots.fingerprint(settings, {"responses": source.withColumn("grade", F.when(F.col("answer_id") == source.agg(F.min("answer_id")).first()[0], F.lit(9.0)).otherwise(F.col("grade")))})
    found = [before, *(snapshots.is_fresh(s, path, m) for m in (same, other, moved))]
    io.remove(s, path)
    return s.createDataFrame([tuple(found)], "before boolean, same boolean, changed boolean, row_changed boolean")


def metric_cache(s, d):
    path, settings = _folder(s), dict(seed=X.SEED, runs=X.RUNS, sizes=X.SIZES, models=MODELS)
    snapshots.cached(s, path, lambda: metrics(s, d), settings)
    return snapshots.cached(s, path, lambda: metrics(s, d).limit(0), settings).groupBy("model_col").agg(F.count(F.lit(1)).alias("n"))


def inferred(s, d):
    df = responses(s, d).withColumn("new_grade_empty", F.lit("none"))
    names = K.infer_model_columns(df, ("new_grade_", "grade_", "pred_"))
    return s.createDataFrame([(n,) for n in names], "model_col string").join(df.agg(F.count(F.lit(1)).alias("n_rows")), how="cross")


def relational(s, d):
    tables = io.scan_relational_tables(s, d, ["customer", "orders", "nation"])
    return J.union_by_name(*(t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in tables.items()))


def display_names(s, d):
    long = responses(s, d).select(F.explode(F.array(*(F.struct(F.lit(m).alias("model_col"), F.col(m).alias("p")) for m in X.MODELS))).alias("x")).select("x.*")
    return rounded(long.groupBy("model_col").agg(F.avg("p").alias("mean_grade")).withColumns({"display": C.model_short_name(F.col("model_col")), "family": C.model_family(F.col("model_col"))}))


_LONG_MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model_col, {m} AS p FROM responses" for m in X.MODELS)
_FAMILY = "CASE WHEN model_col LIKE 'new_grade_%' THEN 'LLM' WHEN model_col LIKE 'grade_bert%' THEN 'Transformer' WHEN model_col LIKE 'grade_prior%' THEN 'Prior' ELSE 'TF-IDF' END"
_LABEL = "CASE lower(trim(label)) WHEN 'incorrect' THEN 0 WHEN 'mostly incorrect' THEN 0.25 WHEN 'partially correct' THEN 0.5 WHEN 'mostly correct' THEN 0.75 WHEN 'correct' THEN 1 END"
_NUM_LABEL = "CASE {0} WHEN 0 THEN 'incorrect' WHEN 0.25 THEN 'mostly incorrect' WHEN 0.5 THEN 'partially correct' WHEN 0.75 THEN 'mostly correct' WHEN 1 THEN 'correct' END"
_SHADOW = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
_WS = r"'^\s+|\s+$'"


def model_keys(s, d):
    return E.sheet_key_sets(*exams_and_answers(s, d, MODELS), MODELS)


def swapped(s, d):
    df = responses(s, d)
    odd = F.col("grade") > 0.5
    both = df.select("answer_id", F.when(odd, "two").otherwise("one").alias("grader_name_1"), F.when(odd, "one").otherwise("two").alias("grader_name_2"), F.col("human_expert_one_gold").alias("human_grade_1"), F.col("human_expert_two").alias("human_grade_2"), F.col("gold_is_llm").alias("is_llm_1"), F.lit("No").alias("is_llm_2"))
    return K.annotator_swap_fix(both, "one")


_A, _B = "human_expert_one_gold", "human_expert_two"
_MEAN4 = f"(({_A} + {_B}) / 2 * 4)"
_CONSENSUS = f"CASE WHEN abs({_A} - {_B}) <= 0.5 THEN CASE WHEN {_MEAN4} - floor({_MEAN4}) = 0.5 THEN CASE WHEN {_MEAN4} > 2 THEN floor({_MEAN4}) ELSE floor({_MEAN4}) + 1 END ELSE round({_MEAN4}) END / CAST(4 AS DOUBLE) END"

_ERRORS = {"mae": mae, "mse": mse, "rmse": rmse}

QUERIES = {
    "scan_parquet": lambda s, d: io.scan_parquet(s, f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    "scan_exam_partitions": scan_exam_partitions,
    "scan_relational_tables": relational,
    "infer_model_columns": inferred,
    "require_columns": column_checks,
    "sink_parquet": lambda s, d: io.sink_parquet(responses(s, d).select("answer_id", "grade"), _folder(s)).agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("total")),
    "sink_partitioned_by_size": _written(lambda s, d, p: io.sink_partitioned_by_size(exam_questions(s, d), p), lambda s, p: s.read.parquet(p).groupBy("test_size").agg(F.count(F.lit(1)).alias("n"))),
    "sink_split_export": _written(lambda s, d, p: io.sink_split_export(responses(s, d), p), lambda s, p: s.read.parquet(p).groupBy("split").agg(F.count(F.lit(1)).alias("n"))),
    "sink_csv_tsv": _written(lambda s, d, p: io.sink_csv(responses(s, d).select("answer_id", "grade"), p, "\t"), lambda s, p: s.read.option("sep", "\t").option("header", True).csv(p).select("answer_id", F.col("grade").cast("double").alias("grade"))),
    "metric_table_cache": metric_cache,
    "env_reuse_check": env_reuse,
    "normalize_key": _map("responses_dirty", _DKEY, key=lambda: C.normalize_key(F.col("member_id"))),
    "valid_key_filter": lambda s, d: K.valid_key_filter(dirty(s, d)).select("member_id", "question_id", "answer_id", "answer"),
    "key_filter_counters": lambda s, d: K.key_filter_counters(dirty(s, d)),
    "to_numeric": _map("responses_dirty", _DKEY, number=lambda: C.to_numeric(F.col("grade_text"))),
    "grade_label_to_number": _map("responses_dirty", _DKEY, number=lambda: C.grade_label_to_number(F.col("label"))),
    "grade_number_to_label": _map("responses_dirty", _DKEY, label=lambda: C.grade_number_to_label(F.col("g"))),
    "is_llm_to_binary": lambda s, d: responses(s, d).select("answer_id", C.is_llm_to_binary(F.col("gold_is_llm")).alias("is_llm")),
    "yes_no_unknown": _map("responses_dirty", _DKEY, status=lambda: C.yes_no_unknown(F.col("flag"))),
    "valid_grade_filter": lambda s, d: K.valid_grade_filter(dirty(s, d), "grade_text").select("m", "q", "grade_text"),
    "clamp_grade": lambda s, d: K.clamp_grades(dirty(s, d), "wild_grade")[0].select("m", "q", "wild_grade").crossJoin(K.clamp_grades(dirty(s, d), "wild_grade")[1]),
    "derive_label_type_split": lambda s, d: K.derive_label_type_split(dirty(s, d).withColumn("grade", C.to_numeric(F.col("grade_text")))).select("m", "q", "label_type", "split"),
    "fill_grade_from_teacher": lambda s, d: K.fill_grade_from_teacher(responses(s, d).withColumn("grade", F.when(F.col("split") == "test", F.col("grade"))), "new_grade_a").select("answer_id", "grade"),
    "deny_list_members": lambda s, d: K.deny_list(responses(s, d), "member_id", _denied(s, d, "member_id")).select("answer_id"),
    "deny_list_answers": lambda s, d: K.deny_list(responses(s, d), "answer_id", _denied(s, d, "answer_id")).select("answer_id"),
    "deny_list_question": lambda s, d: K.deny_question(dirty(s, d), "5").select("m", "q", "question_id"),
    "reduce_to_gold_test": lambda s, d: K.reduce_to_gold_test(responses(s, d)).select("answer_id", "grade"),
    "gold_scope_case_insensitive": lambda s, d: K.gold_scope(responses(s, d).withColumns({"label_type": F.initcap("label_type"), "split": F.concat(F.lit(" "), F.upper("split"))})).select("answer_id"),
    "schema_evolution": lambda s, d: K.schema_evolution(responses(s, d), {"comment": T.StringType()}, ["question", "answer"], {"bloom_level": "bloom"}, ["answer_id", "bloom", "comment", "grade"]),
    "model_display_name": lambda s, d: display_names(s, d).select("model_col", "display", "mean_grade"),
    "model_family": lambda s, d: display_names(s, d).select("model_col", "family", "mean_grade"),
    "select_model_category": lambda s, d: K.select_model_category(metrics(s, d).select("model_col", "test_id", "test_size", "n_students"), s.createDataFrame([("grade_prior_c",), ("human_expert_two",)], "model_col string")),
    "safe_name_token": lambda s, d: X.view(s, d, "question_meta").select("id", C.safe_name_token(F.concat_ws("/", "topic", "bloom")).alias("token")),
    "join_members_answers": lambda s, d: J.join_members_answers(members(s, d), answers(s, d)),
    "join_with_gradings": lambda s, d: J.join_with_gradings(J.join_members_answers(members(s, d), answers(s, d)), gradings(s, d)),
    "join_with_feedback": lambda s, d: J.join_with_feedback(J.join_with_gradings(J.join_members_answers(members(s, d), answers(s, d)), gradings(s, d)), feedback(s, d)),
    "lost_rows_count": lambda s, d: J.lost_rows_count(members(s, d), "id", answers(s, d), "shared_member_id"),
    "question_metadata_join": lambda s, d: J.question_metadata_join(dirty(s, d).select("m", "q", "question_id"), J.assert_unique(meta(s, d), ["id"])),
    "id_overlap_stats": lambda s, d: J.id_overlap_stats(dirty(s, d).select("question_id"), meta(s, d).select(F.col("id").alias("question_id")), "question_id"),
    "shadow_key_join": shadow,
    "silver_label_merge": silver,
    "audited_grade_merge": audited,
    "audit_grade_consistency": lambda s, d: J.audit_grade_consistency(dirty(s, d).withColumn("grade", C.to_numeric(F.col("grade_text"))), "grade", "label").select("m", "q", "grade", "mapped"),
    "join_cardinality_check": lambda s, d: J.not_unique(X.base(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "paired_model_join": paired,
    "item_exam_metric_join": lambda s, d: rounded(J.item_exam_metric_join(E.item_metrics(responses(s, d), X.MODELS).select("model_col", "item_tau_b", "item_qwk"), metrics(s, d).groupBy("model_col").agg(F.avg("el_tau_b").alias("el_tau_b_mean")))),
    "resume_anti_join": lambda s, d: J.resume_anti_join(gradings(s, d).withColumnRenamed("id", "grading_id"), feedback(s, d)).select("grading_id"),
    "dedup_first_by_key": lambda s, d: J.dedup_first_by_key(X.base(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "find_duplicates": lambda s, d: J.find_duplicates(X.base(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "assert_unique_pairs": lambda s, d: J.assert_unique(responses(s, d), ["member_id", "question_id"]).agg(F.count(F.lit(1)).alias("n")),
    "duplicate_report": duplicates,
    "union_by_name": lambda s, d: J.union_by_name(responses(s, d).where("split = 'test'").select("answer_id", "grade"), responses(s, d).where("split = 'train'").select("answer_id", "new_grade_a")),
    "question_leakage_check": lambda s, d: J.question_leakage(responses(s, d).unionByName(responses(s, d).where("question_id = 'q3'").withColumn("split", F.lit("train")))),
    "model_key_sets_equal": model_keys,
    "expected_models_present": lambda s, d: J.expected_models_present(scaled(s, d), ["new_grade_a", "new_grade_z"]),
    "annotator_swap_fix": swapped,
    "consensus_grade": lambda s, d: responses(s, d).select("answer_id", C.consensus_grade(F.col(_A), F.col(_B)).alias("consensus")),
    "audit_flag": lambda s, d: responses(s, d).select("answer_id", C.audit_status(F.when(F.col("gold_is_llm").isNotNull(), F.col(_A)), F.col(_B)).alias("status")),
    "llm_flag_and": lambda s, d: responses(s, d).select("answer_id", C.llm_flag_and(F.col("gold_is_llm"), F.when(F.col("grade") > 0, "yes")).alias("both_llm")),
    "linear_grade_code": lambda s, d: scaled(s, d).groupBy("model_col", "test_id", "test_size", C.linear_grade_code(F.col("gold_linear_abs")).alias("code")).agg(F.sum("n").alias("n")),
    "snap_to_grade": lambda s, d: X.base(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_discount").alias("t")).select("l_orderkey", C.snap_to_grade(F.round(F.col("t") * 1000) / 160).alias("snapped")),
    "token_count_whitespace": _map("qa_text", ["id"], n_tokens=lambda: C.token_count_whitespace(F.col("answer"))),
    "normalize_text": _map("qa_text", ["id"], normal=lambda: C.normalize_text(F.col("answer"))),
    "qa_concat": _map("qa_text", ["id"], text=lambda: C.qa_concat(F.col("question"), F.col("answer"))),
    "tokenize_alnum": _map("qa_text", ["id"], tokens=lambda: F.array_join(C.tokenize_alnum(F.col("answer")), " ")),
    "overlap_ratio": _map("qa_text", ["id"], overlap=lambda: C.overlap_ratio(F.col("question"), F.col("answer"))),
    "overlap_template": _map("qa_text", ["id"], grade=lambda: C.overlap_template(F.col("question"), F.col("answer"))),
    "detect_language": _map("qa_text", ["id"], language=lambda: C.detect_language(F.col("question"))),
    "grade_from_model_output": _map("model_outputs", ["answer_id"], parsed=lambda: C.grade_from_model_output(F.col("model_response"))),
    "training_text_assembly": lambda s, d: K.training_text_assembly(responses(s, d)).select("answer_id", "split", "input_text", "target"),
    "prediction_postprocess": lambda s, d: rounded(K.prediction_postprocess(responses(s, d).withColumn("raw", F.col("pred_tfidf_d") * 1.3 - 0.1), "raw").where("split = 'test'").agg(*(f(F.col("grade"), F.col(c)).alias(f"{n}_{c}") for c in ("raw", "clipped", "snapped") for n, f in _ERRORS.items()))),
}

_QA = X.cte("qa_text")
_NORM = r"regexp_replace(lower(trim(coalesce({0}, ''), E' \t\n\r')), '\s+', ' ', 'g')"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-zA-Z0-9äöüÄÖÜ]+')"
_OVER = f"coalesce(len(list_intersect(list_distinct({_TOK.format('question')}), {_TOK.format('answer')})) / nullif(CAST(len(list_distinct({_TOK.format('question')})) AS DOUBLE), 0), 0)"
_STOP = lambda ws: ", ".join("'" + w + "'" for w in ws)
_LANGTOK = "regexp_extract_all(lower(question), '[A-Za-zÀ-ÖØ-öø-ÿ'']+')"
LANGUAGE = f"""CASE WHEN len({_LANGTOK}) = 0 THEN 'unknown' ELSE CASE
    WHEN len(list_filter({_LANGTOK}, lambda t: list_contains([{_STOP(C.DE_STOP_WORDS)}], t))) + CASE WHEN regexp_matches(lower(question), '[äöüß]') THEN 2 ELSE 0 END > len(list_filter({_LANGTOK}, lambda t: list_contains([{_STOP(C.EN_STOP_WORDS)}], t))) THEN 'de'
    WHEN len(list_filter({_LANGTOK}, lambda t: list_contains([{_STOP(C.DE_STOP_WORDS)}], t))) + CASE WHEN regexp_matches(lower(question), '[äöüß]') THEN 2 ELSE 0 END < len(list_filter({_LANGTOK}, lambda t: list_contains([{_STOP(C.EN_STOP_WORDS)}], t))) THEN 'en' ELSE 'unknown' END END"""
_TEMPLATE = """CASE WHEN n = 0 THEN 0 WHEN n < 8 THEN 0.25 WHEN o < 0.05 AND n < 25 THEN 0.25 WHEN o < 0.10 THEN CASE WHEN n < 50 THEN 0.25 ELSE 0.5 END WHEN o < 0.25 THEN CASE WHEN n < 40 THEN 0.5 ELSE 0.75 END
    WHEN o < 0.45 THEN CASE WHEN n < 30 THEN 0.5 ELSE 0.75 END WHEN n < 20 THEN 0.75 ELSE 1 END"""
_MA = "members.id AS member_id, name, subject_id, answers.id AS answer_id, question_id, content"
_RAW = {"raw": "raw", "clipped": "least(greatest(raw, 0), 1)", "snapped": "ceil(least(greatest(raw, 0), 1) * 4 - 0.5) / CAST(4 AS DOUBLE)"}

ORACLES = {
    "scan_parquet": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "scan_exam_partitions": f"WITH {SAMPLE_SQL} SELECT * FROM exam WHERE test_size IN (5, 10)",
    "scan_relational_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "nation")),
    "infer_model_columns": f"WITH {X.cte('responses')} SELECT model_col, (SELECT count(*) FROM responses) AS n_rows FROM ({' UNION ALL '.join(f'''SELECT '{m}' AS model_col, count({m}) AS n FROM responses''' for m in X.MODELS)}) WHERE n > 0",
    "require_columns": _rsql("count(*) AS n"),
    "sink_parquet": _rsql("count(*) AS n, sum(grade) AS total"),
    "sink_partitioned_by_size": f"WITH {SAMPLE_SQL} SELECT test_size, count(*) AS n FROM exam GROUP BY test_size",
    "sink_split_export": _rsql("split, count(*) AS n") + " GROUP BY split",
    "sink_csv_tsv": _rsql("answer_id, grade"),
    "metric_table_cache": f"WITH {METRICS_SQL} SELECT model_col, count(*) AS n FROM metrics GROUP BY model_col",
    "normalize_key": _dsql(key="trim(coalesce(member_id, ''))"),
    "valid_key_filter": f"WITH {_DIRTY} SELECT trim(member_id) AS member_id, trim(question_id) AS question_id, trim(answer_id) AS answer_id, answer FROM responses_dirty WHERE trim(coalesce(member_id, '')) <> '' AND trim(coalesce(question_id, '')) <> '' AND trim(coalesce(answer_id, '')) <> ''",
    "key_filter_counters": f"""WITH {_DIRTY}, b AS (SELECT trim(coalesce(question_id, '')) = '' AS bq, trim(coalesce(member_id, '')) = '' AS bm, trim(coalesce(answer_id, '')) = '' AS ba, trim(coalesce(answer, '')) = '' AS bt FROM responses_dirty)
        SELECT count(*) AS rows_raw, count(*) FILTER (bq) AS missing_question, count(*) FILTER (bm) AS missing_member, count(*) FILTER (ba) AS missing_answer, count(*) FILTER (bt) AS empty_text, count(*) FILTER (NOT bq AND NOT bm AND NOT ba) AS rows_valid FROM b""",
    "to_numeric": _dsql(number="TRY_CAST(grade_text AS DOUBLE)"),
    "grade_label_to_number": _dsql(number=_LABEL),
    "grade_number_to_label": _dsql(label=_NUM_LABEL.format("g")),
    "is_llm_to_binary": _rsql("answer_id, CASE gold_is_llm WHEN 'Yes' THEN '1' WHEN 'No' THEN '0' END AS is_llm"),
    "yes_no_unknown": _dsql(status="CASE WHEN lower(trim(flag)) IN ('yes', 'y', 'true', '1') THEN 'Yes' WHEN lower(trim(flag)) IN ('no', 'n', 'false', '0') THEN 'No' ELSE 'Unknown' END"),
    "valid_grade_filter": f"WITH {_DIRTY} SELECT m, q, grade_text FROM responses_dirty WHERE TRY_CAST(grade_text AS DOUBLE) IN (0, 0.25, 0.5, 0.75, 1)",
    "clamp_grade": f"WITH {_DIRTY} SELECT m, q, least(greatest(wild_grade, 0), 1) AS wild_grade, (SELECT count(*) FROM responses_dirty WHERE wild_grade < 0 OR wild_grade > 1) AS n_clamped FROM responses_dirty",
    "derive_label_type_split": _dsql(label_type="CASE WHEN TRY_CAST(grade_text AS DOUBLE) IS NULL THEN 'silver' ELSE 'gold' END", split="CASE WHEN TRY_CAST(grade_text AS DOUBLE) IS NULL THEN 'train' ELSE 'test' END"),
    "fill_grade_from_teacher": _rsql("answer_id, CASE WHEN split = 'test' THEN grade ELSE new_grade_a END AS grade"),
    "deny_list_members": _rsql("answer_id") + f" WHERE member_id NOT IN ({_DENY})",
    "deny_list_answers": _rsql("answer_id") + " WHERE NOT (question_id = 'q3' AND grade = 0)",
    "deny_list_question": f"WITH {_DIRTY} SELECT m, q, question_id FROM responses_dirty WHERE question_id IS DISTINCT FROM '5'",
    "reduce_to_gold_test": _rsql("answer_id, grade") + " WHERE label_type = 'gold' AND split = 'test'",
    "gold_scope_case_insensitive": _rsql("answer_id") + " WHERE label_type = 'gold' AND split = 'test'",
    "schema_evolution": _rsql("answer_id, bloom_level AS bloom, NULL AS comment, grade"),
    "model_display_name": f"WITH {X.cte('responses')} SELECT model_col, replace(regexp_replace(model_col, '^(new_grade_|grade_|pred_)', ''), '/', '_') AS display, {r('avg(p)', 'mean_grade')} FROM ({_LONG_MODELS}) GROUP BY model_col",
    "model_family": f"WITH {X.cte('responses')} SELECT model_col, {_FAMILY} AS family, {r('avg(p)', 'mean_grade')} FROM ({_LONG_MODELS}) GROUP BY model_col",
    "select_model_category": f"WITH {METRICS_SQL} SELECT model_col, test_id, test_size, n_students FROM metrics WHERE model_col NOT IN ('grade_prior_c', 'human_expert_two')",
    "safe_name_token": f"WITH {X.cte('question_meta')} SELECT id, translate(concat_ws('/', topic, bloom), '/\\:*?\"<>| ', '__________') AS token FROM question_meta",
    "join_members_answers": f"WITH {X.cte('members', 'answers')} SELECT {_MA} FROM members JOIN answers ON members.id = shared_member_id",
    "join_with_gradings": f"WITH {X.cte('members', 'answers', 'gradings')} SELECT {_MA}, gradings.id AS grading_id, accuracy FROM members JOIN answers ON members.id = shared_member_id JOIN gradings ON gradings.answer_id = answers.id",
    "join_with_feedback": f"WITH {X.cte('members', 'answers', 'gradings', 'feedback')} SELECT {_MA}, gradings.id AS grading_id, accuracy, rating, comment FROM members JOIN answers ON members.id = shared_member_id JOIN gradings ON gradings.answer_id = answers.id LEFT JOIN feedback ON feedback.grading_id = gradings.id",
    "lost_rows_count": f"WITH {X.cte('members', 'answers')} SELECT count(*) AS lost FROM members WHERE id NOT IN (SELECT shared_member_id FROM answers WHERE shared_member_id IS NOT NULL)",
    "question_metadata_join": f"WITH {X.cte('responses_dirty', 'question_meta')} SELECT m, q, question_id, bloom AS bloom_level, topic AS question_topic FROM responses_dirty LEFT JOIN question_meta ON id = question_id",
    "id_overlap_stats": f"""WITH {X.cte('responses_dirty', 'question_meta')}, a AS (SELECT DISTINCT question_id AS k FROM responses_dirty WHERE question_id IS NOT NULL), b AS (SELECT DISTINCT id AS k FROM question_meta)
        SELECT (SELECT count(*) FROM a) AS ids_left, (SELECT count(*) FROM b) AS ids_right, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS ids_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS missing_after_join""",
    "shadow_key_join": f"""WITH {X.cte('responses')}, l AS (SELECT question_id AS lq, {_SHADOW.format('upper(answer)')} AS k, min({_NUM_LABEL.format('grade')}) AS label FROM responses WHERE label_type = 'gold' GROUP BY 1, 2)
        SELECT answer_id, question_id, answer, label FROM responses LEFT JOIN l ON lq = question_id AND k = {_SHADOW.format('answer')}""",
    "silver_label_merge": _rsql("answer_id, grade, CASE WHEN split = 'train' THEN new_grade_a END AS teacher_grade"),
    "audited_grade_merge": _rsql(f"answer_id, new_grade_a, {_A} AS human_1, {_B} AS human_2"),
    "audit_grade_consistency": f"WITH {_DIRTY} SELECT * FROM (SELECT m, q, TRY_CAST(grade_text AS DOUBLE) AS grade, {_LABEL} AS mapped FROM responses_dirty) WHERE grade IS DISTINCT FROM mapped",
    "join_cardinality_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "paired_model_join": f"""WITH {SCALED_SQL}, pa AS (SELECT test_id, test_size, member_id, gold_linear_abs, pred_linear_abs FROM scaled WHERE model_col = 'new_grade_a'), pb AS (SELECT test_id, test_size, member_id, gold_linear_abs, pred_linear_abs FROM scaled WHERE model_col = 'grade_prior_c')
        SELECT test_id, test_size, pa.gold_linear_abs AS gold_linear_abs_a, pa.pred_linear_abs AS pred_linear_abs_a, pb.gold_linear_abs AS gold_linear_abs_b, pb.pred_linear_abs AS pred_linear_abs_b, count(*) AS n, pa.gold_linear_abs = pb.gold_linear_abs AS gold_agrees FROM pa JOIN pb USING (test_id, test_size, member_id) GROUP BY ALL""",
    "item_exam_metric_join": f"WITH {METRICS_SQL}, {ITEM_SQL.split(', ', 0)[0][len(X.cte('responses')) + 2:]} SELECT item.model_col, {r('item_tau_b', 'item_tau_b')}, {r('item_qwk', 'item_qwk')}, {r('m', 'el_tau_b_mean')} FROM item LEFT JOIN (SELECT model_col, avg(el_tau_b) AS m FROM metrics GROUP BY model_col) x USING (model_col) WHERE item.model_col <> 'human_expert_two'",
    "resume_anti_join": f"WITH {X.cte('gradings', 'feedback')} SELECT id AS grading_id FROM gradings WHERE id NOT IN (SELECT grading_id FROM feedback)",
    "dedup_first_by_key": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
    "find_duplicates": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
    "assert_unique_pairs": _rsql("count(*) AS n"),
    "duplicate_report": f"WITH {SAMPLE_SQL} SELECT test_id, test_size, member_id, question_id, 2 AS n_answers FROM exam JOIN responses USING (question_id) WHERE grade = 0.5",
    "union_by_name": _rsql("answer_id, CASE WHEN split = 'test' THEN grade END AS grade, CASE WHEN split = 'train' THEN new_grade_a END AS new_grade_a"),
    "question_leakage_check": _rsql("DISTINCT question_id") + " WHERE question_id = 'q3'",
    "model_key_sets_equal": f"""WITH {SCALED_SQL}, base AS (SELECT DISTINCT test_id, test_size, member_id FROM scaled WHERE model_col = (SELECT min(model_col) FROM scaled)), want AS (SELECT * FROM base, (SELECT DISTINCT model_col FROM scaled))
        SELECT model_col, (SELECT count(*) FROM (SELECT model_col, test_id, test_size, member_id FROM want EXCEPT SELECT model_col, test_id, test_size, member_id FROM scaled) x WHERE x.model_col = m.model_col) AS missing,
            (SELECT count(*) FROM (SELECT model_col, test_id, test_size, member_id FROM scaled EXCEPT SELECT model_col, test_id, test_size, member_id FROM want) x WHERE x.model_col = m.model_col) AS extra FROM (SELECT DISTINCT model_col FROM scaled) m""",
    "expected_models_present": f"WITH {SCALED_SQL}, have AS (SELECT DISTINCT model_col FROM scaled), want AS (SELECT 'new_grade_a' AS model_col UNION ALL SELECT 'new_grade_z') SELECT model_col, 'missing' AS state FROM want WHERE model_col NOT IN (SELECT model_col FROM have) UNION ALL SELECT model_col, 'extra' FROM have WHERE model_col NOT IN (SELECT model_col FROM want)",
    "annotator_swap_fix": _rsql(f"answer_id, 'one' AS grader_name_1, 'two' AS grader_name_2, CASE WHEN grade > 0.5 THEN {_B} ELSE {_A} END AS human_grade_1, CASE WHEN grade > 0.5 THEN {_A} ELSE {_B} END AS human_grade_2, CASE WHEN grade > 0.5 THEN 'No' ELSE gold_is_llm END AS is_llm_1, CASE WHEN grade > 0.5 THEN gold_is_llm ELSE 'No' END AS is_llm_2"),
    "consensus_grade": _rsql(f"answer_id, {_CONSENSUS} AS consensus"),
    "audit_flag": _rsql(f"answer_id, CASE WHEN gold_is_llm IS NULL THEN 'invalid_grade_input' WHEN abs({_A} - {_B}) > 0.5 THEN 'distance_gt_0.5' ELSE 'within_threshold' END AS status"),
    "llm_flag_and": _rsql("answer_id, CASE WHEN gold_is_llm = 'Yes' AND grade > 0 THEN 'Yes' ELSE 'No' END AS both_llm"),
    "linear_grade_code": f"WITH {SCALED_SQL} SELECT model_col, test_id, test_size, CAST(round_even((gold_linear_abs - 1) / 0.5, 0) AS INT) AS code, count(*) AS n FROM scaled GROUP BY ALL",
    "snap_to_grade": "SELECT l_orderkey, ceil(least(greatest(round(sum(l_discount) * 1000) / CAST(160 AS DOUBLE), 0), 1) * 4 - 0.5) / CAST(4 AS DOUBLE) + 0 AS snapped FROM lineitem GROUP BY l_orderkey",
    "token_count_whitespace": rf"WITH {_QA} SELECT id, len(regexp_extract_all(answer, '\S+')) AS n_tokens FROM qa_text",
    "normalize_text": f"WITH {_QA} SELECT id, {_NORM.format('answer')} AS normal FROM qa_text",
    "qa_concat": f"WITH {_QA} SELECT id, concat('question: ', {_NORM.format('question')}, ' answer: ', {_NORM.format('answer')}) AS text FROM qa_text",
    "tokenize_alnum": f"WITH {_QA} SELECT id, array_to_string({_TOK.format('answer')}, ' ') AS tokens FROM qa_text",
    "overlap_ratio": f"WITH {_QA} SELECT id, {r(_OVER, 'overlap')} FROM qa_text",
    "overlap_template": f"WITH {_QA} SELECT id, CAST({_TEMPLATE} AS DOUBLE) AS grade FROM (SELECT id, length(trim(answer, E' \\t\\n\\r')) AS n, {_OVER} AS o FROM qa_text)",
    "detect_language": f"WITH {_QA} SELECT id, {LANGUAGE} AS language FROM qa_text",
    "grade_from_model_output": f"WITH {X.cte('model_outputs')} SELECT answer_id, CASE WHEN model_response IS NULL OR model_response = 'no idea' THEN -1 ELSE grade END AS parsed FROM model_outputs",
    "training_text_assembly": _rsql("answer_id, split, concat('Question: ', question, chr(10), 'Answer: ', answer) AS input_text, concat('{\"grade\":', CAST(grade AS VARCHAR), '}') AS target"),
    "prediction_postprocess": f"WITH {X.cte('responses')}, w AS (SELECT grade, raw, {_RAW['clipped']} AS clipped, {_RAW['snapped']} AS snapped FROM (SELECT grade, pred_tfidf_d * CAST(1.3 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS raw FROM responses WHERE split = 'test')) SELECT {', '.join(r(e.format(c), f'{n}_{c}') for c in _RAW for n, e in (('mae', 'avg(abs(grade - {0}))'), ('mse', 'avg((grade - {0}) * (grade - {0}))'), ('rmse', 'sqrt(avg((grade - {0}) * (grade - {0})))')))} FROM w",
}
