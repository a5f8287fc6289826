"""Queries of significance, rankings, text baselines, rich text and the release chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import baselines as B, rich_text as R, significance as T
from ..plans import lineage as L
from .common import dbl, kappa_cte, r, rounded
from ..operators.exam import cells_of_states, graded_columns, sheet_states
from ..operators.sheets import sittings
from ..sources.io import settled
from .exam import MODELS, SCALED_SQL, exams_and_answers, responses

SIZE, N = 10, X.PERMUTATIONS


def exams(s, d):
    """The exams of one size, and the answers: the others are left out before sheets are looked at."""
    exam, answers = exams_and_answers(s, d, MODELS)
    return exam.where(F.col("test_size") == SIZE), answers


def sat(s, d):
    return sittings(*exams(s, d), graded_columns(MODELS))


def labels(s, d):
    exam, answers = exams(s, d)
    return T.exam_label_table(sittings(exam, answers, graded_columns(MODELS)), MODELS, SIZE, cells_of_states(sheet_states(exam, answers, MODELS)))


def cells(s, d):
    return T.sheet_label_cells(*exams(s, d), MODELS)


def pairs(s, d):
    return s.createDataFrame([("new_grade_a", m) for m in MODELS if m != "new_grade_a"], "a string, b string")


def mcnemar_counts(s, d):
    return T.mcnemar_counts(T.pair_cells(sat(s, d), MODELS, pairs(s, d), SIZE), "linear_abs")


def mcnemar_exact_p(s, d):
    return rounded(T.mcnemar_exact_p(mcnemar_counts(s, d)).select("a", "b", "discordant", "p"))


def permutation(s, d):
    return rounded(T.permutation_test_qwk(sat(s, d), MODELS, SIZE, "new_grade_a", "pred_tfidf_d", N, X.SEED))


def sanity(s, d):
    """All checks, with the ranking and the comparisons of the other queries.

    Labels are counts of students, counted once more than for the ranking that they are held against.
    """
    exam, answers = exams(s, d)
    ranking = settled(T.model_ranking(T.sheet_label_cells(exam, answers, MODELS)), "ranking")
    compared = T.best_against_others(ranking, "el_acc_linear_abs").union(T.best_against_others(ranking, "el_qwk_bologna"))
    counted = settled(T.sheet_label_cells(exam, answers, MODELS), "labels")
    return T.sanity_checks(counted, MODELS, SIZE, ranking=ranking, pairs=compared, exams=X.RUNS, students=T.sheet_checks(exam, answers, MODELS, counted))


def rich_documents(s, d):
    """Editor documents made from conversation turns: a list item around every turn's text. Every
    seventh conversation has no document, every eleventh an empty one."""
    text = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct(F.lit("listItem").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(text).alias("content"))).alias("content"))
    made = X.base(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.lit("doc").alias("type"), F.array_sort(F.collect_list(F.struct("turn", turn.alias("node")))).getField("node").alias("content"))).alias("document"))
    return made.withColumn("document", F.when(F.col("conv_id") % 7 == 3, F.lit(None)).when(F.col("conv_id") % 11 == 5, "").otherwise(F.col("document")))


def rich_questions(s, d):
    qa = X.view(s, d, "qa_text")
    text = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    doc = lambda c: F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("heading").alias("type"), F.array(text(c), F.struct(F.lit("hardBreak").alias("type"), F.lit(None).cast("string").alias("text")), text(c)).alias("content"))).alias("content"))
    example = lambda c, a: F.struct(text(c).alias("content"), F.lit(a).alias("accuracy"))
    return qa.select("id", F.to_json(F.struct(doc("question").alias("content"), text("answer").alias("rubric"), F.array(example("answer", 0.5), example("question", 1.0)).alias("examples"))).alias("document"))


def release(s, d):
    v = lambda n: X.view(s, d, n)
    denied = v("members").where("subject_id = 'BUILDING'").select("id")
    chain = L.steps(v("question_meta"), denied, "7")
    return L.release(L.export(v("members"), v("answers"), v("gradings"), v("feedback")), chain).select("member_id", "student_name", "answer_id", "question_id", "grading_id", "bloom_level", "question_topic", "label_type", "split", "grade")


def _tfidf_base(s, d):
    return responses(s, d).select("answer_id", "split", "question", "answer", "grade")


def _tfidf_answers(s, d):
    """The rows of ``_tfidf_base`` written down, as features and predictions read them several times."""
    return settled(_tfidf_base(s, d).drop("question"), "answers")


def _vector_stats(df, column):
    values = F.col(f"{column}.values")
    return rounded(df.select("answer_id", F.size(values).alias("n_terms"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x).alias("squared_length"), F.array_max(values).alias("largest")))


LABELS_SQL = f"""{SCALED_SQL}, labels AS (SELECT model_col, test_id, test_size, member_id, gold_total, pred_total, gold_norm, pred_norm, gold_linear_abs, pred_linear_abs, gold_bologna, pred_bologna, gold_linear_abs = pred_linear_abs AS correct_linear_abs, gold_bologna = pred_bologna AS correct_bologna FROM scaled WHERE test_size = {SIZE})"""
_COUNTS = lambda flag: f"""SELECT a.model_col AS a, b.model_col AS b, count(*) AS n, count(*) FILTER (a.{flag} AND b.{flag}) AS both_right, count(*) FILTER (a.{flag} AND NOT b.{flag}) AS only_a, count(*) FILTER (NOT a.{flag} AND b.{flag}) AS only_b, count(*) FILTER (NOT a.{flag} AND NOT b.{flag}) AS both_wrong,
    count(*) FILTER (a.{flag} <> b.{flag}) AS discordant FROM labels a JOIN labels b USING (test_id, test_size, member_id)"""  # noqa: E731
_P = "CASE WHEN discordant = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, CAST(least(only_a, only_b) AS BIGINT) + 1), lambda k: exp(lgamma(discordant + 1) - lgamma(k + 1) - lgamma(discordant - k + 1) - discordant * ln(2))))) END"
RANK_SQL = f"""{LABELS_SQL}, rp AS (SELECT model_col, test_id, 'linear_abs' AS scale, gold_linear_abs AS y, pred_linear_abs AS p FROM labels UNION ALL SELECT model_col, test_id, 'bologna', gold_bologna, pred_bologna FROM labels), {kappa_cte('rk', 'rp', ['model_col', 'test_id', 'scale'])},
    ranking AS (SELECT *, row_number() OVER (ORDER BY round(el_acc_linear_abs, 12) DESC NULLS LAST, round(el_qwk_linear_abs, 12) DESC NULLS LAST, round(el_qwk_bologna, 12) DESC NULLS LAST, round(el_acc_bologna, 12) DESC NULLS LAST, model_col) AS position FROM (
        SELECT model_col, (SELECT count(*) FROM labels l WHERE l.model_col = rk.model_col) AS n_exam_student_rows, {', '.join(f"avg(CASE WHEN scale = '{s}' THEN {c} END) AS el_{m}_{s}" for s in ('linear_abs', 'bologna') for m, c in (('acc', 'accuracy'), ('qwk', 'qwk')))} FROM rk GROUP BY model_col)),
    best AS ({' UNION ALL '.join(f"SELECT '{m}' AS selection_metric, (SELECT model_col FROM ranking ORDER BY round({m}, 12) DESC NULLS LAST, round(el_acc_linear_abs, 12) DESC NULLS LAST, round(el_qwk_linear_abs, 12) DESC NULLS LAST, round(el_acc_bologna, 12) DESC NULLS LAST, round(el_qwk_bologna, 12) DESC NULLS LAST, model_col LIMIT 1) AS best_model_col, (SELECT max({m}) FROM ranking) AS best_value" for m in T.RANKING)})"""
_MIXED = lambda parts: f"CAST(concat('0x', substr(md5(concat('{X.SEED}|', {parts})), 1, 12)) AS BIGINT) % {T._PRIME}"
_MOVED = lambda off, sq, sm: f"CASE WHEN m * (sgg + {sq}) - 2 * sg * ({sm}) = 0 THEN CASE WHEN {off} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1 - m * ({off}) / nullif(m * (sgg + {sq}) - 2 * sg * ({sm}), 0) END"
_CODE = lambda c: f"CAST(round_even(({c} - 1) / 0.5, 0) AS DOUBLE)"

_FAR = lambda a, b: f"abs({a} - ({b})) > 1e-12"
_ROW_RULES = {
    "labels_not_null": ("rows without a label", "gold_linear_abs IS NULL OR pred_linear_abs IS NULL OR gold_bologna IS NULL OR pred_bologna IS NULL"),
    "single_test_size": (f"rows of another size than {SIZE}", f"test_size <> {SIZE}"),
    "totals_in_range": ("totals outside of the exam''s points", "gold_total < 0 OR gold_total > test_size OR pred_total < 0 OR pred_total > test_size"),
    "gold_norm_matches": ("norms that are not total / size", _FAR("gold_norm", "gold_total / test_size")),
    "pred_norm_matches": ("norms that are not total / size", _FAR("pred_norm", "pred_total / test_size")),
    "linear_in_range": ("grades outside of 1 to 6", "pred_linear_abs NOT BETWEEN 1 AND 6 OR gold_linear_abs NOT BETWEEN 1 AND 6"),
    "linear_on_step": ("grades off the steps of a half", "pred_linear_abs * 2 <> floor(pred_linear_abs * 2) OR gold_linear_abs * 2 <> floor(gold_linear_abs * 2)"),
    "bologna_ordinals": ("ordinals outside of 0 to 5", "pred_bologna NOT BETWEEN 0 AND 5 OR gold_bologna NOT BETWEEN 0 AND 5"),
    "correct_linear_flag": ("flags that differ from the labels", "correct_linear_abs <> (gold_linear_abs = pred_linear_abs)"),
    "correct_bologna_flag": ("flags that differ from the labels", "correct_bologna <> (gold_bologna = pred_bologna)"),
    "fail_below_pass_mark": ("passes below the pass mark", f"pred_norm * test_size < test_size * {dbl(0.6)} AND pred_bologna > 0"),
}
_NAMED = lambda name, severity, offending, details: f"SELECT '{name}' AS name, '{severity}' AS severity, CAST(({offending}) AS BIGINT) AS offending, '{details}' AS details"
_PAIRED = "SELECT a.best_model_col, r.model_col FROM (SELECT DISTINCT best_model_col FROM best{0}) a JOIN ranking r ON r.model_col <> a.best_model_col"
_SANITY_SQL = f"""WITH {RANK_SQL}, base AS (SELECT test_id, member_id FROM labels WHERE model_col = (SELECT min(model_col) FROM labels)), per AS (SELECT model_col, count(*) AS n, count(DISTINCT test_id) AS exams FROM labels GROUP BY model_col),
    found AS ({" UNION ALL ".join([
        *(_NAMED(name, "critical", f"SELECT count(*) FILTER ({rule}) FROM labels", details) for name, (details, rule) in _ROW_RULES.items()),
        _NAMED("rows_unique", "critical", "SELECT count(*) FROM (SELECT 1 FROM labels GROUP BY model_col, test_id, member_id HAVING count(*) > 1)", "exam-students that a model has twice"),
        _NAMED("gold_labels_agree", "critical", "SELECT count(*) FROM (SELECT 1 FROM labels GROUP BY test_id, member_id HAVING count(DISTINCT (gold_linear_abs, gold_bologna)) > 1)", "exam-students whose reference differs between models"),
        _NAMED("expected_models", "critical", f"SELECT count(*) FROM (SELECT DISTINCT model_col FROM labels) h FULL JOIN (SELECT unnest({list(MODELS)}) AS w) ON model_col = w WHERE model_col IS NULL OR w IS NULL", "models missing or extra"),
        _NAMED("same_exam_students", "warning", "SELECT count(*) FROM (SELECT model_col FROM labels m GROUP BY model_col HAVING count(*) <> (SELECT count(*) FROM base) OR (SELECT count(*) FROM labels l JOIN base USING (test_id, member_id) WHERE l.model_col = m.model_col) <> (SELECT count(*) FROM base))", "models with other exam-students than the first"),
        _NAMED("selection_metrics_exist", "critical", "SELECT count(*) FILTER (selection_metric NOT IN ('el_acc_linear_abs', 'el_qwk_linear_abs', 'el_acc_bologna', 'el_qwk_bologna')) FROM best", "selection metrics that the ranking lacks"),
        _NAMED("test_size_exists", "critical", f"SELECT CAST(count(*) FILTER (test_size = {SIZE}) = 0 AS INT) FROM labels", "no row of the size asked for"),
        _NAMED("labels_not_empty", "critical", "SELECT CAST(count(*) = 0 AS INT) FROM labels", "no row at all"),
        _NAMED("exam_students_counted", "critical", "SELECT count(*) FROM (SELECT test_id FROM labels GROUP BY test_id HAVING count(DISTINCT model_col) <> (SELECT count(DISTINCT model_col) FROM labels))", "exams that not every model has"),
        _NAMED("equal_row_counts", "warning", "SELECT CAST(min(n) <> max(n) AS INT) FROM per", "models have different numbers of rows"),
        _NAMED("exam_count", "warning", f"SELECT count(*) FROM per WHERE exams <> {X.RUNS}", f"models with another number of exams than {X.RUNS}"),
        _NAMED("ranking_recomputes", "critical", "SELECT count(*) FROM ranking a JOIN ranking b USING (model_col) WHERE abs(a.el_acc_linear_abs - b.el_acc_linear_abs) > 1e-12", "models whose ranking metrics come out otherwise"),
        _NAMED("best_paired_with_all", "critical", f"SELECT count(*) FROM ({_PAIRED.format('')} EXCEPT {_PAIRED.format(chr(32) + 'WHERE selection_metric IN (' + repr('el_acc_linear_abs') + ', ' + repr('el_qwk_bologna') + ')')})", "comparisons of a best model that are missing"),
    ])})
    SELECT name, severity, offending, offending = 0 AS passed, details FROM found"""
_TABLES = " UNION ALL ".join(f"SELECT {z} AS size, {T.quantile_table(z)[0]} AS least, CAST({list(T.quantile_table(z)[1])} AS BIGINT[]) AS cuts" for z in T.TABLE_SIZES)

QUERIES = {
    "exam_label_table": lambda s, d: rounded(labels(s, d)),
    "model_ranking": lambda s, d: rounded(T.model_ranking(cells(s, d)).drop("model")),
    "best_model_per_metric": lambda s, d: rounded(T.best_model_per_metric(T.model_ranking(cells(s, d)))),
    "mcnemar_counts": mcnemar_counts,
    "mcnemar_exact_p": mcnemar_exact_p,
    "mcnemar_all_pairs": lambda s, d: rounded(T.mcnemar_all_pairs(sat(s, d), MODELS, SIZE).select("scale", "a", "b", "discordant", "p")),
    "permutation_test_qwk": permutation,
    "permutation_all_pairs": lambda s, d: rounded(T.sheet_permutations(*exams(s, d), MODELS, N, X.SEED)),
    "sanity_checks": sanity,
    "rich_text_column_job": lambda s, d: R.rich_text_column_job(rich_documents(s, d), "document", "plain").select("conv_id", "plain"),
    "rich_question_column_job": lambda s, d: R.rich_question_column_job(rich_questions(s, d), "document").select("id", "question", "rubric", "examples"),
    "release_lineage": release,
    "tfidf_word_features": lambda s, d: _vector_stats(B.tfidf_word_features(_tfidf_answers(s, d), "answer"), "features"),
    "tfidf_char_features": lambda s, d: _vector_stats(B.tfidf_char_features(_tfidf_answers(s, d), "answer"), "features"),
    "tfidf_ridge_predict": lambda s, d: B.tfidf_ridge_predict(B.tfidf_word_features(_tfidf_answers(s, d), "answer"), "features").select("answer_id", "split", "prediction"),
    "tfidf_variants": lambda s, d: B.tfidf_variants(_tfidf_base(s, d)).select("answer_id", "split", *(f"pred_tfidf_{v}" for v in B.RECIPES)),
}

# Python's and Java's white space at both ends.
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ''), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+$', '')"

ORACLES = {
    "rich_text_column_job": f"""SELECT conv_id, CASE WHEN conv_id % 7 = 3 OR conv_id % 11 = 5 THEN '' ELSE {_STRIP.format("string_agg(coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn)")} END AS plain FROM conversations GROUP BY conv_id""",
    "rich_question_column_job": f"""WITH {X.cte('qa_text')} SELECT id, {_STRIP.format("question || chr(10) || question")} AS question, {_STRIP.format("answer")} AS rubric,
        concat('Ex 1 (Acc: 0.5): ', {_STRIP.format("answer")}, chr(10), '---', chr(10), 'Ex 2 (Acc: 1.0): ', {_STRIP.format("question")}) AS examples FROM qa_text""",
    "exam_label_table": f"WITH {LABELS_SQL} SELECT * REPLACE (round(gold_norm, 9) AS gold_norm, round(pred_norm, 9) AS pred_norm) FROM labels",
    "model_ranking": f"WITH {RANK_SQL} SELECT model_col, n_exam_student_rows, {', '.join(r(m, m) for m in T.RANKING)}, position FROM ranking",
    "best_model_per_metric": f"WITH {RANK_SQL} SELECT selection_metric, best_model_col, {r('best_value', 'best_value')} FROM best",
    "mcnemar_counts": f"WITH {LABELS_SQL} {_COUNTS('correct_linear_abs')} WHERE a.model_col = 'new_grade_a' AND b.model_col <> 'new_grade_a' GROUP BY 1, 2",
    "mcnemar_exact_p": f"WITH {LABELS_SQL}, c AS ({_COUNTS('correct_linear_abs')} WHERE a.model_col = 'new_grade_a' AND b.model_col <> 'new_grade_a' GROUP BY 1, 2) SELECT a, b, discordant, {r(_P, 'p')} FROM c",
    "mcnemar_all_pairs": f"WITH {RANK_SQL}, c AS ({' UNION ALL '.join(f'''SELECT '{s}' AS scale, * FROM ({_COUNTS('correct_' + s)} WHERE a.model_col = (SELECT best_model_col FROM best WHERE selection_metric = 'el_acc_{s}') AND b.model_col <> a.model_col GROUP BY 1, 2)''' for s in ('linear_abs', 'bologna'))}) SELECT scale, a, b, discordant, {r(_P, 'p')} FROM c",
    "permutation_test_qwk": f"""WITH {LABELS_SQL}, pr AS (SELECT test_id, test_size, CAST({_CODE('a.gold_linear_abs')} AS BIGINT) AS g, CAST({_CODE('a.pred_linear_abs')} AS BIGINT) AS x, CAST({_CODE('b.pred_linear_abs')} AS BIGINT) AS y FROM labels a JOIN labels b USING (test_id, test_size, member_id) WHERE a.model_col = 'new_grade_a' AND b.model_col = 'pred_tfidf_d' AND a.gold_linear_abs = b.gold_linear_abs),
        ce AS (SELECT test_id, test_size, g, x, y, count(*) AS n FROM pr GROUP BY ALL),
        tb AS ({_TABLES}),
        pc AS (SELECT *, 1 AS size, n % 512 AS rest, unnest(range(0, (n % 512 + {T._CHUNK - 1}) // {T._CHUNK})) AS chunk FROM ce WHERE x <> y UNION ALL SELECT ce.*, tb.size, 0, unnest(range(1, (CASE tb.size WHEN 32768 THEN n // 32768 WHEN 4096 THEN n % 32768 // 4096 ELSE n % 4096 // 512 END) + 1)) FROM ce, tb WHERE x <> y),
        ch AS (SELECT pc.*, tb.least, tb.cuts, {_MIXED("test_id, '|', test_size, '|', g, '|', x, '|', y, '|', size, '|', chunk")} + 1 AS h, {_MIXED("test_id, '|', test_size, '|', g, '|', x, '|', y, '|', size, '|', chunk, '|k'")} AS k, CASE size WHEN 1 THEN (1::BIGINT << CAST(least(rest - chunk * {T._CHUNK}, {T._CHUNK}) AS INT)) - 1 END AS mask FROM pc LEFT JOIN tb USING (size)),
        pe AS (SELECT perm, {_MIXED("perm")} + 1 AS hp FROM range(1, {N + 1}) t(perm)),
        mo AS (SELECT perm, test_id, sum(sw * ((g - y) * (g - y) - (g - x) * (g - x))) AS da, sum(sw * (y * y - x * x)) AS ds, sum(sw * (y - x)) AS dt FROM (SELECT perm, test_id, g, x, y, CASE size WHEN 1 THEN CAST(bit_count(((h * hp + k) % {T._PRIME}) & mask) AS BIGINT) ELSE ch.least + len(list_filter(cuts, lambda c: c <= (h * hp + k) % {T._PRIME})) END AS sw FROM ch, pe) GROUP BY perm, test_id),
        su AS (SELECT test_id, CAST(sum(n) AS DOUBLE) AS m, sum(n * g) AS sg, sum(n * g * g) AS sgg, sum(n * x) AS sx, sum(n * x * x) AS sxx, sum(n * (g - x) * (g - x)) AS ax, sum(n * y) AS sy, sum(n * y * y) AS syy, sum(n * (g - y) * (g - y)) AS ay FROM ce GROUP BY test_id),
        gr AS (SELECT perm, su.*, coalesce(da, 0) AS da, coalesce(ds, 0) AS ds, coalesce(dt, 0) AS dt FROM su CROSS JOIN (SELECT perm FROM pe UNION ALL SELECT 0) q LEFT JOIN mo USING (perm, test_id)),
        me AS (SELECT perm, avg({_MOVED('ax + da', 'sxx + ds', 'sx + dt')} - {_MOVED('ay - da', 'syy - ds', 'sy - dt')}) AS dd FROM gr GROUP BY perm), ob AS (SELECT dd AS o FROM me WHERE perm = 0)
        SELECT {r('o', 'observed')}, count(*) FILTER (abs(dd) >= abs(o) - 1e-12) AS extreme, count(*) AS n_permutations, {r('(count(*) FILTER (abs(dd) >= abs(o) - 1e-12) + 1) / CAST(count(*) + 1 AS DOUBLE)', 'p')} FROM me, ob WHERE perm > 0 GROUP BY o""",
    "sanity_checks": _SANITY_SQL,
    "release_lineage": f"""WITH {X.cte('members', 'answers', 'gradings', 'feedback', 'question_meta')}, j AS (SELECT m.id AS member_id, m.name AS student_name, m.subject_id, a.id AS answer_id, a.question_id, g.id AS grading_id, g.accuracy, f.rating, row_number() OVER (PARTITION BY a.id ORDER BY g.id) AS n
        FROM members m JOIN answers a ON m.id = a.shared_member_id JOIN gradings g ON g.answer_id = a.id LEFT JOIN feedback f ON f.grading_id = g.id)
        SELECT member_id, student_name, answer_id, question_id, grading_id, bloom AS bloom_level, topic AS question_topic, CASE WHEN rating IS NULL THEN 'silver' ELSE 'gold' END AS label_type, CASE WHEN rating IS NULL THEN 'train' ELSE 'test' END AS split, accuracy AS grade
        FROM j LEFT JOIN question_meta q ON q.id = j.question_id WHERE n = 1 AND subject_id <> 'BUILDING' AND question_id <> '7'""",
}
