"""Queries of the analytics tables and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import scales as S
from ..operators import baselines as B, clean as K, exam as E, sampling as P, tables as A
from ..sources.io import settled
from .cleaning import LANGUAGE
from .common import dbl, kappa_cte, r, rounded, tau_cte
from .exam import ITEM_SQL, METRICS_SQL, SAMPLE_SQL, SUMMARY_SQL, SWEEP_SQL, exam_questions, metrics, responses, sweep

_BASE = X.cte("responses")
_NAMES = ("el_tau_b", "el_acc_linear_abs", "el_qwk_bologna")


def summary(s, d):
    return E.exam_summary(metrics(s, d))


def overall(s, d):
    """One row per model, rounded so that ranks do not hang on the order of additions."""
    return rounded(metrics(s, d).groupBy("model_col").agg(*(F.avg(c).alias(c) for c in _NAMES)))


_OVERALL = f"WITH {METRICS_SQL}, overall AS (SELECT model_col, {', '.join(r(f'avg({c})', c) for c in _NAMES)} FROM metrics GROUP BY model_col)"


def long_feedback(s, d):
    return X.view(s, d, "feedback_long")


def metadata(s, d):
    exam, dirty = exam_questions(s, d), X.view(s, d, "responses_dirty")
    named = settled(dirty.select(F.concat(F.lit("q"), "question_id").alias("question_id"), "member_id", "answer_id", "answer", *(F.expr(e).alias(c) for c, e in _OF_QUESTION.items())), "named")
    valid = settled(K.valid_key_filter(named.select("question_id", "member_id", "answer_id", "answer")), "valid")
    return A.exam_metadata(exam, named, valid).select("test_id", "test_size", *_META, *_META_TEXTS)


#: What the answers table says of a question, for rows whose question id is lost, too.
_OF_QUESTION = {"bloom_level": "CASE q % 4 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'apply' ELSE 'analyse' END", "question_topic": "concat('topic ', CAST(q % 6 AS STRING))"}
_META = ("rows_all", "students_all", "answers_all", "empty_all", "rows_valid", "students_valid", "answers_valid", "empty_valid", "rows_eligible", "answers_eligible", "empty_eligible", "eligible_students")
_META_TEXTS = ("question_ids", "student_ids", *A.DISTRIBUTIONS)


def interpolated(s, d):
    """Shares for each number of passing classes, beside how many students passed."""
    rows = [(n, i, float(x)) for n in range(1, 10) for i, x in enumerate(S.passing_distribution_interpolated(n))]
    passed = responses(s, d).groupBy("member_id").agg(F.avg("grade").alias("g")).agg(F.count_if(F.col("g") >= 0.6).alias("k"))
    return rounded(s.createDataFrame(rows, "n_classes int, class int, share double").crossJoin(passed).select("n_classes", "class", "share", F.ceil(F.round(F.col("k") * F.col("share"), 9)).alias("seats")))


def _distribution_sql(name: str, column: str) -> str:
    return f"""{name} AS (SELECT test_id, test_size, string_agg(concat(value, '=', n, ' (', w // 10000, '.', lpad(CAST(w % 10000 AS VARCHAR), 4, '0'), ')'), chr(10) ORDER BY n DESC, value) AS {name}
            FROM (SELECT *, CAST(round_even(n * CAST(10000 AS DOUBLE) / sum(n) OVER (PARTITION BY test_id, test_size), 0) AS BIGINT) AS w FROM (SELECT test_id, test_size, trim({column}) AS value, count(*) AS n FROM ex JOIN raw USING (question_id) WHERE trim({column}) <> '' GROUP BY ALL)) GROUP BY test_id, test_size)"""


_SHARES = ", ".join(f"({n}, {i}, {dbl(float(x))})" for n in range(1, 10) for i, x in enumerate(S.passing_distribution_interpolated(n)))


def top_models(s, d):
    fine = E.granularity_summary(sweep(s, d)).where("n_classes = 10 AND scale = 'absolute'")
    return rounded(fine.select("model_col", "qwk_mean").orderBy(F.desc_nulls_last(F.round("qwk_mean", 9)), "model_col").limit(3))


def _core_scope(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS scope, count(DISTINCT member_id) AS students, count(*) AS responses, {r('avg(w)', 'mean_length')}, median(w) AS median_length, count(DISTINCT question_id) AS questions,
        (SELECT {'round(avg(n), 9)'} FROM (SELECT count(*) AS n FROM {source} GROUP BY question_id)) AS mean_per_question, (SELECT median(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY question_id)) AS median_per_question,
        (SELECT {'round(avg(n), 9)'} FROM (SELECT count(*) AS n FROM {source} GROUP BY member_id)) AS mean_per_student, (SELECT median(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY member_id)) AS median_per_student,
        count(*) FILTER (lang <> 'de') AS english, count(*) FILTER (lang = 'de') AS german, count(*) FILTER (lang = 'unknown') AS unknown_counted_as_english,
        {r("count(*) FILTER (lang <> 'de') * 100.0 / count(*)", 'english_pct')}, {r("count(*) FILTER (lang = 'de') * 100.0 / count(*)", 'german_pct')}, {r("count(*) FILTER (lang = 'unknown') * 100.0 / count(*)", 'unknown_pct')},
        count(*) FILTER (label_type = 'gold') AS gold, count(*) FILTER (label_type = 'silver') AS silver, count(*) FILTER (label_type NOT IN ('gold', 'silver')) AS other FROM {source}"""


_WORDS = r"len(regexp_extract_all(coalesce(answer, ''), '\S+'))"
_BINS = "CASE " + " ".join(f"WHEN w < {high} THEN '{label}'" for _, high, label in A.LENGTH_BINS if high) + " ELSE '160+' END"
_FAMILY = "CASE WHEN model_col LIKE 'new_grade_%' THEN 'LLM' WHEN model_col LIKE 'grade_bert%' THEN 'Transformer' WHEN model_col LIKE 'grade_prior%' THEN 'Prior' WHEN model_col LIKE 'pred_tfidf%' THEN 'TF-IDF' ELSE 'Other' END"
_BLOOM_LONG = " UNION ALL ".join(f"SELECT '{m}' AS model_col, bloom_level, grade AS y, {m} AS p FROM responses" for m in X.MODELS)
_BLOOM = f"""{_BASE}, bl AS ({_BLOOM_LONG}), {kappa_cte('bk', 'bl', ['model_col', 'bloom_level'])}, {tau_cte('bt', 'bl', ['model_col', 'bloom_level'])},
    bm AS (SELECT model_col, bloom_level, count(y + p) AS n, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse FROM bl GROUP BY model_col, bloom_level),
    bloom AS (SELECT bm.*, {_FAMILY} AS family, bk.qwk, bt.tau_b FROM bm LEFT JOIN bk USING (model_col, bloom_level) LEFT JOIN bt USING (model_col, bloom_level))"""
_CONF = " UNION ALL ".join(f"SELECT '{m}' AS model_col, grade AS gold, {m} AS pred FROM responses WHERE {m} IS NOT NULL" for m in X.MODELS)
_PROFILE = ("answer_id", "grade", "grade_bert_b", "gold_is_llm", "answer")
_TYPES = {"grade": "double", "grade_bert_b": "double"}
_RUB = ("diag", "ground", "align", "action", "spec", "tone")
_MEAN = lambda cs: f"(({' + '.join(f'coalesce({c}, 0)' for c in cs)}) / nullif({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in cs)}, 0))"
_QUALITY = ", ".join([*(r(f"avg({c})", c) for c in (*_RUB, "mean", "content")), r("avg(tone - content)", "gap"), r("avg(low) * 100", "low_quality_rate")])

QUERIES = {
    "sample_gold_questions": lambda s, d: P.sample_gold_questions(responses(s, d)).select("question_id", "answer_id"),
    "feedback_eligibility": lambda s, d: P.feedback_eligibility(long_feedback(s, d)),
    "sample_balanced_feedback": lambda s, d: P.sample_balanced_feedback(long_feedback(s, d)),
    "question_model_row_index": lambda s, d: P.question_model_row_index(P.sample_balanced_feedback(long_feedback(s, d))).select("answer_id", "question_id", "model_name", "row_index"),
    "exam_metadata": metadata,
    "exam_value_distribution": lambda s, d: rounded(A.exam_value_distribution(exam_questions(s, d), responses(s, d), "question_topic")),
    "passing_distribution_interpolated": interpolated,
    "column_profile": lambda s, d: rounded(A.column_profile(responses(s, d).select(*_PROFILE))),
    "core_dataset_statistics": lambda s, d: rounded(A.core_dataset_statistics(responses(s, d))),
    "label_type_counts": lambda s, d: A.label_type_counts(responses(s, d)),
    "response_language_split": lambda s, d: rounded(A.response_language_split(responses(s, d))),
    "grade_distribution_by_scope": lambda s, d: rounded(A.grade_distribution_by_scope(responses(s, d))),
    "response_coverage": lambda s, d: A.bands(X.view(s, d, "activity"), "member_id", 1, 190),
    "student_categories": lambda s, d: A.bands(X.view(s, d, "activity"), "member_id", 50, 190),
    "engagement_by_week": lambda s, d: A.engagement_by_week(X.view(s, d, "activity"), "ts"),
    "release_statistics": lambda s, d: rounded(A.release_statistics(responses(s, d))),
    "describe_column": lambda s, d: rounded(A.describe_column(A.per_group_sizes(X.view(s, d, "activity"), "member_id"), "n")),
    "bloom_difficulty": lambda s, d: rounded(A.bloom_difficulty(responses(s, d))),
    "bloom_model_metrics": lambda s, d: rounded(A.bloom_model_metrics(responses(s, d), X.MODELS)),
    "bloom_family_metrics": lambda s, d: rounded(A.bloom_family_metrics(A.bloom_model_metrics(responses(s, d), X.MODELS))),
    "length_by_grade": lambda s, d: rounded(A.length_by_grade(responses(s, d))),
    "bloom_grade_share": lambda s, d: rounded(A.group_share(responses(s, d), "bloom_level", "grade")),
    "group_share": lambda s, d: rounded(A.group_share(responses(s, d), "question_topic", "label_type")),
    "question_grade_share": lambda s, d: rounded(A.question_grade_share(responses(s, d))),
    "question_difficulty": lambda s, d: rounded(A.question_difficulty(responses(s, d))),
    "student_performance": lambda s, d: rounded(A.student_performance(responses(s, d))),
    "llm_rate_by_length": lambda s, d: rounded(A.llm_rate_by_length(X.view(s, d, "answers_text"), "answer", "gold_is_llm")),
    "teacher_evaluation": lambda s, d: rounded(A.teacher_evaluation(responses(s, d), X.MODELS)),
    "confusion_long": lambda s, d: A.confusion_long(responses(s, d), X.MODELS),
    "feedback_quality": lambda s, d: rounded(A.feedback_quality(X.view(s, d, "feedback_ratings"))),
    "family_summary": lambda s, d: rounded(A.family_summary(summary(s, d), _NAMES)),
    "metric_curves": lambda s, d: rounded(A.metric_curves(summary(s, d), _NAMES)),
    "size_delta": lambda s, d: rounded(A.size_delta(summary(s, d), _NAMES)),
    "calibration_gap": lambda s, d: rounded(A.calibration_gap(summary(s, d))),
    "tau_gain": lambda s, d: rounded(A.tau_gain(E.item_metrics(responses(s, d), (*X.MODELS, "human_expert_two")), summary(s, d))),
    "metric_min_rank": lambda s, d: A.metric_min_rank(overall(s, d), _NAMES),
    "metric_ordinal_rank": lambda s, d: A.metric_ordinal_rank(overall(s, d), "el_acc_linear_abs"),
    "top_models": top_models,
    "natural_test_order": lambda s, d: A.natural_test_order(exam_questions(s, d)),
    "gold_release_checks": lambda s, d: A.gold_release_checks(responses(s, d).where("label_type = 'gold'")),
    "global_prior": lambda s, d: B.global_prior(responses(s, d)).select("answer_id", "split", "prediction"),
}

_FB = X.cte("feedback_long")
_ELIG = f"{_FB}, elig AS (SELECT DISTINCT answer_id, question_id FROM feedback_long WHERE model_grade IS NOT NULL AND model_feedback IS NOT NULL)"
_BAL = f"""{_ELIG}, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY md5(concat('1|', answer_id)), answer_id) AS rk FROM elig) WHERE rk <= 6),
    sl AS (SELECT answer_id, question_id, (row_number() OVER (PARTITION BY question_id ORDER BY md5(concat('2|', answer_id)), answer_id) - 1) // 2 AS slot FROM ch),
    bal AS (SELECT sl.answer_id, sl.question_id, m.model_name, f.model_grade FROM sl JOIN (SELECT 0 AS slot, 'alpha' AS model_name UNION ALL SELECT 1, 'beta' UNION ALL SELECT 2, 'gamma') m USING (slot) JOIN feedback_long f ON f.answer_id = sl.answer_id AND f.model_name = m.model_name)"""
_LEN = f"SELECT grade, {_WORDS} AS w FROM responses"

ORACLES = {
    "sample_gold_questions": f"""WITH {_BASE}, c AS (SELECT question_id, count(*) AS n FROM responses GROUP BY question_id HAVING count(*) >= 10), k AS (SELECT question_id, row_number() OVER (ORDER BY md5(concat('7|', question_id)), question_id) AS rk, ceil(count(*) OVER () * {dbl(0.1)}) AS k FROM c)
        SELECT question_id, answer_id FROM responses WHERE question_id IN (SELECT question_id FROM k WHERE rk <= k)""",
    "feedback_eligibility": f"WITH {_ELIG} SELECT * FROM elig",
    "sample_balanced_feedback": f"WITH {_BAL} SELECT * FROM bal",
    "question_model_row_index": f"WITH {_BAL} SELECT answer_id, question_id, model_name, row_number() OVER (PARTITION BY question_id, model_name ORDER BY answer_id) AS row_index FROM bal",
    "exam_metadata": f"""WITH {SAMPLE_SQL}, {X.cte('responses_dirty').split('responses_dirty AS', 1)[1].join(['dirty AS', ''])},
        raw AS (SELECT 'q' || question_id AS question_id, member_id, answer_id, answer, {', '.join(f'{e} AS {c}' for c, e in _OF_QUESTION.items())} FROM dirty),
        ok AS (SELECT trim(question_id) AS question_id, trim(member_id) AS member_id, trim(answer_id) AS answer_id, answer FROM raw WHERE trim(coalesce(question_id, '')) <> '' AND trim(coalesce(member_id, '')) <> '' AND trim(coalesce(answer_id, '')) <> ''),
        ex AS (SELECT * FROM exam),
        x AS (SELECT test_id, test_size, string_agg(question_id, ',' ORDER BY question_id) AS question_ids FROM ex GROUP BY ALL),
        el AS (SELECT test_id, test_size, member_id FROM ex JOIN ok USING (question_id) GROUP BY ALL HAVING count(DISTINCT question_id) = test_size),
        a AS (SELECT test_id, test_size, count(*) AS rows_all, count(DISTINCT member_id) AS students_all, count(DISTINCT answer_id) AS answers_all, count(*) FILTER (answer IS NULL OR trim(answer) = '') AS empty_all FROM ex JOIN raw USING (question_id) GROUP BY ALL),
        v AS (SELECT test_id, test_size, count(*) AS rows_valid, count(DISTINCT member_id) AS students_valid, count(DISTINCT answer_id) AS answers_valid, count(*) FILTER (answer IS NULL OR trim(answer) = '') AS empty_valid FROM ex JOIN ok USING (question_id) GROUP BY ALL),
        e AS (SELECT test_id, test_size, count(*) AS rows_eligible, count(DISTINCT answer_id) AS answers_eligible, count(*) FILTER (answer IS NULL OR trim(answer) = '') AS empty_eligible FROM ex JOIN ok USING (question_id) JOIN el USING (test_id, test_size, member_id) GROUP BY ALL),
        n AS (SELECT test_id, test_size, count(*) AS eligible_students, string_agg(member_id, ',' ORDER BY member_id) AS student_ids FROM el GROUP BY ALL),
        {', '.join(_distribution_sql(name, c) for name, c in A.DISTRIBUTIONS.items())}
        SELECT x.test_id, x.test_size, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _META)}, {', '.join(f"coalesce({c}, '') AS {c}" for c in _META_TEXTS)}
        FROM x {' '.join(f'LEFT JOIN {t} USING (test_id, test_size)' for t in ('a', 'v', 'e', 'n', *A.DISTRIBUTIONS))}""",
    "exam_value_distribution": f"WITH {SAMPLE_SQL} SELECT test_id, test_size, question_topic AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY test_id, test_size), 9) AS share FROM exam JOIN responses USING (question_id) GROUP BY test_id, test_size, question_topic",
    "passing_distribution_interpolated": f"WITH {_BASE}, k AS (SELECT count(*) FILTER (g >= {dbl(0.6)}) AS k FROM (SELECT avg(grade) AS g FROM responses GROUP BY member_id)) SELECT n_classes, class, {r('share', 'share')}, CAST(ceil(round(k * share, 9)) AS BIGINT) AS seats FROM (VALUES {_SHARES}) t(n_classes, class, share), k",
    "column_profile": f"WITH {_BASE} {' UNION ALL '.join(f'''SELECT '{c}' AS column_name, '{_TYPES.get(c, 'string')}' AS type, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, {r(f'count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) * 100', 'unique_pct')}, count(*) AS n_rows FROM responses''' for c in _PROFILE)}",
    "core_dataset_statistics": f"WITH {_BASE}, full_rows AS (SELECT *, {_WORDS} AS w, {LANGUAGE} AS lang FROM responses), gold_rows AS (SELECT * FROM full_rows WHERE label_type = 'gold') {_core_scope('full', 'full_rows')} UNION ALL {_core_scope('gold', 'gold_rows')}",
    "label_type_counts": f"WITH {_BASE} SELECT count(*) FILTER (label_type = 'gold') AS gold, count(*) FILTER (label_type = 'silver') AS silver, 0 AS other FROM responses",
    "response_language_split": f"WITH {_BASE}, l AS (SELECT {LANGUAGE} AS lang FROM responses) SELECT count(*) FILTER (lang <> 'de') AS english, count(*) FILTER (lang = 'de') AS german, count(*) FILTER (lang = 'unknown') AS unknown_counted_as_english, {', '.join(r(f'count(*) FILTER ({c}) * 100.0 / count(*)', n) for c, n in (('''lang <> 'de' ''', 'english_pct'), ('''lang = 'de' ''', 'german_pct'), ('''lang = 'unknown' ''', 'unknown_pct')))} FROM l",
    "grade_distribution_by_scope": f"WITH {_BASE}, s AS (SELECT 'full' AS scope, grade FROM responses UNION ALL SELECT label_type, grade FROM responses), g AS (SELECT * FROM (SELECT unnest(['full', 'gold', 'silver']) AS scope), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS grade)), c AS (SELECT g.scope, g.grade, count(s.grade) AS n FROM g LEFT JOIN s ON s.scope = g.scope AND s.grade = g.grade GROUP BY ALL) SELECT scope, grade, n, {r('coalesce(n * 100.0 / nullif(sum(n) OVER (PARTITION BY scope), 0), 0)', 'pct')} FROM c",
    "response_coverage": "SELECT count(*) AS total, count(*) FILTER (n < 1) AS low, count(*) FILTER (n >= 1 AND n < 190) AS middle, count(*) FILTER (n >= 190) AS high FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)",
    "student_categories": "SELECT count(*) AS total, count(*) FILTER (n < 50) AS low, count(*) FILTER (n >= 50 AND n < 190) AS middle, count(*) FILTER (n >= 190) AS high FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)",
    "engagement_by_week": "WITH w AS (SELECT CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 86400000000 // 7 + 1 AS INT) AS week FROM events) SELECT CAST(g.week AS INT) AS week, count(w.week) AS n FROM range(1, 19) g(week) LEFT JOIN w ON w.week = g.week GROUP BY g.week",
    "release_statistics": f"WITH {_BASE}, w AS (SELECT *, CASE WHEN answer IS NOT NULL THEN {_WORDS} END AS w FROM responses) SELECT count(DISTINCT member_id) AS students, count(*) AS responses, count(DISTINCT question_id) AS questions, count(*) FILTER (label_type = 'gold') AS gold, {r('avg(w)', 'mean_length')}, median(w) AS median_length, {', '.join(f'(SELECT round(avg(n), 9) FROM (SELECT count(*) AS n FROM w GROUP BY {k})) AS mean_per_{p}, (SELECT median(n) FROM (SELECT count(*) AS n FROM w GROUP BY {k})) AS median_per_{p}' for p, k in (('student', 'member_id'), ('question', 'question_id')))} FROM w",
    "describe_column": f"SELECT count(n) AS count, {r('avg(n)', 'mean')}, {r('stddev_samp(n)', 'std')}, min(n) AS min, {', '.join(r(f'quantile_cont(n, {q})', f'q{int(q * 100)}') for q in (0.25, 0.5, 0.75))}, max(n) AS max FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id)",
    "bloom_difficulty": f"WITH {_BASE} SELECT bloom_level, count(*) AS responses, count(DISTINCT question_id) AS questions, count(DISTINCT member_id) AS students, {r('avg(grade)', 'mean_score')}, median(grade) AS median_score, {r('1 - avg(grade)', 'difficulty')} FROM responses GROUP BY bloom_level",
    "bloom_model_metrics": f"WITH {_BLOOM} SELECT model_col, family, bloom_level, n, {', '.join(r(c, c) for c in ('mae', 'mse', 'qwk', 'tau_b'))} FROM bloom",
    "bloom_family_metrics": f"WITH {_BLOOM} SELECT family, bloom_level, count(DISTINCT model_col) AS n_models, {r('avg(n)', 'n_items_mean')}, {', '.join(r(f'avg({c})', c + '_mean') for c in ('mae', 'mse', 'qwk', 'tau_b'))} FROM bloom GROUP BY family, bloom_level",
    "length_by_grade": f"WITH {_BASE} SELECT grade, count(*) AS n, {r('avg(w)', 'mean_words')}, {r('median(w)', 'median_words')}, {r('quantile_cont(CAST(w AS DOUBLE), 0.75)', 'p75_words')} FROM ({_LEN}) GROUP BY grade",
    "bloom_grade_share": f"WITH {_BASE} SELECT bloom_level, grade, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY bloom_level), 9) AS pct FROM responses GROUP BY bloom_level, grade",
    "group_share": f"WITH {_BASE} SELECT question_topic, label_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY question_topic), 9) AS pct FROM responses GROUP BY question_topic, label_type",
    "question_grade_share": f"WITH {_BASE}, p AS (SELECT question_id, row_number() OVER (ORDER BY avg(grade), question_id) AS position FROM responses GROUP BY question_id) SELECT question_id, grade, n, pct, position FROM (SELECT question_id, grade, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY question_id), 9) AS pct FROM responses GROUP BY question_id, grade) JOIN p USING (question_id)",
    "question_difficulty": f"WITH {_BASE} SELECT question_id, bloom_level, {r('avg(grade)', 'mean_score')}, count(*) AS n, row_number() OVER (ORDER BY avg(grade), question_id) AS position FROM responses GROUP BY question_id, bloom_level",
    "student_performance": f"WITH {_BASE} SELECT member_id, {r('avg(grade)', 'mean_score')}, median(grade) AS median_score, count(*) AS n, CAST(least(floor(avg(grade) * 15), 14) AS INT) AS bin FROM responses GROUP BY member_id",
    "llm_rate_by_length": f"WITH {X.cte('answers_text')}, w AS (SELECT {_WORDS} AS w, CASE WHEN gold_is_llm = 'yes' THEN 1 ELSE 0 END AS y FROM answers_text), b AS (SELECT {_BINS} AS length_bin, w, y FROM w), l AS (SELECT unnest([{', '.join(repr(x[2]) for x in A.LENGTH_BINS)}]) AS length_bin) SELECT l.length_bin, count(w) AS responses, coalesce(sum(y), 0) AS llm_count, {r('sum(y) * 100.0 / nullif(count(w), 0)', 'llm_rate_pct')}, {r('avg(w)', 'mean_tokens')}, median(w) AS median_tokens FROM l LEFT JOIN b USING (length_bin) GROUP BY l.length_bin",
    "teacher_evaluation": f"WITH {ITEM_SQL}, who AS ({' UNION ALL '.join(f'''SELECT '{m}' AS model_col, count(DISTINCT question_id) AS questions, count(DISTINCT member_id) AS students FROM responses WHERE {m} IS NOT NULL''' for m in X.MODELS)}) SELECT model_col, item_source_n, item_n, item_missing, {', '.join(r(f'item_{c}', f'item_{c}') for c in ('mae', 'mse', 'rmse', 'tau_b', 'qwk'))}, questions, students FROM item JOIN who USING (model_col)",
    "confusion_long": f"WITH {_BASE}, l AS ({_CONF}), v AS (SELECT model_col, gold AS v FROM l UNION SELECT model_col, pred FROM l) SELECT a.model_col, a.v AS gold, b.v AS pred, count(l.gold) AS n FROM v a JOIN v b USING (model_col) LEFT JOIN l ON l.model_col = a.model_col AND l.gold = a.v AND l.pred = b.v GROUP BY a.model_col, a.v, b.v",
    "feedback_quality": f"WITH {X.cte('feedback_ratings')}, w AS (SELECT *, {_MEAN(_RUB)} AS mean, {_MEAN(_RUB[:-1])} AS content, CASE WHEN diag <= 2 AND align <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS low FROM feedback_ratings) SELECT model, {_QUALITY} FROM w GROUP BY model UNION ALL SELECT 'overall', {_QUALITY} FROM w",
    "family_summary": f"WITH {METRICS_SQL}, sm AS (SELECT model_col, test_size, {', '.join(f'avg({c}) AS {c}' for c in _NAMES)} FROM metrics GROUP BY model_col, test_size) SELECT {_FAMILY} AS family, test_size, count(DISTINCT model_col) AS n_models, {', '.join(r(f'avg({c})', c) for c in _NAMES)} FROM sm GROUP BY 1, 2",
    "metric_curves": f"WITH {METRICS_SQL}, sm AS (SELECT model_col, test_size, {', '.join(f'avg({c}) AS {c}' for c in _NAMES)} FROM metrics GROUP BY model_col, test_size) {' UNION ALL '.join(f'''SELECT test_size, '{c}' AS metric, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, count({c}) AS n, count(*) - count({c}) AS missing FROM sm GROUP BY test_size''' for c in _NAMES)}",
    "size_delta": f"WITH {METRICS_SQL}, sm AS (SELECT model_col, test_size, {', '.join(f'avg({c}) AS {c}' for c in _NAMES)} FROM metrics GROUP BY model_col, test_size) SELECT a.model_col, {', '.join(r(f'b.{c} - a.{c}', f'{c}_delta') for c in _NAMES)} FROM sm a JOIN sm b USING (model_col) WHERE a.test_size = 5 AND b.test_size = 21",
    "calibration_gap": f"WITH {METRICS_SQL} SELECT model_col, test_size, {r('avg(el_qwk_bologna) - avg(el_qwk_linear_abs)', 'gap')} FROM metrics GROUP BY model_col, test_size",
    "tau_gain": f"WITH {METRICS_SQL}, {ITEM_SQL[len(X.cte('responses')) + 2:]} SELECT model_col, test_size, {r('any_value(item_tau_b)', 'item_tau_b')}, {r('avg(el_tau_b) - any_value(item_tau_b)', 'gain')} FROM metrics JOIN item USING (model_col) GROUP BY model_col, test_size",
    "metric_min_rank": f"{_OVERALL} SELECT model_col, {', '.join(f'rank() OVER (ORDER BY {c} DESC NULLS LAST) AS {c}_rank' for c in _NAMES)} FROM overall",
    "metric_ordinal_rank": f"{_OVERALL} SELECT model_col, el_acc_linear_abs, row_number() OVER (ORDER BY el_acc_linear_abs DESC, model_col) AS position FROM overall WHERE el_acc_linear_abs IS NOT NULL",
    "top_models": f"WITH {SWEEP_SQL} SELECT model_col, {r('qwk_mean', 'qwk_mean')} FROM gsum WHERE n_classes = 10 AND scale = 'absolute' ORDER BY 2 DESC NULLS LAST, 1 LIMIT 3",
    "natural_test_order": f"WITH {SAMPLE_SQL} SELECT test_id, row_number() OVER (ORDER BY CAST(regexp_extract(test_id, '(\\d+)$', 1) AS BIGINT)) AS position FROM (SELECT DISTINCT test_id FROM exam)",
    "gold_release_checks": f"WITH {_BASE} SELECT count(*) AS n_rows, 0 AS off_scale, count(*) FILTER (abs(human_expert_one_gold - human_expert_two) > 0.5) AS open_audit, 0 AS missing_grade, count(*) FILTER ({_WORDS} = 0) AS empty_answers, count(*) FILTER (gold_is_llm = 'Yes') AS llm_answers, {', '.join(f'''count(*) FILTER (bloom_level = '{b}') AS n_{b}''' for b in A.BLOOM)} FROM responses WHERE label_type = 'gold'",
    "global_prior": f"WITH {_BASE}, m AS (SELECT ceil(avg(grade) * 4 - 0.5) / CAST(4 AS DOUBLE) AS p FROM responses WHERE split = 'train') SELECT answer_id, split, CASE WHEN split = 'test' THEN p END AS prediction FROM responses, m",
}
