"""Work that is done on counts and sets instead of a row for every exam and student."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.operators import baselines as B, exam as E, joins as J, sampling as P, sheets, significance as T, tables as A
from marksheet.operators.sheets import sittings

EXAMS = (("t1", 2, "ab"), ("t2", 3, "abc"), ("t3", 1, "d"), ("t4", 2, "abc"))


@pytest.fixture
def exam(spark):
    return spark.createDataFrame([(t, z, q, i + 1) for t, z, qs in EXAMS for i, q in enumerate(qs)], "test_id string, test_size int, question_id string, question_order int")


def answers(spark, values):
    """Some students without some answers, or with two of them, and a row without student."""
    random.seed(1)
    one = lambda: None if (v := random.choice(values) if random.random() < 0.9 else values[1]) is None else float(v)
    rows = [(f"m{m}", q, one(), one(), one(), one()) for m in range(60) for q in "abcd" for _ in range(random.choice([0, 1, 1, 1, 1, 1, 2]))]
    return spark.createDataFrame([*rows, (None, "a", 1.0, 1.0, 1.0, 1.0)], "member_id string, question_id string, human_grade double, human_expert_one_gold double, human_expert_two double, new_grade_a double")


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("values", [(0, 0.25, 0.5, 1, None), (0.1, 0.2, 0.3, 1e300, None, float("inf"))])
def test_students_counted_in_tasks_are_those_of_the_rows(spark, exam, values):
    df, models = answers(spark, values), ["new_grade_a", "human_expert_two"]
    want = E.exam_states(E.student_exam_totals(sittings(exam, df, E.graded_columns(models)), models))
    found = E.sheet_states(exam, df, models)
    assert rows_of(found, *want.columns) == rows_of(want, *want.columns) and want.count() > 50
    assert E.sheet_states(exam.limit(0), df, models).count() == 0 and E.sheet_states(exam, df.limit(0), models).count() == 0


def texts(spark):
    df = answers(spark, (0, 0.25, 0.5, 1, None))
    return df.withColumns({"answer_id": F.concat_ws("-", "member_id", "question_id"), "answer": F.when(F.col("human_grade") == 0.5, " ").otherwise(F.concat(F.col("question_id"), F.col("human_grade").cast("string")))})


def test_exam_structure_is_summed_once_an_exam(spark, exam):
    students = P.eligible_students(exam, texts(spark))
    want = P.exam_structure_join(exam, students).groupBy("test_id", "test_size", "member_id").agg(F.count_distinct("question_id").alias("n_questions"), F.sum("question_order").alias("orders"))
    assert rows_of(P.exam_structure_sums(exam, students), *want.columns) == rows_of(want, *want.columns)


def test_exam_environment_is_summed_without_laying_it_out(spark, exam):
    df = texts(spark)
    env = P.exam_env_join(exam, P.eligible_students(exam, df), df)
    want = env.groupBy("test_id", "test_size", "question_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("answer")).alias("answer_chars"), F.min("answer").alias("first_answer"), F.max("answer_id").alias("last_answer_id"), F.count_distinct("member_id").alias("students"),
        F.count("new_grade_a").alias("new_grade_a_n"), F.sum("new_grade_a").alias("new_grade_a_sum"),
    )
    found = P.exam_env_sums(exam, df, ["new_grade_a"])
    assert found.columns == want.columns and rows_of(found, *want.columns) == rows_of(want, *want.columns)


def test_exam_metadata_counts_sets_of_questions(spark, exam):
    raw = texts(spark)
    valid = raw.where("member_id IS NOT NULL AND answer <> 'a1.0'")
    found = {r["test_id"]: r for r in A.exam_metadata(exam, raw, valid).collect()}
    of = {"all": raw.collect(), "valid": valid.collect()}
    empty = lambda rows: sum(not (r["answer"] or "").strip() for r in rows)
    for name, size, questions in EXAMS:
        for kind, rows in of.items():
            rows = [r for r in rows if r["question_id"] in questions]
            want = [len(rows), len({r["member_id"] for r in rows} - {None}), len({r["answer_id"] for r in rows} - {None}), empty(rows)]
            assert [found[name][f"{c}_{kind}"] for c in ("rows", "students", "answers", "empty")] == want
        sit = {r["member_id"] for r in rows if len({x["question_id"] for x in rows if x["member_id"] == r["member_id"]}) == size == len(questions)}
        mine = [r for r in rows if r["member_id"] in sit]
        assert [found[name][c] for c in ("rows_eligible", "empty_eligible", "eligible_students")] == [len(mine), empty(mine), len(sit)]


def test_exam_metadata_leaves_no_part_out(spark, exam):
    """Questions, students by name, answers of eligible students and distributions; an exam without rows, too."""
    more = spark.createDataFrame([("t5", 1, "z", 1)], exam.schema)
    # Some answer ids belong to several students and questions.
    raw = texts(spark).withColumns({"answer_id": F.concat(F.lit("x"), F.pmod(F.xxhash64("answer_id"), F.lit(90))), "bloom_level": F.when(F.col("question_id") == "a", " low ").when(F.col("question_id") == "b", " ").otherwise("high")})
    valid = raw.where("member_id IS NOT NULL AND answer <> 'a1.0'")
    found = {r["test_id"]: r for r in A.exam_metadata(exam.union(more), raw, valid).collect()}
    assert "topic_distribution" not in A.exam_metadata(exam, raw, valid).columns and len(found) == len(EXAMS) + 1
    every, rows = raw.collect(), valid.collect()
    for name, size, questions in (*EXAMS, ("t5", 1, "z")):
        mine = [r for r in rows if r["question_id"] in questions]
        sit = {m for m in {r["member_id"] for r in mine} if len({r["question_id"] for r in mine if r["member_id"] == m}) == size == len(questions)}
        assert found[name]["question_ids"] == ",".join(sorted(questions)) and found[name]["student_ids"] == ",".join(sorted(sit))
        assert found[name]["answers_eligible"] == len({r["answer_id"] for r in mine if r["member_id"] in sit})
        levels = Counter(v for r in every if r["question_id"] in questions if (v := r["bloom_level"].strip()))
        lines = [f"{v}={n} ({n / sum(levels.values()):.4f})" for v, n in sorted(levels.items(), key=lambda x: (-x[1], x[0]))]
        assert found[name]["bloom_distribution"] == "\n".join(lines)
    assert found["t5"]["rows_all"] == found["t5"]["eligible_students"] == 0 and found["t1"]["answers_eligible"] > 0


def test_values_are_counted_before_exams_are_met(spark, exam):
    df = texts(spark)
    found = A.exam_value_distribution(exam, df, "answer")
    n = {(r["test_id"], r["value"]): r["n"] for r in found.collect()}
    want = {}
    for r in df.where("trim(answer) <> ''").collect():
        for name, _, questions in EXAMS:
            if r["question_id"] in questions:
                want[name, r["answer"]] = want.get((name, r["answer"]), 0) + 1
    assert n == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") > 1 and plan.rindex("Aggregate") > plan.rindex("Join")


def test_ranks_from_counts_are_those_of_the_rows(spark, exam):
    df, models = answers(spark, (0, 0.25, 0.5, 1, None)), ["new_grade_a"]
    sat, cells = sittings(exam, df, E.graded_columns(models)), E.cells_of_states(E.sheet_states(exam, df, models))
    want, found = E.student_scale_export(sat, "new_grade_a"), E.student_scale_export(sat, "new_grade_a", cells)
    assert rows_of(found, *want.columns) == rows_of(want, *want.columns) and want.count() > 20
    # However small the planner takes the cells for, they are not sent to the driver and the tasks.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "pred_total" in line] and plan.count("SortMergeJoin") == 2
    labels = T.exam_label_table(sat, models, 2, E.cells_of_states(E.sheet_states(exam.where("test_size = 2"), df, models)))
    assert rows_of(labels, *labels.columns) == rows_of(T.exam_label_table(sat, models, 2), *labels.columns)


@pytest.mark.parametrize("values", [(0, 0.25, 0.5, 1, None), (0.1, 0.2, 0.3, 1e300, None, float("inf"))])
def test_students_numbered_in_tasks_have_the_ranks_of_the_rows(spark, exam, values, monkeypatch):
    df, models = answers(spark, values), ["new_grade_a", "human_expert_two"]
    want = E.rank_by_total(E.completeness_filter(E.student_exam_totals(sittings(exam, df, E.graded_columns(models)), models)))
    for held in (1 << 20, 2000):  # all students of a range together, or a few
        monkeypatch.setattr(sheets, "HELD", held)
        monkeypatch.setattr(sheets, "IN_RANGE", 20)
        found = E.sheet_ranks(exam, df, models)
        assert rows_of(found, *found.columns) == rows_of(want, *found.columns) and want.count() > 50
        # No row of a sitting moves: what is above the numbering is one join with the exams.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan[: plan.index("MapInArrow")] and plan[: plan.index("MapInArrow")].count("Join") == 1
    assert E.sheet_ranks(exam.limit(0), df, models).count() == 0 and E.sheet_ranks(exam, df.limit(0), models).count() == 0


def test_pairs_counted_in_tasks_are_those_of_the_rows(spark, exam):
    df, models = answers(spark, (0, 0.25, 0.5, 1, None)), ["new_grade_a", "human_expert_two"]
    pairs = spark.createDataFrame([models, models[::-1]], "a string, b string")
    want = T.pair_cells(sittings(exam, df, E.graded_columns(models)), models, pairs)
    labels = T.sheet_label_cells(exam, df, models)
    found = T.sheet_pair_cells(exam, df, pairs, labels)
    assert rows_of(found, *want.columns) == rows_of(want, *want.columns) and want.count() > 10
    assert T.sheet_pair_cells(exam, df, pairs.limit(0), labels).count() == 0


def test_checks_of_counts_are_those_of_the_label_table(spark, exam):
    models, exam, df = ["new_grade_a", "human_expert_two"], exam.where("test_size = 2"), answers(spark, (0, 0.25, 0.5, 1, None))
    kept = lambda rows: spark.createDataFrame(rows.collect(), rows.schema).coalesce(1)
    sat = kept(sittings(exam, df, E.graded_columns(models)))
    cells = kept(T.label_cells(sat, models, 2))
    want = T.sanity_checks(kept(T.exam_label_table(sat, models, 2)), models, 2, exams=2)
    found = T.sanity_checks(cells, models, 2, exams=2, students=T.sheet_checks(exam, df, models, cells))
    assert rows_of(found, *want.columns) == rows_of(want, *want.columns)
    failed = {r["name"]: r["offending"] for r in want.collect() if not r["passed"]}
    assert failed["gold_labels_agree"] > 1 and failed["same_exam_students"] == 1
    with pytest.raises(ValueError, match="checks of students"):
        T.sanity_checks(cells, models, 2)


def jobs(spark, work):
    """What ``work`` gives, and how many Spark jobs it took."""
    sc, name = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(name, name)
    try:
        return work(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def closed_form(x, y, train):
    a = x[train] - x[train].mean(0)
    w = np.linalg.solve(a.T @ a + np.eye(x.shape[1]), a.T @ (y[train] - y[train].mean()))
    return (x - x[train].mean(0)) @ w + y[train].mean()


def graded_texts(spark, copies):
    rng, words = np.random.default_rng(3), ["alpha", "beta", "gamma", "delta", "eps"]
    kinds = [("train" if i < 30 else "test", f"q{i % 3}", " ".join(rng.choice(words, 1 + i % 6)) if i % 7 else [None, ""][i % 2], float(rng.integers(0, 5)) / 4) for i in range(45)]
    rows = [(f"{c}-{i}", *k) for i, k in enumerate(kinds) for c in range(copies[i % len(copies)])]
    return spark.createDataFrame(rows, "answer_id string, split string, question string, answer string, grade double")


def laid_out(rows, column):
    x = np.zeros((len(rows), rows[0][column]["size"]))
    for i, r in enumerate(rows):
        x[i, r[column]["indices"]] = r[column]["values"]
    return x


def test_variants_are_worked_out_once_a_case(spark, monkeypatch):
    """Copies are weighed, not repeated, and a recipe takes few passes."""
    df, seen, settled = graded_texts(spark, (1, 4, 9)), Counter(), B.settled

    def noted(rows, name):
        out = settled(rows, name)
        seen[name] = max(seen[name], out.count())
        return out

    monkeypatch.setattr(B, "settled", noted)
    name = "v1_answer_word_unigram"
    (made, n) = jobs(spark, lambda: B.tfidf_variants(df, [name]).orderBy("answer_id").collect())
    assert len(made) == df.count() == len({r["answer_id"] for r in made}) and n < 60
    assert seen["cases"] == df.select("question", "answer", "split", "grade").distinct().count() < len(made) / 3 and seen["texts"] <= seen["cases"]
    rows = B.tfidf_word_features(df, "answer", longest=1, size=30_000).orderBy("answer_id").collect()
    train, y = np.array([r["split"] == "train" for r in rows]), np.array([r["grade"] for r in rows])
    raw = np.clip(closed_form(laid_out(rows, "features"), y, train), 0, 1)
    for r, want, used in zip(made, raw, train, strict=True):
        assert r[f"pred_tfidf_{name}"] is None if used else abs((want * 4 - 0.5) % 1) < 1e-6 or r[f"pred_tfidf_{name}"] == np.ceil(want * 4 - 0.5) / 4


def test_features_are_made_once_a_text_in_tasks_by_length(spark, monkeypatch):
    """Different texts only are written down, no table of terms, and long input gets more tasks."""
    df, seen, settled = graded_texts(spark, (1, 4, 9)), {}, B.settled

    def noted(rows, name):
        seen[name] = settled(rows, name)
        return seen[name]

    monkeypatch.setattr(B, "settled", noted)
    few = B.tfidf_char_features(df, "answer").orderBy("answer_id").collect()
    assert seen["texts"].count() == seen["features"].count() == df.select(F.coalesce("answer", F.lit(""))).distinct().count() and "terms" not in seen
    files = len(seen["features"].inputFiles())
    monkeypatch.setattr(B, "_CHARS", 5)
    assert few == B.tfidf_char_features(df, "answer").orderBy("answer_id").collect()
    assert len(seen["features"].inputFiles()) > files


def test_ridge_of_weighed_rows_takes_few_passes(spark, monkeypatch):
    df = graded_texts(spark, (1, 4, 9))
    rows = B.tfidf_word_features(df, "answer").orderBy("answer_id")
    once = df.groupBy("split", "answer", "grade").agg(F.count(F.lit(1)).alias("times"))
    weighed = B.tfidf_word_features(once, "answer", weight="times")
    kept = rows.collect()
    want = closed_form(laid_out(kept, "features"), np.array([r["grade"] for r in kept]), np.array([r["split"] == "train" for r in kept]))
    by_text = {r["answer"]: w for r, w in zip(kept, want, strict=True)}
    for most in (B.PRODUCTS, 1):  # by the normal equations, and by conjugate gradients
        monkeypatch.setattr(B, "PRODUCTS", most)
        made, n = jobs(spark, lambda: B.tfidf_ridge_predict(rows, "features", raw="raw").orderBy("answer_id").collect())
        assert [r["raw"] for r in made] == pytest.approx(list(want), abs=1e-5) and (n < 25 or most == 1)
        for r in B.tfidf_ridge_predict(weighed, "features", raw="raw", weight="times").collect():
            assert r["raw"] == pytest.approx(by_text[r["answer"]], abs=1e-5)


def test_exam_queries_read_the_tables_once(spark, monkeypatch):
    from marksheet.registered import exam as X, significance as G

    read, view = Counter(), X.X.view

    def noted(s, d, name):
        read[name] += 1
        return view(s, d, name)

    monkeypatch.setattr(X.X, "view", noted)
    for made in (X.states, X.sat, X.students, X.exported, G.sat, G.labels, G.cells):
        read.clear()
        found = made(spark, "/root/testdata/sf0.001")
        assert read == {"responses": 1} and not [f for f in found.inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["tfidf_char_features", "tfidf_ridge_predict"])
def test_text_queries_read_the_tables_once(spark, name):
    from marksheet.queries import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not [f for f in found.inputFiles() if "lineitem" in f]


def test_exams_are_dealt_to_many_tasks(spark, exam):
    df, models = answers(spark, (0, 0.25, 0.5, 1, None)), ["new_grade_a", "human_expert_two"]
    cells = E.cells_of_states(E.sheet_states(exam, df, models))
    for made in (E.with_scales(cells), E.with_scales(cells).groupBy("model_col", *E.EXAM, "gold_linear_abs").count(), E.granularity_labels(cells)):
        assert made.rdd.getNumPartitions() == sheets.many_parts(cells)


def test_key_sets_are_counted_from_what_sheets_lack(spark, exam, monkeypatch):
    """As from the rows, in one block of sheets or several; equal sheets are counted before exams are met."""
    df, models = answers(spark, (0, 0.25, 0.5, 1, None)), ["new_grade_a", "human_expert_two"]
    twins = df.unionByName(df.withColumn("member_id", F.concat("member_id", F.lit("-twin"))))
    rows = E.completeness_filter(E.student_exam_totals(sittings(exam, twins, E.graded_columns(models)), models))
    sets = {m: {tuple(r) for r in rows.where(F.col("model_col") == m).select("test_id", "test_size", "member_id").collect()} for m in models}
    first = sets[min(models)]
    want = sorted((m, len(first - s), len(s - first)) for m, s in sets.items())
    assert any(m or x for _, m, x in want)
    assert sorted(map(tuple, J.model_key_sets(rows).collect())) == want
    states, seen, settled = E.exam_states(E.student_exam_totals(sittings(exam, twins, E.graded_columns(models)), models)), {}, sheets.settled
    monkeypatch.setattr(sheets, "settled", lambda rows, name: seen.setdefault(name, settled(rows, name)))
    for held in (sheets.HELD, 4000):
        monkeypatch.setattr(sheets, "HELD", held)
        seen.clear()
        assert sorted(map(tuple, E.sheet_key_sets(exam, twins, models).collect())) == want
        assert seen["sheets"].count() <= 60
        assert rows_of(E.sheet_states(exam, twins, models), *states.columns) == rows_of(states, *states.columns)


@pytest.mark.parametrize("values", [(0, 0.25, 0.5, 1, None), (-3, -0.5, 2.25, 1000, 7), (2.0**-12, 3 * 2.0**-12, 0.25, None, 1)])
def test_plain_sheets_are_counted_by_one_number_a_view(spark, exam, values, monkeypatch):
    """Sheets of one row a question by the sum of their codes, others (and grades in no whole steps) column by column, alike in one block or several."""
    df, models = answers(spark, values), ["new_grade_a", "human_expert_two", "human_grade"]
    want = E.exam_states(E.student_exam_totals(sittings(exam, df, E.graded_columns(models)), models))
    seen, counted, coded = [], sheets._counted, sheets._counted_codes
    monkeypatch.setattr(sheets, "_counted", lambda dealt, *a: (seen.append(("columns", dealt.select("times", "n_rows").distinct().count())), counted(dealt, *a))[1])
    monkeypatch.setattr(sheets, "_counted_codes", lambda dealt, *a: (seen.append(("codes", dealt.count())), coded(dealt, *a))[1])
    for held in (sheets.HELD, 400):
        monkeypatch.setattr(sheets, "HELD", held)
        seen.clear()
        assert rows_of(E.sheet_states(exam, df, models), *want.columns) == rows_of(want, *want.columns) and want.count() > 50
        assert [kind for kind, n in seen if n] == (["columns"] if 2.0**-12 in values else ["codes", "columns"])


def test_scales_are_compared_in_one_row_a_cell(spark):
    """As by kappa on the labels that an exam has, constant exams and lone grades with them."""
    random.seed(3)
    exams = {"t1": (0, 1), "t2": tuple(i / 4 for i in range(21)), "t3": (5,), "t4": (1, 5)}
    cells = [("m", t, 5, float(g), float(p), random.randint(1, 9)) for t, v in exams.items() for g in v for p in v if random.random() < 0.6 or len(v) < 3]
    df = E.with_scales(spark.createDataFrame([*cells, ("m", "t5", 5, 0.0, 5.0, 4)], "model_col string, test_id string, test_size int, gold_total double, pred_total double, n long"))
    found = {r["test_id"]: r for r in E.scale_agreement(df).collect()}
    want = E.qwk_observed(E.scale_pairs(df), ["test_id", "scale"], "y", "p", weight="n").collect()
    assert len(want) == 25 and {r["qwk"] for r in want} >= {0.0, 1.0}
    for r in want:
        acc, qwk = (f"el_{m}_{r['scale']}" if not r["scale"].startswith("pass_") else f"el_pass_{m}_{r['scale'][5:]}" for m in ("acc", "qwk"))
        assert (found[r["test_id"]][acc], found[r["test_id"]][qwk]) == (r["accuracy"], r["qwk"])
    assert "Generate" not in E.scale_agreement(df)._jdf.queryExecution().optimizedPlan().toString()
