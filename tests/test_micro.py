"""Hand-computed tables for the exact semantics."""

import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from marksheet.functions import agreement as G, columns as C, scales as S
from marksheet.functions.quantiles import exact_quantiles
from marksheet.operators import clean as K, exam as E, joins as J, rich_text as R, significance as T
from marksheet.operators.ranks import global_position
from marksheet.operators.sheets import eligible, sittings
from marksheet.sources import io, snapshots


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_rounding_is_half_even(spark):
    assert column(spark, [0.05, 0.15, 0.25, 1.0, 0.0, None], S.grade_linear_abs) == [1.0, 2.0, 2.0, 6.0, 1.0, None]
    assert column(spark, [0.59, 0.6, None], S.pass_fail_abs) == [False, True, False]


def test_snap_ties_go_down(spark):
    assert column(spark, [0.125, 0.375, 0.13, 1.7, -3.0, None], C.snap_to_grade) == [0.0, 0.25, 0.25, 1.0, 0.0, None]


def test_consensus(spark):
    pairs = [(1.0, 0.75), (0.0, 0.25), (1.0, 0.5), (1.0, 0.25), (None, 0.5), (0.25, 0.5), (0.5, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").orderBy("i")
    assert [r[0] for r in df.select(C.consensus_grade(F.col("a"), F.col("b"))).collect()] == [0.75, 0.25, 0.75, None, None, 0.5, 0.5]
    assert [r[0] for r in df.select(C.audit_status(F.col("a"), F.col("b"))).collect()] == ["within_threshold"] * 3 + ["distance_gt_0.5", "invalid_grade_input"] + ["within_threshold"] * 2


def labels_by_loop(points, size):
    """Ranks walked one by one, as a check of rank() and the cut-offs."""
    passed = sorted((p for p in points if p / size * size >= size * 0.6), reverse=True)
    cuts = [int(np.ceil(len(passed) * c)) for c in itertools.accumulate((0.10, 0.25, 0.30, 0.25, 0.10))]
    if cuts:
        cuts[-1] = len(passed)
    out = []
    for p in points:
        if p / size * size < size * 0.6:
            out.append("F")
            continue
        first = passed.index(p) + 1
        out.append(next(name for name, c in zip("ABCDE", cuts, strict=True) if first <= c))
    return out


@pytest.mark.parametrize("points", [[10, 10, 9, 9, 9, 8, 7, 6, 6, 5], [1, 2, 3], [10], [6.0] * 7, [10, 9.5, 9, 8.5, 8, 7.5, 7, 6.5, 6, 5.75, 0]])
def test_distribution_labels(spark, points):
    df = spark.createDataFrame([(i, float(p) / 10) for i, p in enumerate(points)], "i int, norm double")
    w = Window.partitionBy()
    rank, passed = F.rank().over(w.orderBy(F.desc("norm"))), F.sum(S.points_passed(F.col("norm"), F.lit(10.0)).cast("int")).over(w)
    got = df.withColumn("l", S.grade_distribution_label(F.col("norm"), F.lit(10.0), rank, passed)).orderBy("i").collect()
    assert [r["l"] for r in got] == labels_by_loop(points, 10)
    # The same from counts of totals, with several students to a total.
    students = spark.createDataFrame([("m", "t", 10, f"s{i}", float(p), float(p)) for i, p in enumerate(points)], "model_col string, test_id string, test_size int, member_id string, gold_total double, pred_total double")
    scaled = {r["member_id"]: r for r in E.student_scales(students).collect()}
    assert [scaled[f"s{i}"]["gold_bologna_label"] for i in range(len(points))] == labels_by_loop(points, 10)
    assert sorted(r["rank"] for r in E.rank_by_total(students).collect()) == list(range(1, len(points) + 1))


def matrix_kappa(y, p):
    values = sorted({*y, *p})
    if len(set(y)) == 1 and len(set(p)) == 1:
        return float(y[0] == p[0])
    k = len(values)
    seen = np.zeros((k, k))
    for a, b in zip(y, p, strict=True):
        seen[values.index(a), values.index(b)] += 1
    w = np.subtract.outer(np.arange(k), np.arange(k)) ** 2
    expected = np.outer(seen.sum(1), seen.sum(0)) / len(y)
    return 1 - (w * seen).sum() / (w * expected).sum()


def naive_tau(y, p):
    pairs = list(itertools.combinations(range(len(y)), 2))
    s = sum(np.sign(y[a] - y[b]) * np.sign(p[a] - p[b]) for a, b in pairs)
    ny, np_ = sum(y[a] != y[b] for a, b in pairs), sum(p[a] != p[b] for a, b in pairs)
    return s / np.sqrt(ny * np_) if ny and np_ else None


def test_kappa_and_tau(spark):
    rng = np.random.default_rng(5)
    groups = {"same": ([1.0] * 4, [1.0] * 4), "apart": ([1.0] * 3, [2.0] * 3), "one": ([2.0], [3.0]), "gap": ([0.0, 0.25, 1.0, 1.0], [0.25, 0.25, 1.0, 0.0])}
    groups |= {f"r{i}": (list(rng.integers(0, 5, 30) / 4), list(rng.integers(0, 5, 30) / 4)) for i in range(4)}
    rows = [(g, float(a), float(b)) for g, (y, p) in groups.items() for a, b in zip(y, p, strict=True)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    kappa = {r["g"]: r for r in G.qwk_observed(df, ["g"], "y", "p").collect()}
    tau = {r["g"]: r["tau_b"] for r in G.kendall_tau_b(df, ["g"], "y", "p").collect()}
    for g, (y, p) in groups.items():
        assert kappa[g]["qwk"] == pytest.approx(matrix_kappa(y, p)) and kappa[g]["n"] == len(y)
        want = naive_tau(y, p) if len(y) > 1 else None
        assert tau[g] == (pytest.approx(want) if want is not None else None)
    fixed = {r["g"]: r["q"] for r in df.groupBy("g").agg(G.qwk_fixed(F.col("y") * 4, F.col("p") * 4).alias("q")).collect()}
    assert fixed["gap"] != pytest.approx(kappa["gap"]["qwk"])  # gaps keep their distance


def test_mean_centred(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 4.0), ("b", 4.0), ("c", 1.0), ("c", 3.0)], "e string, t double")
    got = df.withColumn("g", S.grade_linear_mean_centered(F.col("t"), F.lit(4.0), F.avg("t").over(Window.partitionBy("e")))).orderBy("e", "t").collect()
    assert [r["g"] for r in got] == [1.0, 1.0, 3.5, 3.5, 2.0, 5.0]


def test_missing_predictions_and_reference(spark):
    answers = spark.createDataFrame([("m1", q, 1.0, 1.0, 0.5, p) for q, p in (("q1", 1.0), ("q2", None))] + [("m2", q, 0.5, 0.75, 0.5, 0.5) for q in ("q1", "q2")], "member_id string, question_id string, human_grade double, human_expert_one_gold double, human_expert_two double, new_grade_a double")
    exam = spark.createDataFrame([("t", 2, "q1"), ("t", 2, "q2")], "test_id string, test_size int, question_id string")
    models = ["new_grade_a", "human_expert_two"]
    totals = E.student_exam_totals(sittings(exam, answers, E.graded_columns(models)), models)
    counts = {r["model_col"]: r for r in E.completeness_counts(totals).collect()}
    assert counts["new_grade_a"]["n_students"] == 1 and counts["new_grade_a"]["students_missing_prediction"] == 1 and counts["human_expert_two"]["n_students"] == 2
    totals = {(r["model_col"], r["member_id"]): r for r in totals.collect()}
    assert totals["human_expert_two", "m2"]["gold_total"] == 1.5 and totals["new_grade_a", "m2"]["gold_total"] == 1.0 and totals["new_grade_a", "m1"]["pred_total"] == 1.0
    empty = E.exam_metrics(sittings(exam, answers.where("member_id = 'm1'"), E.graded_columns(models)), ["new_grade_a"]).first()
    assert empty["n_students"] == 0 and empty["el_tau_b"] is None and empty["students_raw"] == 1


def test_sheets_equal_brute_force(spark, monkeypatch):
    """Bitmaps of several words, repeated answers, gaps, nulls and exams in blocks."""
    rng = random.Random(3)
    answers = [(f"m{m}", f"q{q:03}", rng.choice([0.0, 0.25, 0.5, 1.0, None]), rng.choice([0.0, 0.5, None])) for m in range(30) for q in range(150) if rng.random() < (1 if m < 3 else 0.93)]
    answers += [("m1", "q007", 0.5, None), (None, "q001", 1.0, 1.0), ("m2", None, 1.0, 1.0), ("m3", "elsewhere", 1.0, 1.0)]
    exams = [(f"t{t}", n, f"q{q:03}") for t, n in enumerate((1, 2, 5, 20, 70, 3)) for q in rng.sample(range(150), n)] + [("gone", 2, "q001"), ("gone", 2, "q999"), ("short", 3, "q001"), ("short", 3, "q002")]
    df = spark.createDataFrame(answers, "member_id string, question_id string, human_grade double, new_grade_a double")
    exam = spark.createDataFrame(exams, "test_id string, test_size int, question_id string")
    want = set()
    for t, n in {(t, n) for t, n, _ in exams}:
        asked = {q for a, _, q in exams if a == t}
        for m in {a[0] for a in answers if a[0]}:
            mine = [a for a in answers if a[0] == m and a[1] in asked]
            if {a[1] for a in mine} == asked and len(asked) == n:
                y, p = ([a[i] for a in mine if a[i] is not None] for i in (2, 3))
                want.add((t, m, len(mine), n, len(y), len(p), sum(y), sum(p)))
    assert len({w[0] for w in want}) > 3
    for most in (1_000_000, 30):
        monkeypatch.setattr("marksheet.operators.sheets.ENTRIES", most)
        sat = sittings(exam, df, E.graded_columns(["new_grade_a"]))
        got = E.student_exam_totals(sat, ["new_grade_a"])
        assert {(r["test_id"], r["member_id"], *(r[c] for c in ("n_rows", "n_questions", "human_valid", "pred_valid", "gold_total", "pred_total"))) for r in got.collect()} == want
        assert {(r[0], r[2]) for r in eligible(sat).collect()} == {w[:2] for w in want}
    assert sittings(exam.limit(0), df).count() == 0 and sittings(exam, df.limit(0)).count() == 0


def test_exam_core_makes_no_row_for_a_question(spark):
    """From sheets to metrics nothing is exploded but models, and exam-students are not shuffled."""
    df = spark.createDataFrame([("m", "q", 1.0, 1.0)], "member_id string, question_id string, human_grade double, new_grade_a double")
    exam = spark.createDataFrame([("t", 1, "q")], "test_id string, test_size int, question_id string")
    totals = E.student_exam_totals(sittings(exam, df, E.graded_columns(["new_grade_a"])), ["new_grade_a"])
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "NestedLoopJoin" not in plan and plan.count("Generate explode") == 1
    assert not re.search(r"Exchange hashpartitioning\([^)]*test_id[^)]*member_id", plan)
    metrics = E.exam_metrics(sittings(exam, df, E.graded_columns(["new_grade_a"])), ["new_grade_a"])
    assert "member_id" not in metrics._jdf.queryExecution().executedPlan().toString() and metrics.first()["n_students"] == 1


def test_mcnemar(spark):
    from math import comb

    df = spark.createDataFrame([("a", str(i), x, y, x + y) for i, (x, y) in enumerate([(0, 0), (3, 9), (5, 5), (200, 260)])], "a string, b string, only_a long, only_b long, discordant long")
    got = {r["b"]: r["p"] for r in T.mcnemar_exact_p(df).collect()}
    exact = lambda x, y: min(1.0, 2 * sum(comb(x + y, k) for k in range(min(x, y) + 1)) / 2 ** (x + y))
    assert got["0"] == 1.0 and all(got[str(i)] == pytest.approx(exact(x, y)) for i, (x, y) in enumerate([(0, 0), (3, 9), (5, 5), (200, 260)]) if i)


def test_errors_are_raised(spark, tmp_path):
    df = spark.createDataFrame([("k", "nonsense", 1)], "a string, b string, c int")
    with pytest.raises(ValueError, match="missing columns: x"):
        K.require_columns(df, ["a", "x"])
    with pytest.raises(Exception, match="unknown grade label"):
        df.select(C.grade_label_to_number(F.col("b"))).collect()
    with pytest.raises(Exception, match="not Yes or No"):
        df.select(C.is_llm_to_binary(F.col("b"))).collect()
    with pytest.raises(ValueError, match="repeated"):
        J.assert_unique(df.union(df), ["a"])
    with pytest.raises(ValueError, match="not a parquet path"):
        io.scan_parquet(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError, match="empty split: test"):
        io.sink_split_export(spark.createDataFrame([("train",)], "split string"), str(tmp_path / "s"))


def test_model_outputs(spark):
    outputs = ['{"grade": 0.75}', '```json\n{"grade": 0.5}\n```', "I give 0.25 points.", "no", None, "1", '{"grade": "x"}']
    assert column(spark, outputs, C.grade_from_model_output, "string") == [0.75, 0.5, 0.25, -1.0, -1.0, 1.0, -1.0]


def text_of_document(document):
    """The text of an editor document by plain recursion."""
    def walk(node):
        if not isinstance(node, dict):
            return ""
        below = "".join(map(walk, node["content"])) if isinstance(node.get("content"), list) else ""
        return (node.get("text", "") if node.get("type") == "text" else "") + below + ("\n" if node.get("type") in ("paragraph", "listItem", "heading", "hardBreak") else "")
    return walk(json.loads(document)).strip() if document else ""


def test_rich_text(spark):
    doc = {"type": "doc", "content": [{"type": "heading", "content": [{"type": "text", "text": "A"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}, {"type": "hardBreak"}, {"type": "text", "text": " d\u2003"}]}]}
    deep = {"type": "text", "text": "x"}
    for _ in range(120):
        deep = {"type": "listItem", "content": [deep]}
    rng = random.Random(8)

    def grown(depth):
        kind = rng.choice(["text", "paragraph", "bulletList", "listItem", "hardBreak", None, 3])
        node = {"type": kind, "text": rng.choice(["é", "{[", "", "\n", "two words"])} if kind is not None else {}
        if depth and rng.random() < 0.8:
            node["content"] = rng.choice([[grown(depth - 1) for _ in range(rng.randrange(13))], {"type": "text", "text": "not in a list"}, None, "a"])
        return rng.choice([node, node, node, [node], 4]) if depth < 4 else node

    documents = [json.dumps(doc), None, "", json.dumps(deep), "null", "17", json.dumps([doc]), json.dumps({"type": "text"}), json.dumps({"type": "paragraph", "content": [doc] * 300}), *(json.dumps(grown(5)) for _ in range(40))]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, d string")
    assert [r["t"] for r in R.rich_text_column_job(df, "d", "t").orderBy("i").collect()] == [text_of_document(d) for d in documents]
    for broken in ("plain", '{"type": "text"', '{"type": "text", "text": 3}'):
        with pytest.raises(Exception):  # noqa: B017
            R.rich_text_column_job(spark.createDataFrame([(broken,)], "d string"), "d", "t").collect()
    plan = R.rich_text_column_job(df, "d", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rich_questions(spark):
    para = lambda t: {"type": "paragraph", "content": [{"type": "text", "text": t}]}
    examples = [{"content": para("e"), "accuracy": 1}, {"content": para("f"), "accuracy": 0.25}, {"accuracy": None}, {"content": para("g")}, {"content": 3, "accuracy": True}, {"content": para("h"), "accuracy": "half"}]
    df = spark.createDataFrame([(1, json.dumps({"content": para("q"), "rubric": {"type": "doc", "content": [para("r"), para("s")]}, "examples": examples})), (2, None), (3, ""), (4, "{}")], "i int, d string")
    got = [r[2:] for r in R.rich_question_column_job(df, "d").orderBy("i").collect()]
    lines = "\n---\n".join(["Ex 1 (Acc: 1): e", "Ex 2 (Acc: 0.25): f", "Ex 3 (Acc: None): ", "Ex 4 (Acc: N/A): g", "Ex 5 (Acc: True): ", "Ex 6 (Acc: half): h"])
    assert got == [("q", "r\ns", lines), ("", "", ""), ("", "", ""), ("", "", "")]
    for broken in ("[]", "3", '{"examples": [1]}', '{"examples": 1}', "{"):
        with pytest.raises(Exception):  # noqa: B017
            R.rich_question_column_job(spark.createDataFrame([(broken,)], "d string"), "d").collect()


def test_positions_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.5, 0.25, None, 1.0, rng.random()]), f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, v double, k string").repartition(7)
    got = [r["position"] for r in global_position(df, ["v", "k"], parts=9).orderBy(F.col("v"), "k").collect()]
    assert got == list(range(1, 3001))
    order = [F.desc_nulls_last("v")]
    ranks = {r["i"]: r["rank"] for r in global_position(df, order, "rank", ties=True, parts=9).collect()}
    values = [(-v if v is not None else 9) for _, v, _ in rows]
    assert ranks == {i: 1 + sum(x < y for x in values) for i, y in enumerate(values)}
    assert global_position(df.limit(0), ["v"]).count() == 0
    assert "SinglePartition" not in global_position(df, ["v", "k"], parts=9)._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    table = spark.range(20).withColumn("v", F.col("id") * 2)
    built = []

    def build(df=table):
        built.append(1)
        return df

    settings = {"seed": 1, "sizes": (5, 10)}
    get = lambda df=table, **more: snapshots.cached(spark, root, lambda: build(df), settings | more, {"t": df})
    assert get().count() == 20 and get().count() == 20 and len(built) == 1  # the second comes from the first
    assert get(seed=2).count() == 20 and len(built) == 2  # another setting
    changed = table.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))
    assert get(changed, seed=2).where("v = 0 AND id = 7").count() == 1 and len(built) == 3  # one row, same count
    assert get(changed.repartition(5), seed=2).count() == 20 and len(built) == 3  # order does not matter

    # A build that dies midway leaves the last snapshot in place.
    dying = spark.range(20).select("id", F.when(F.col("id") == 19, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="killed"):
        snapshots.publish(dying, root, "new")
    assert snapshots.read(spark, root).where("v = 0 AND id = 7").count() == 1
    (tmp_path / "cache" / "version-half").mkdir()
    assert get(changed, seed=2).count() == 20 and len(built) == 3
    # Files that vanish from the current snapshot make it stale, not wrong.
    folder = tmp_path / "cache" / snapshots.current(spark, root)["folder"]
    for f in list(folder.glob("part-*"))[:1]:
        f.unlink()
    assert get(changed, seed=2).count() == 20 and len(built) == 4
    snapshots.discard_old(spark, root)
    assert get(changed, seed=2).count() == 20 and len(built) == 4 and len([p for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")]) == 2
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, f"file://{tmp_path}/nothing")


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=5001), np.concatenate([np.full(3000, 2.5), rng.random(2000)]), np.array([1e308, -1e308, 0.0, 5e-324, 1.0] * 50), np.array([3.0]), rng.lognormal(0, 9, 4000)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        want = [df.agg(F.percentile("v", F.lit(q))).first()[0] for q in (0.0, 0.25, 0.5, 0.9, 1.0)]
        for bins, enough in ((4096, 100_000), (16, 40)):
            assert exact_quantiles(df, F.col("v"), (0.0, 0.25, 0.5, 0.9, 1.0), bins, enough) == pytest.approx(want, rel=1e-15)
    assert exact_quantiles(spark.createDataFrame([], "v double"), F.col("v"), (0.5,)) == [None]


def test_column_profile(spark, tmp_path):
    from marksheet.operators.tables import column_profile

    nan = float("nan")
    rows = [(1, 0.0, "a", "2024-10-27 00:30:00", [1, 2], b"\x00"), (1, -0.0, "", "2024-10-27 01:30:00", [1, None], b"\xff"), (None, nan, None, None, [None, 1], b"\xfe"),
            (3, nan, "a", "2024-10-27 01:30:00", None, None), (3, None, "null", "2024-10-27 00:30:00", [], b"\xff")]
    df = spark.createDataFrame(rows, "`a b` int, `x.y` double, s string, t string, l array<int>, z binary").withColumn("t", F.col("t").cast("timestamp"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:  # both times print as half past two in Berlin, where clocks go back between them
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = {r["column_name"]: r.asDict() for r in column_profile(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {c: (r["missing"], r["n_distinct"], r["n_rows"]) for c, r in got.items()} == {"a b": (1, 2, 5), "x.y": (1, 2, 5), "s": (1, 3, 5), "t": (1, 2, 5), "l": (1, 4, 5), "z": (1, 3, 5)}
    assert got["a b"]["unique_pct"] == 50 and got["l"]["type"] == "array<int>"
    empty = column_profile(df.limit(0)).collect()
    assert len(empty) == 6 and all((r["missing"], r["n_distinct"], r["unique_pct"], r["n_rows"]) == (0, 0, None, 0) for r in empty)
    df.write.parquet(str(tmp_path / "t"))
    plan = column_profile(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Relation") == 1


def test_exam_buckets_are_read_without_a_shuffle(spark, tmp_path):
    rows = [(f"t{i % 40}", 5 + i % 2, f"m{i}", float(i)) for i in range(800)]
    df = spark.createDataFrame(rows, "test_id string, test_size int, member_id string, total double")
    table = io.sink_exam_buckets(df, "exam_buckets_of_test", 4, f"file://{tmp_path}/exams")
    try:
        by_exam = table.groupBy("test_size", "test_id").agg(F.count("*").alias("n"), F.sum("total").alias("s"))
        assert "Exchange" not in by_exam._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, by_exam.collect())) == sorted(map(tuple, df.groupBy("test_size", "test_id").agg(F.count("*"), F.sum("total")).collect()))
    finally:
        spark.sql("DROP TABLE exam_buckets_of_test")


def test_sanity_checks_catch_rows_that_break_them(spark):
    names = "model_col test_id test_size member_id gold_total pred_total gold_norm pred_norm gold_linear_abs pred_linear_abs gold_bologna pred_bologna correct_linear_abs correct_bologna".split()
    kinds = "string string int string double double double double double double int int boolean boolean".split()
    right = lambda m, t, s: dict(zip(names, (m, t, 10, s, 8.0, 7.0, 0.8, 0.7, 5.0, 4.5, 3, 2, False, False), strict=True))
    good = [right(m, t, s) for m in ("a", "b") for t in ("t1", "t2") for s in ("s1", "s2")]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))

    def failed(rows, models=("a", "b"), size=10, **more):
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
        checks = T.sanity_checks(df, list(models), size, **more).collect()
        assert all(r["passed"] == (r["offending"] == 0) and r["details"] for r in checks) and len({r["name"] for r in checks}) == len(checks)
        return {r["name"] for r in checks if not r["passed"]}

    def broken(**change):
        return [good[0] | change, *good[1:]]

    ranking = T.model_ranking(spark.createDataFrame([tuple(r[n] for n in names) for r in good], schema))
    all_pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert failed(good, ranking=ranking, pairs=all_pairs, exams=2) == set()
    for name, rows in {
        "labels_not_null": broken(pred_bologna=None), "single_test_size": broken(test_size=5), "totals_in_range": broken(pred_total=11.0), "gold_norm_matches": broken(gold_norm=0.81), "pred_norm_matches": broken(pred_norm=0.71),
        "linear_in_range": broken(pred_linear_abs=6.5), "linear_on_step": broken(pred_linear_abs=4.4), "bologna_ordinals": broken(pred_bologna=6), "correct_linear_flag": broken(correct_linear_abs=True), "correct_bologna_flag": broken(correct_bologna=True),
        "fail_below_pass_mark": broken(pred_total=5.0, pred_norm=0.5), "rows_unique": [*good, good[0]], "gold_labels_agree": broken(gold_bologna=4), "same_exam_students": good[1:], "exam_students_counted": [r for r in good if (r["model_col"], r["test_id"]) != ("a", "t1")], "equal_row_counts": good[1:],
    }.items():
        assert name in failed(rows), name
    assert "expected_models" in failed(good, models=("a", "c")) and "test_size_exists" in failed(good, size=15) and "exam_count" in failed(good, exams=3)
    assert "selection_metrics_exist" in failed(good, selection=("el_acc_linear_abs", "el_new"))
    assert "ranking_recomputes" in failed(good, ranking=ranking.withColumn("el_acc_bologna", F.lit(0.5))) and "best_paired_with_all" in failed(good, pairs=all_pairs.limit(0))
    assert "labels_not_empty" in failed([])
    with pytest.raises(ValueError, match="rows_unique"):
        T.raise_on_critical(T.sanity_checks(spark.createDataFrame([tuple(r[n] for n in names) for r in [*good, good[0]]], schema), ["a", "b"], 10))


def test_tau_of_continuous_values_in_blocks(spark):
    """Ties, hot values and null keys, with as many blocks as rows allow."""
    rng = np.random.default_rng(1)
    groups = {
        "plain": (rng.normal(size=2000), rng.normal(size=2000)), "ties": (rng.integers(0, 30, 2000) / 4, rng.normal(size=2000).round(1)), "one": (np.array([1.0]), np.array([1.0])), "flat": (np.ones(50), rng.normal(size=50)),
        "hot": (np.where(rng.random(2000) < 0.4, 1.5, rng.normal(size=2000)), np.where(rng.random(2000) < 0.3, 0.0, rng.normal(size=2000))), None: (rng.normal(size=300), rng.integers(0, 3, 300) * 1.0),
    }

    def naive(y, p):
        sy, sp = np.sign(y[:, None] - y[None]), np.sign(p[:, None] - p[None])
        spread = math.sqrt(np.abs(sy).sum() * np.abs(sp).sum())
        return (sy * sp).sum() / spread if spread else None

    df = spark.createDataFrame([(g, float(a), float(b)) for g, (y, p) in groups.items() for a, b in zip(y, p, strict=True)], "g string, y double, p double")
    want = {g: naive(y, p) for g, (y, p) in groups.items()}
    for options in ({}, {"cells_a_block": 100, "most_blocks": 64}, {"cells_a_block": 7, "most_blocks": 16}):
        got = {r["g"]: r["tau_b"] for r in G.kendall_tau_b(df, ["g"], "y", "p", **options).collect()}
        assert got.keys() == want.keys() and all(got[g] == (None if w is None else pytest.approx(w, abs=1e-12)) for g, w in want.items())
    got = {r["g"]: r["tau_b"] for r in G.tau_b_of_cells(df, ["g"], "y", "p").collect()}
    assert all(got[g] == (None if w is None else pytest.approx(w, abs=1e-12)) for g, w in want.items())


def test_exact_numpy_sample(spark):
    from marksheet.operators.sampling import sample_exam_questions

    pool = spark.createDataFrame([(f"q{i}",) for i in range(12)], "question_id string")
    got = sample_exam_questions(pool, 3, (5, 10), 7, exact_numpy=True).collect()
    rng = np.random.default_rng(np.random.SeedSequence([7, 1, 5]))
    want = sorted(rng.choice(sorted(f"q{i}" for i in range(12)), size=5, replace=False).tolist())
    assert [r["question_id"] for r in got if r["test_id"] == "test_1" and r["test_size"] == 5] == want


def test_ridge_equals_closed_form(spark):
    from pyspark.ml.linalg import Vectors

    from marksheet.operators.baselines import tfidf_ridge_predict

    rng = np.random.default_rng(0)
    x, y = rng.random((60, 4)), rng.integers(0, 5, 60) / 4
    df = spark.createDataFrame([(i, "train" if i < 40 else "test", Vectors.dense(v), float(g)) for i, (v, g) in enumerate(zip(x, y, strict=True))], ["i", "split", "f", "grade"])
    a, b = x[:40] - x[:40].mean(0), y[:40] - y[:40].mean()
    w = np.linalg.solve(a.T @ a + np.eye(4), a.T @ b)
    raw = np.clip((x[40:] - x[:40].mean(0)) @ w + y[:40].mean(), 0, 1)
    got = [r["prediction"] for r in tfidf_ridge_predict(df, "f").where("split = 'test'").orderBy("i").collect()]
    assert got == list(np.ceil(raw * 4 - 0.5) / 4)
    # More features than rows, sparse.
    wide = np.where(rng.random((60, 5000)) < 0.01, rng.random((60, 5000)), 0.0)
    df = spark.createDataFrame([(i, "train" if i < 40 else "test", Vectors.sparse(5000, np.flatnonzero(v).tolist(), v[v > 0].tolist()), float(g)) for i, (v, g) in enumerate(zip(wide, y, strict=True))], ["i", "split", "f", "grade"])
    a = wide[:40] - wide[:40].mean(0)
    w = a.T @ np.linalg.solve(a @ a.T + np.eye(40), b)
    got = [r["raw"] for r in tfidf_ridge_predict(df, "f", raw="raw").where("split = 'test'").orderBy("i").collect()]
    assert got == pytest.approx(list((wide[40:] - wide[:40].mean(0)) @ w + y[:40].mean()), abs=1e-6)


def brute_tfidf(texts, train, tokens_of, min_df, size):
    """Weights of each text by plain Python."""
    from collections import Counter
    from math import log, sqrt

    counts = [Counter(tokens_of(t)) for t in texts]
    seen, total = Counter(), Counter()
    for c, is_train in zip(counts, train, strict=True):
        if is_train:
            seen.update(c.keys())
            total.update(c)
    kept = {t for t in seen if seen[t] >= min_df}
    assert len(kept) <= size  # no tie at the cut
    n, out = sum(train), []
    for c in counts:
        w = {t: (1 + log(k)) * (log((1 + n) / (1 + seen[t])) + 1) for t, k in c.items() if t in kept}
        norm = sqrt(sum(x * x for x in w.values())) or 1.0
        out.append(sorted(x / norm for x in w.values()))
    return out, len(kept)


def char_grams(text):
    for w in text.split():
        w = f" {w} "
        for n in (3, 4, 5):
            if len(w) < n:
                if n == 3:
                    yield w
                break
            yield from (w[i : i + n] for i in range(len(w) - n + 1))


def test_tfidf_by_brute_force(spark):
    """Vocabularies of more than 500 terms, words and characters, against plain Python."""
    import re

    from marksheet.operators import baselines as B

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(700)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(300)] + ["", "x", "ab ab ab"]
    train = [i % 3 > 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, "train" if t else "test", x, 0.5) for i, (x, t) in enumerate(zip(texts, train, strict=True))], "i int, split string, text string, grade double")

    def word_grams(text):
        one = re.findall(r"\b\w\w+\b", text.lower())
        return one + [f"{a} {b}" for a, b in zip(one, one[1:], strict=False)]

    for made, tokens in ((B.tfidf_word_features(df, "text"), word_grams), (B.tfidf_char_features(df, "text"), char_grams)):
        want, terms = brute_tfidf(texts, train, tokens, 2, 50_000)
        assert terms > 500
        for r in made.select("i", "features").collect():
            assert sorted(r["features"]["values"]) == pytest.approx(want[r["i"]]), texts[r["i"]]
            assert r["features"]["indices"] == sorted(set(r["features"]["indices"])) and all(0 <= i < terms == r["features"]["size"] for i in r["features"]["indices"])
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_tfidf_variants_by_brute_force(spark):
    """Each recipe's prediction is the snapped ridge estimate on its own features."""
    from marksheet.operators import baselines as B

    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        good = int(rng.integers(0, 5))
        rows.append((i, "train" if i < 60 else "test", f"question {i % 4} about rules", " ".join(["right"] * good + ["wrong"] * (4 - good) + rng.choice(["alpha", "beta", "gamma", "delta"], 3).tolist()), good / 4))
    df = spark.createDataFrame(rows, "i int, split string, question string, answer string, grade double")
    out = {r["i"]: r for r in B.tfidf_variants(df).collect()}
    for name in B.RECIPES:
        c = f"pred_tfidf_{name}"
        assert all(out[i][c] is None for i in range(60)) and all(out[i][c] in (0.0, 0.25, 0.5, 0.75, 1.0) for i in range(60, 90))
        assert np.mean([abs(out[i][c] - rows[i][4]) for i in range(60, 90)]) < 0.15, name
    one = B.tfidf_word_features(df, "answer", "f", 1, 2, 30_000)
    features = [r["f"] for r in one.orderBy("i").collect()]
    x = np.zeros((90, features[0]["size"]))
    for i, f in enumerate(features):
        x[i, f["indices"]] = f["values"]
    y = np.array([r[4] for r in rows])
    a = x[:60] - x[:60].mean(0)
    w = np.linalg.solve(a.T @ a + np.eye(x.shape[1]), a.T @ (y[:60] - y[:60].mean()))
    raw = np.clip((x[60:] - x[:60].mean(0)) @ w + y[:60].mean(), 0, 1)
    clear = [i for i in range(30) if abs((raw[i] * 4 - 0.5) % 1) > 1e-3]
    assert len(clear) > 25 and all(out[60 + i]["pred_tfidf_v1_answer_word_unigram"] == np.ceil(raw[i] * 4 - 0.5) / 4 for i in clear)


def exact_permutation_p(exams):
    """Both orders of every student, all of them: observed difference and the exact p."""
    def kappa(g, p):
        n = len(g)
        apart, spread = n * ((g - p) ** 2).sum(), n * (g * g).sum() + n * (p * p).sum() - 2 * g.sum() * p.sum()
        return (1.0 if apart == 0 else 0.0) if spread == 0 else 1 - apart / spread

    def d(swaps):
        at, total = 0, []
        for g, x, y in exams:
            s = np.array(swaps[at : at + len(g)])
            at += len(g)
            total.append(kappa(g, np.where(s, y, x)) - kappa(g, np.where(s, x, y)))
        return np.mean(total)

    n = sum(len(g) for g, _, _ in exams)
    seen = d([False] * n)
    return seen, np.mean([abs(d(s)) >= abs(seen) - 1e-12 for s in itertools.product((False, True), repeat=n)])


def test_swaps_of_large_cells_are_binomial(spark):
    """Quantile tables follow the binomial, and what a permutation draws for a cell is its sum of parts."""
    for size in T.TABLE_SIZES:
        least, cuts = T.quantile_table(size)
        chances = np.diff(np.array([0, *cuts, T._PRIME], float)) / T._PRIME
        k = least + np.arange(len(chances))
        assert (chances >= 0).all() and (chances * k).sum() == pytest.approx(size / 2, abs=1e-3) and (chances * (k - size / 2) ** 2).sum() == pytest.approx(size / 4, rel=1e-4)
        p = np.arange(0, T._PRIME, 5_000_011)
        assert T.drawn_swaps([{"size": size, "h": 1, "k": 0}], p).tolist() == [least + sum(c <= u for c in cuts) for u in p]
    # A cell is cut into all sizes, and its draws over many permutations have a binomial's mean and spread.
    rows = [("a", "b", "t", 10, n, 1, 1, 1, 2) for n in (45_711,)] + [("a", "b", f"t{n}", 10, n, 1, 1, 1, 2) for n in (1, 30, 31, 511, 512, 4608)] + [("a", "b", "same", 10, 9, 1, 1, 2, 2)]
    cells = T.swap_cells(spark.createDataFrame(rows, "a string, b string, test_id string, test_size int, n long, g_a int, g_b int, p_a int, p_b int"))
    p = rng_p = np.random.default_rng(2).integers(1, T._PRIME, 20_000)
    for r in T.with_draws(cells, 5).collect():
        bits = [d for d in r["draws"] if d["size"] == 1]
        n = 0 if r["test_id"] == "same" else r["n"]
        assert sum(d["size"] for d in r["draws"] if d["size"] > 1) + sum(d["mask"].bit_count() for d in bits) == n and len(bits) <= 18
        assert len({(d["h"], d["k"]) for d in r["draws"]}) == len(r["draws"])
        if n:
            got = T.drawn_swaps([d.asDict() for d in r["draws"]], rng_p)
            assert abs(got.mean() - n / 2) < 5 * np.sqrt(n / 4 / len(p)) and abs(got.var() / (n / 4) - 1) < 0.06 and 0 <= got.min() and got.max() <= n
    # One exam, two cells: the kappa difference moves with the swaps of a large cell as a normal draw would.
    rows = [("a", "b", "t", 10, 40_000 + 5_000 + 700, 1, 1, 1, 2), ("a", "b", "t", 10, 30_000, 2, 2, 2, 2), ("a", "b", "t", 10, 20_000, 3, 3, 2, 3)]
    cells = T.swap_cells(spark.createDataFrame(rows, "a string, b string, test_id string, test_size int, n long, g_a int, g_b int, p_a int, p_b int"))
    rng = np.random.default_rng(1)
    g, x, y, n = (np.array(c, float) for c in ((1, 2, 3), (1, 2, 2), (2, 2, 3), (45_700, 30_000, 20_000)))
    as_dicts = [dict(zip("gxyn", c, strict=True)) for c in zip(g, x, y, n, strict=True)]
    drawn = T.kappa_differences(as_dicts, np.column_stack([rng.binomial(45_700, 0.5, 4000), np.zeros(4000), rng.binomial(20_000, 0.5, 4000)]).astype(float))
    one = T.permutation_of_cells(cells, 2000, 1).first()
    seen = T.kappa_differences(as_dicts, np.zeros((1, 3)))[0]
    assert one["observed"] == pytest.approx(seen) and one["extreme"] == 0 and np.abs(drawn).max() < abs(seen)


def test_permutations_equal_exact_enumeration(spark):
    rng = np.random.default_rng(3)
    rows, exams = [], []
    for e, n in enumerate((5, 4, 3)):
        g, x = rng.integers(0, 6, n), rng.integers(0, 6, n)
        y = np.clip(g + rng.integers(-1, 2, n), 0, 5)
        exams.append((g.astype(float), x.astype(float), y.astype(float)))
        rows += [("a", "b", f"test_{e}", 10, 1, *map(int, (g[i], g[i], x[i], y[i]))) for i in range(n)]
    cells = T.swap_cells(spark.createDataFrame(rows, "a string, b string, test_id string, test_size int, n long, g_a int, g_b int, p_a int, p_b int"))
    seen, p = exact_permutation_p(exams)
    one = T.permutation_of_cells(cells, 4000, 1).first()
    assert one["observed"] == pytest.approx(seen) and one["n_permutations"] == 4000 and one["p"] == pytest.approx(p, abs=0.03)
    for r in T.permutations_in_blocks(cells.withColumn("scale", F.lit("s")), 4000, 1, 1500).collect():
        assert abs(r["observed"]) == pytest.approx(abs(seen)) and r["n_permutations"] == 4000 and r["p"] == pytest.approx(p, abs=0.03)
