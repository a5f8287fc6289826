"""Adapters: the domain tables as plain SELECTs over the driver tables.

Each adapter is one text for both engines; only the half-even rounding function and the row
generator differ. ``view(spark, sf_dir, name)`` gives the DataFrame, ``cte(*names)`` the same
tables as common table expressions for DuckDB.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

#: Simulated exams of each size and permutations of each comparison.
RUNS, PERMUTATIONS = 500, 10_000
SIZES, SEED = (5, 10, 15, 20, 21), 4242
MODELS = ("new_grade_a", "grade_bert_b", "grade_prior_c", "pred_tfidf_d")

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_CLIP = "least(greatest({}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


def _moved(step: str) -> str:
    return _CLIP.format(f"g + CAST({step} AS DOUBLE) * CAST(0.25 AS DOUBLE)")


#: name -> (SELECT, adapters or tables it reads). {rint} is the half-even rounding function.
ADAPTERS: dict[str, str] = {
    "raw_responses": """
        SELECT l_suppkey AS m, l_partkey % 24 AS q, CAST(CAST(sum(l_quantity) AS BIGINT) % 5 AS DOUBLE) / CAST(4 AS DOUBLE) AS g,
            CAST(sum({rint}(l_discount * 100)) AS BIGINT) AS d, CAST(sum({rint}(l_tax * 100)) AS BIGINT) AS x, CAST(sum(l_linenumber) AS BIGINT) AS n
        FROM lineitem GROUP BY l_suppkey, l_partkey % 24""",
    "responses": f"""
        SELECT concat('m', CAST(m AS STRING)) AS member_id, concat('q', CAST(q AS STRING)) AS question_id, concat('m', CAST(m AS STRING), '-q', CAST(q AS STRING)) AS answer_id,
            concat('g', CAST(m AS STRING), '-', CAST(q AS STRING)) AS grading_id, g AS grade, g AS human_grade, {_moved("d % 2")} AS human_expert_one_gold, {_moved("0 - x % 2")} AS human_expert_two,
            {_moved("d % 3 - 1")} AS new_grade_a, CASE WHEN d % 11 = 0 THEN NULL ELSE {_moved("n % 3 - 1")} END AS grade_bert_b, CAST(0.5 AS DOUBLE) AS grade_prior_c, {_moved("x % 5 - 2")} AS pred_tfidf_d,
            CASE q % 4 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'apply' ELSE 'analyse' END AS bloom_level, concat('topic ', CAST(q % 6 AS STRING)) AS question_topic,
            CASE WHEN q < 21 THEN 'gold' ELSE 'silver' END AS label_type, CASE WHEN q < 21 THEN 'test' ELSE 'train' END AS split,
            concat('Question number ', CAST(q AS STRING), CASE WHEN q % 2 = 0 THEN ' what is the rule' ELSE ' was ist die Regel' END) AS question,
            CASE WHEN d % 7 = 0 THEN '' ELSE concat('answer number ', CAST(n AS STRING), ' the rule of ', CAST(d AS STRING), repeat(' more words', CAST(x % 9 AS INT))) END AS answer,
            CASE WHEN x % 3 = 0 THEN 'Yes' WHEN x % 3 = 1 THEN 'No' ELSE NULL END AS gold_is_llm
        FROM raw_responses""",
    "responses_dirty": """
        SELECT CASE WHEN m % 13 = 1 THEN NULL WHEN m % 13 = 2 THEN '  ' ELSE concat(' ', CAST(m AS STRING), ' ') END AS member_id, CASE WHEN q % 11 = 3 THEN NULL ELSE CAST(q AS STRING) END AS question_id,
            CASE WHEN (m + q) % 17 = 5 THEN '' ELSE concat('m', CAST(m AS STRING), '-q', CAST(q AS STRING)) END AS answer_id, CASE WHEN d % 7 = 0 THEN '' ELSE concat('text ', CAST(n AS STRING)) END AS answer,
            CASE WHEN d % 13 = 4 THEN 'abc' WHEN d % 13 = 5 THEN '' WHEN d % 13 = 6 THEN NULL ELSE CAST(g AS STRING) END AS grade_text, g + CAST(d % 3 - 1 AS DOUBLE) AS wild_grade,
            CASE d % 6 WHEN 0 THEN ' Correct ' WHEN 1 THEN 'mostly correct' WHEN 2 THEN 'Partially Correct' WHEN 3 THEN 'mostly incorrect' WHEN 4 THEN 'INCORRECT' ELSE NULL END AS label,
            CASE x % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS flag, g, d, x, n, m, q
        FROM raw_responses""",
    "members": "SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, c_mktsegment AS subject_id FROM customer",
    "answers": "SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS shared_member_id, CAST(o_orderkey % 24 AS STRING) AS question_id, o_orderpriority AS content FROM orders",
    "gradings": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, CAST(l_orderkey AS STRING) AS answer_id, CAST(CAST(sum(l_quantity) AS BIGINT) % 5 AS DOUBLE) / CAST(4 AS DOUBLE) AS accuracy
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "feedback": """
        SELECT concat(CAST(event_id AS STRING), '-1') AS grading_id, max(event_type) AS comment, CAST(max(event_id % 5 + 1) AS BIGINT) AS rating FROM events GROUP BY event_id""",
    "question_meta": """
        SELECT CAST(p_partkey % 24 AS STRING) AS id, CASE CAST(max(p_size) % 4 AS INT) WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'apply' ELSE 'analyse' END AS bloom, min(p_brand) AS topic
        FROM part WHERE p_partkey % 24 < 20 GROUP BY p_partkey % 24""",
    "qa_text": """
        SELECT concat(CAST(u.conv_id AS STRING), '-', CAST(u.turn AS STRING)) AS id, min(u.text) AS question, min(a.text) AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant' GROUP BY u.conv_id, u.turn""",
    "answers_text": """
        SELECT d.doc_id, d.text AS answer, d.lang, CASE WHEN l.toxic = 1 THEN 'yes' WHEN l.toxic = 0 THEN 'No' ELSE NULL END AS gold_is_llm, CAST(l.quality AS DOUBLE) AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "feedback_ratings": """
        SELECT concat('model ', l_returnflag) AS model, CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS diag, CAST(1 + l_orderkey % 5 AS DOUBLE) AS ground, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(1 + l_partkey % 5 AS DOUBLE) END AS align,
            CAST(1 + l_suppkey % 5 AS DOUBLE) AS action, CAST(1 + l_linenumber % 5 AS DOUBLE) AS spec, CAST(1 + CAST({rint}(l_tax * 100) AS BIGINT) % 5 AS DOUBLE) AS tone
        FROM lineitem""",
    "activity": "SELECT event_id, ts, CAST(user_id AS STRING) AS member_id FROM events",
    "feedback_long": """
        SELECT r.answer_id, r.question_id, r.member_id, v.model_name, CASE WHEN length(r.answer) = 0 THEN NULL ELSE r.grade END AS model_grade, CASE WHEN length(r.answer) = 0 THEN NULL ELSE concat('feedback on ', r.answer_id) END AS model_feedback
        FROM responses r CROSS JOIN (SELECT 'alpha' AS model_name UNION ALL SELECT 'beta' UNION ALL SELECT 'gamma') v WHERE r.split = 'test'""",
    "model_outputs": """
        SELECT answer_id, CASE n % 5 WHEN 0 THEN concat('{"grade": ', CAST(grade AS STRING), ', "why": "x"}') WHEN 1 THEN concat('```json{"grade": ', CAST(grade AS STRING), '}```') WHEN 2 THEN concat('I would say ', CAST(grade AS STRING), ' points')
            WHEN 3 THEN 'no idea' ELSE NULL END AS model_response, grade FROM (SELECT answer_id, grade, CAST(length(answer) AS BIGINT) AS n FROM responses) t""",
}


def _needs(name: str) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", ADAPTERS[name]))
    return sorted(words)


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for other in _needs(name):
            if other in ADAPTERS:
                add(other)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str, rounded: str) -> str:
    return re.sub(r"\{rint\}\(([^()]*)\)", rounded, ADAPTERS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter as a DataFrame; Catalyst prunes what a query does not use."""
    steps = _ordered((name,))
    text = "WITH " + ", ".join(f"{s} AS ({_text(s, 'rint(' + chr(92) + '1)')})" for s in steps) + f" SELECT * FROM {name}"
    for t in sorted({t for s in steps for t in _needs(s) if t in _TABLES}):
        known_as = f"{t}_{zlib.crc32(sf_dir.encode())}"
        base(spark, sf_dir, t).createOrReplaceTempView(known_as)
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {known_as}", text)
    return spark.sql(text)


def cte(*names: str) -> str:
    """``name AS (...)`` for the adapters and what they read, for DuckDB."""
    return ", ".join(f"{s} AS ({_text(s, 'round_even(' + chr(92) + '1, 0)')})" for s in _ordered(names))
