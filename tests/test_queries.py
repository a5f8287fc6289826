"""Every registered query on the smallest tables, against its SQL or values worked out in Python."""

import json
import math

import duckdb
import pandas as pd
import pytest

from marksheet.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if pd.isna(v):
        return ""
    if isinstance(v, (bool,)) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        f = float(v) if not isinstance(v, str) else None
    except (TypeError, ValueError):
        f = None
    return f"{f + 0.0:.9g}" if f is not None and math.isfinite(f) else str(v)


def check_env_reuse(mine, con):
    assert mine[["before", "same", "changed", "row_changed"]].values.tolist() == [[False, True, False, False]]


def check_permutations(mine, con):
    assert len(mine) == 8 and set(mine["scale"]) == {"linear_abs", "bologna"} and (mine["a"] != mine["b"]).all()
    assert ((mine["p"] - (mine["extreme"] + 1) / (mine["n_permutations"] + 1)).abs() < 1e-9).all()
    assert (mine[mine["observed"].abs() < 1e-12]["p"] == 1).all()
    # The same pair by other random numbers.
    one = QUERIES["permutation_test_qwk"](pytest.spark, SF).toPandas().iloc[0]
    twin = mine[(mine["scale"] == "linear_abs") & (mine["a"] == "new_grade_a") & (mine["b"] == "pred_tfidf_d")]
    if len(twin):
        assert twin.iloc[0]["observed"] == pytest.approx(one["observed"]) and twin.iloc[0]["p"] == pytest.approx(one["p"], abs=0.1)


def check_weights(mine, con):
    assert len(mine) == con.sql("SELECT count(DISTINCT (l_suppkey, l_partkey % 24)) FROM lineitem").fetchall()[0][0]
    assert all(r.n_terms == 0 and r.squared_length == 0 or abs(r.squared_length - 1) < 1e-6 and 0 < r.largest <= 1 for r in mine.itertuples())
    assert mine["n_terms"].max() > 3


def check_predictions(mine, con):
    columns = [c for c in mine.columns if c not in ("answer_id", "split")]
    assert mine["answer_id"].is_unique and columns
    for c in columns:
        assert mine[mine["split"] == "train"][c].isna().all() and set(mine[mine["split"] == "test"][c]) <= {0.0, 0.25, 0.5, 0.75, 1.0}


#: Queries that SQL cannot express. Their operators are held against brute force in test_micro.py.
VALUES = {
    "env_reuse_check": check_env_reuse, "permutation_all_pairs": check_permutations,
    "tfidf_word_features": check_weights, "tfidf_char_features": check_weights, "tfidf_ridge_predict": check_predictions, "tfidf_variants": check_predictions,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name in VALUES:
        pytest.spark = spark
        VALUES[name](mine, con)
        return
    theirs = con.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(mine) == rows(theirs)


def test_every_query_has_sql_or_values():
    assert set(QUERIES) - set(ORACLES) == set(VALUES)
