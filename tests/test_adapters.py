"""The adapters read whole tables: no row of the driver tables is left out by a filter on ids."""

import duckdb

from marksheet import fixtures as X

SF = "/root/testdata/sf0.001"


def test_responses_read_all_of_lineitem(spark):
    want = duckdb.sql(f"SELECT count(DISTINCT (l_suppkey, l_partkey % 24)), sum(l_linenumber) FROM '{SF}/lineitem.parquet'").fetchall()[0]
    got = X.view(spark, SF, "raw_responses").selectExpr("count(*)", "sum(n)").first()
    assert tuple(got) == want


def test_feedback_reads_all_events_and_some_gradings_have_none(spark):
    feedback, gradings = X.view(spark, SF, "feedback"), X.view(spark, SF, "gradings")
    assert feedback.count() == duckdb.sql(f"SELECT count(DISTINCT event_id) FROM '{SF}/events.parquet'").fetchall()[0][0]
    of = gradings.join(feedback, gradings["id"] == feedback["grading_id"], "left")
    assert 0 < of.where("grading_id IS NULL").count() < of.count()
