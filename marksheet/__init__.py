"""Exam analytics on Spark: table-in, table-out operators."""
