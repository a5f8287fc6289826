"""Reading and writing tables, with the checks that go with them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A whole table; a path without the .parquet suffix is an error, and so is a missing one."""
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError(f"not a parquet path: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_relational_tables(spark: SparkSession, source: str, allowed: Iterable[str], jdbc: dict | None = None) -> dict[str, DataFrame]:
    """The allowed tables of a folder of parquet tables, or of a database given JDBC options."""
    if jdbc:
        return {t: spark.read.format("jdbc").options(url=source, dbtable=t, **jdbc).load() for t in allowed}
    return {t: scan_parquet(spark, f"{source}/{t}.parquet") for t in allowed}


def sink_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write snappy parquet and return the table read back, so that a count checks what was written."""
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_partitioned_by_size(df: DataFrame, path: str) -> None:
    """One folder a size; exams are spread over the tasks, so few sizes do not mean few writers."""
    df.repartition("test_size", "test_id").write.partitionBy("test_size").parquet(path)


def scan_exam_partitions(spark: SparkSession, path: str, sizes: Sequence[int] | None = None) -> DataFrame:
    """Exam tables by size; only the folders of ``sizes`` are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("test_size").isin(*sizes)) if sizes else df


def sink_exam_buckets(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """A catalog table whose files hold whole exams, sorted: aggregates and joins by exam read it without a shuffle."""
    writer = df.repartition(buckets, "test_size", "test_id").write.bucketBy(buckets, "test_size", "test_id").sortBy("test_size", "test_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def sink_split_export(df: DataFrame, path: str) -> None:
    """train and test by the split column; an empty split is an error."""
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().where("split IN ('train', 'test')").collect()}
    missing = [s for s in ("train", "test") if not counts.get(s)]
    if missing:
        raise ValueError(f"empty split: {', '.join(missing)}")
    df.where("split IN ('train', 'test')").write.partitionBy("split").parquet(path)


def sink_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("sep", separator).option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses in ``spark.checkpoint.dir``, which all executors share.

    Only local masters without that setting (tests) get a folder of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/marksheet-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows stay as they are however often they are read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
