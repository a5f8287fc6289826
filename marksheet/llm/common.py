"""Shared helpers: the cluster's shared folder, saved intermediate tables, fitting a table to a schema."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The whitespace that separates words in every contract of this subpackage.
SPACES = "\x20\x09-\x0d"
WORD = f"[^{SPACES}]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (tests) a folder of our own is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove ``saved`` tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken) -> str:
    """``name``, with underscores added while a column of that name (in any case) is there already."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ascii_lower(text):
    """Lower-case A-Z only. Pure-ASCII texts take the fast built-in; others are translated."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def slices(batch: pa.RecordBatch, text: int | str, rows: int = 500, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and ``most_bytes`` of text; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
        to = max(at + 1, min(fits, at + rows))
        yield batch.slice(at, to - at)
        at = to
