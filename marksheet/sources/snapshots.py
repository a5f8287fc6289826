"""Committed snapshots: a derived table with what it was made of, replaced in one step.

A build writes to a folder of its own. Only when that is complete a manifest with the folder's name,
the fingerprint of settings and inputs, and the number of rows appears under the next number, by a
rename. Readers follow the newest manifest and nothing else, so a build that dies leaves files that
nobody reads, and a reader never sees half a table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_PREFIX = "manifest-"


def table_state(df: DataFrame) -> dict:
    """Rows and a sum of row hashes: any changed, added or lost row changes it, order does not."""
    rows = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)").alias("_h"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("_h")).first()
    return {"rows": n, "hash": str(total), "columns": [list(t) for t in df.dtypes]}


def fingerprint(settings: Mapping, inputs: Mapping[str, DataFrame] | None = None) -> str:
    """One value for the settings and the state of every input."""
    state = {name: table_state(df) for name, df in sorted((inputs or {}).items())}
    return hashlib.sha256(json.dumps([dict(settings), state], sort_keys=True, default=str).encode()).hexdigest()


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[len(_PREFIX) :]) for n in names if n.startswith(_PREFIX) and n[len(_PREFIX) :].isdigit())


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest, or None where nothing was ever finished."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    lines = spark.read.text(f"{root}/{_PREFIX}{numbers[-1]:09}").collect()
    return json.loads("".join(r[0] for r in lines))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table of the newest manifest."""
    manifest = current(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no finished snapshot under {root}")
    return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{root}/{manifest['folder']}")


def publish(df: DataFrame, root: str, mark: str) -> DataFrame:
    """Write ``df`` as the next snapshot of ``root`` and make it the current one."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{root}/{folder}").count()
    text = json.dumps({"folder": folder, "fingerprint": mark, "rows": rows, "schema": df.schema.jsonValue()})
    fs, path = _fs(spark, root)
    waiting = jvm.Path(path, f"_{folder}.json")
    out = fs.create(waiting, False)
    out.write(bytearray(text.encode()))
    out.close()
    while True:
        number = (_numbers(spark, root) or [0])[-1] + 1
        target = jvm.Path(path, f"{_PREFIX}{number:09}")
        # A number that another writer took meanwhile is not replaced; the next one is tried.
        if not fs.exists(target) and fs.rename(waiting, target):
            return read(spark, root)


def is_fresh(spark: SparkSession, root: str, mark: str) -> bool:
    """Whether the current snapshot was built from these settings and inputs and still has its rows."""
    manifest = current(spark, root)
    return manifest is not None and manifest["fingerprint"] == mark and read(spark, root).count() == manifest["rows"]


def cached(spark: SparkSession, root: str, build: Callable[[], DataFrame], settings: Mapping, inputs: Mapping[str, DataFrame] | None = None, force: bool = False) -> DataFrame:
    """The current snapshot, built anew when forced, absent, or made from other settings or inputs."""
    mark = fingerprint(settings, inputs)
    if not force and is_fresh(spark, root, mark):
        return read(spark, root)
    return publish(build(), root, mark)


def discard_old(spark: SparkSession, root: str) -> None:
    """Remove all but the current snapshot, once nobody reads the others."""
    manifest, numbers = current(spark, root), _numbers(spark, root)
    if manifest is None:
        return
    fs, path = _fs(spark, root)
    keep = {manifest["folder"], f"{_PREFIX}{numbers[-1]:09}"}
    for f in fs.listStatus(path):
        if f.getPath().getName() not in keep:
            fs.delete(f.getPath(), True)
