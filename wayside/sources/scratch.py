"""Written intermediate tables in the folder every executor can reach.

Multi-pass operators (order-dependent cleaning, shared report bases) would recompute
their whole lineage in each pass.  ``materialise`` cuts it with a Parquet table: unlike a
cache it survives lost executors, and unlike an RDD checkpoint later passes still prune
columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.  A local session may leave it unset
    and gets one below its warehouse; on a cluster that is an error, at every size."""
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    if context.master.startswith("local[") or context.master == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/wayside-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_alone(
    spark: SparkSession, make: Callable[[], DataFrame], label: str = "stage"
) -> DataFrame:
    """``materialise`` what ``make`` gives, and delete what making it wrote besides."""
    application = spark.sparkContext.applicationId
    earlier = _made.pop(application, [])
    try:
        made = materialise(make(), label)
        own = _made[application].pop()
        release_scratch(spark)
        earlier.append(own)
    finally:
        _made[application] = earlier + _made.get(application, [])
    return made


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for a frame that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in [p for p in made if any(f.endswith(p.rsplit("/", 1)[1]) for f in folders)]:
        made.remove(path)
        _delete(spark, path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes what was written inside, for steps whose results no longer read it."""
    application = spark.sparkContext.applicationId
    earlier = _made.pop(application, [])
    try:
        yield
    finally:
        release_scratch(spark)
        _made[application] = earlier


def release_scratch(spark: SparkSession) -> int:
    """Delete what this application wrote through ``scratch_path``; returns the number."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
