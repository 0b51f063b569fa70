"""What the operators of this package share: hold-out rule, batches of texts, written tables."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that a Python task holds as objects at a time (a longer text is held alone).
SLICE_BYTES = 8 << 20


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True for rows that no model learns from: crc32 of the id as text, modulo ``folds``, is 0.
    A null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(True))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if the folder exists
    there too; elsewhere the package is installed or sent with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that ``spark.checkpoint.dir`` names: cuts the
    lineage and survives lost executors.  Only a local session may leave the setting unset."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(
    df: DataFrame, label: str, key: str, buckets: int, sort: Sequence[str] = ()
) -> DataFrame:
    """As ``written``, in buckets of ``key``, each sorted by the columns ``sort``: grouping and
    joining by the key need no shuffle.  The catalogue forgets the table; its files stay."""
    spark = df.sparkSession
    name = f"llm_{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name.replace('_', '-')}"
    writer = df.write.bucketBy(buckets, key)
    (writer.sortBy(*sort) if sort else writer).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"drop table {name}")
    return table


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, where written tables go; a local session without
    the setting gets one below its warehouse folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if context.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def drop_written(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that no later step reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/llm-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: it gives memory back in its own way
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and serves the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after whose last batch freed memory goes back."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def zipped(text: str | Column) -> Column:
    """The text's bytes by zstd, for a text that is to be shuffled; null stays null."""
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        codec = pa.Codec("zstd")
        return values.map(lambda v: None if v is None else len(v).to_bytes(8, "little") + codec.compress(v, asbytes=True))

    column = F.col(text) if isinstance(text, str) else text
    return pack(column.cast("binary"))


def unzip(value: bytes | None) -> bytes | None:
    """What ``zipped`` packed."""
    return None if value is None else pa.Codec("zstd").decompress(
        value[8:], int.from_bytes(value[:8], "little"), asbytes=True)


def unzipped(value: str) -> Column:
    """The texts of a column that ``zipped`` made."""
    @F.pandas_udf("binary")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(unzip)

    return unpack(value).cast("string")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes together; at least one row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list], Sequence[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """The columns ``keep`` and new columns that Python computes from whole texts.

    ``make`` runs once per task and gives a function from a list of texts (None for null) to one
    Arrow array per field; it gets texts of about ``limit`` bytes at a time.  A kept column of a
    new column's name gives way to the new one.
    """
    new = {f.name for f in fields}
    kept = [c for c in keep if c not in new]
    position = len(kept)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text_"))
    schema = T.StructType([*source.schema.fields[:position], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = batch.column(position)
            for start, stop in slices(texts, limit):
                part = texts.slice(start, stop - start).to_pylist()
                old = [batch.column(i).slice(start, stop - start) for i in range(position)]
                yield pa.RecordBatch.from_arrays([*old, *compute(part)], names=names)

    return source.mapInArrow(giving_back(run), schema)
