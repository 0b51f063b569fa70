"""Streaming ingestion and the streaming forms of deduplication and the hourly report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wayside.model import INCIDENT, Roles
from wayside.operators.cleaning import corrupt_row_filter
from wayside.operators.layout import partition_columns
from wayside.sinks.files import BRONZE_PARTITIONS, write_partitioned
from wayside.sources.csv import with_ingestion_metadata
from wayside.sources.scratch import materialise


def stream_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    format: str = "parquet",
    files_per_batch: int | None = None,
    **options,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_ingest(
    incidents: DataFrame,
    path: str,
    checkpoint: str,
    batch_id: str | None = None,
    roles: Roles = INCIDENT,
    once: bool = True,
) -> StreamingQuery:
    """Sound incidents with ingestion metadata as Parquet by date and state.  With ``once``
    everything available is processed and the query ends.

    Every micro-batch is placed by its partition values before it is written, so that a value gets
    few files, into a folder of its own (``ingest_batch``): a batch that is repeated after a failure
    replaces what it wrote."""
    sound = corrupt_row_filter(incidents, roles=roles)
    # partition by the event's own day, so take the date before the ingestion columns exist
    placed = with_ingestion_metadata(partition_columns(sound, roles), batch_id)

    def place(batch: DataFrame, number: int) -> None:
        write_partitioned(batch, f"{path}/ingest_batch={number}", BRONZE_PARTITIONS)

    return stream_upsert(placed, checkpoint, place, mode="append", once=once)


def stream_hourly_patterns(
    incidents: DataFrame, lateness: str = "1 hour", roles: Roles = INCIDENT
) -> DataFrame:
    """Incidents and mean severity per hour of the event time; rows later than ``lateness``
    may be dropped once their window is closed.  In append mode an hour comes once, when it is
    closed; in update mode each time it changed; in both its state is given up then."""
    timed = incidents.withColumn("_at", F.col(roles.start).cast("timestamp"))
    return (
        timed.withWatermark("_at", lateness)
        .groupBy(F.window("_at", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("accident_count"),
             F.avg(roles.severity).alias("avg_severity"))
        .select(F.col("w.start").alias("window_start"), "accident_count", "avg_severity")
    )


def stream_dedup(
    incidents: DataFrame, lateness: str = "1 day", roles: Roles = INCIDENT
) -> DataFrame:
    """First row per id among batches no further apart than ``lateness``."""
    timed = incidents.withColumn("_at", F.col(roles.start).cast("timestamp"))
    return timed.withWatermark("_at", lateness).dropDuplicatesWithinWatermark([roles.id]).drop(
        "_at"
    )


def stream_upsert(
    updates: DataFrame,
    checkpoint: str,
    replace: Callable[[DataFrame, int], None],
    mode: str = "update",
    once: bool = True,
) -> StreamingQuery:
    """Hand the changed rows of every micro-batch to ``replace`` (a JDBC or file sink), in complete
    mode all rows.  A batch may be handed over again after a failure, so ``replace`` should
    overwrite; ``ranged_upsert`` makes one that keeps a current table, ``keyed_replacement`` one that
    keeps every batch."""
    writer = (
        updates.writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def ranged_upsert(
    path: str, keys: Sequence[str], range_of: Column | None = None, ranges: int = 64
) -> Callable[[DataFrame, int], None]:
    """Keeps a current table: one row per key, in folders by ``key_range``, for ``current_rows``.

    A batch reads and rewrites only the ranges its keys fall into (dynamic partition overwrite).
    ``range_of`` says which range a key belongs to, such as the day of a window; without it keys are
    dealt over ``ranges`` by hash.  Every row carries the number of the batch that wrote it last
    (``batch_number``), so a batch that is handed over again replaces its own rows by the same rows,
    and never those of a later batch.

    The merged ranges are written beside the table before they replace what is there.  If the
    replacement breaks off, the repeated batch finds them complete and only puts them in place.
    Rows of a batch that share a key must be equal or one of them wins by its values."""
    key_range = F.pmod(F.xxhash64(*keys), F.lit(ranges)) if range_of is None else range_of

    def replace(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = f"{path}/_merged/batch={number}"
        fields = [f for f in batch.schema]
        columns = [f.name for f in fields]
        if not _exists(spark, f"{merged}/_SUCCESS"):
            new = materialise(batch.withColumns(
                {"batch_number": F.lit(number).cast("long"), "key_range": key_range.cast("string")}))
            touched = [r.key_range for r in new.select("key_range").distinct().collect()]
            if not touched:
                return
            both = new
            if _exists(spark, f"{path}/key_range=*"):
                known = spark.read.schema(new.schema).parquet(path)
                both = new.unionByName(known.where(F.col("key_range").isin(touched)))
            others = [c for c in columns if c not in keys]
            newest = F.max_by(F.struct("batch_number", *others), F.struct("batch_number", *others))
            rows = both.groupBy("key_range", *keys).agg(newest.alias("_row"))
            rows = rows.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in columns],
                               "_row.batch_number", "key_range")
            rows.write.mode("overwrite").parquet(merged)
        rows = spark.read.schema(_with_range(fields)).parquet(merged)
        (rows.repartition("key_range").write.mode("overwrite").partitionBy("key_range")
         .option("partitionOverwriteMode", "dynamic").parquet(path))
        _delete(spark, merged)

    return replace


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``ranged_upsert`` keeps: the last row of every key, without its range and
    batch.  A filter on ``key_range`` can be put on ``spark.read.parquet(path)`` instead."""
    return spark.read.parquet(path).drop("key_range", "batch_number")


def _with_range(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*fields, T.StructField("batch_number", T.LongType()),
                         T.StructField("key_range", T.StringType())])


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return len(files.globStatus(target) or ()) > 0


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def keyed_replacement(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the rows of every batch in a folder of its own, for ``latest_by_key``."""
    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/update={number}")

    return replace


def latest_by_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of every key the row that the last batch with it wrote."""
    found = spark.read.parquet(path)
    others = [c for c in found.columns if c not in (*keys, "update")]
    newest = F.max_by(F.struct(*others), F.col("update")).alias("_row")
    return found.groupBy(*keys).agg(newest).select(
        *keys, *[F.col("_row").getField(c).alias(c) for c in others])
