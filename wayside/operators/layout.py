"""Partitioning, sizing and caching of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from wayside.model import INCIDENT, Roles
from wayside.operators.joins import MEGABYTE, planned_bytes
from wayside.sources.scratch import materialise


@dataclass(frozen=True)
class LayoutRules:
    target_mb: int = 128
    bytes_per_row: int = 1000
    max_partitions_per_state: int = 50
    unknown_partitions: int = 200

    @property
    def rows_per_partition(self) -> float:
        return self.target_mb * MEGABYTE / self.bytes_per_row


RULES = LayoutRules()


def partition_columns(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Add ``partition_date`` with its year, month and day, and ``partition_state``.  The
    date is the one already there, else the ingestion date, the start, or today."""
    if "partition_date" not in df.columns:
        if "ingestion_date" in df.columns:
            date = F.col("ingestion_date")
        elif roles.start in df.columns:
            date = F.to_date(roles.start)
        else:
            date = F.current_date()
        df = df.withColumn("partition_date", date)
    unknown = F.lit("UNKNOWN")
    state = F.coalesce(F.col(roles.state), unknown) if roles.state in df.columns else unknown
    date = F.col("partition_date")
    return df.withColumns(
        {
            "partition_year": F.year(date),
            "partition_month": F.month(date),
            "partition_day": F.dayofmonth(date),
            "partition_state": state,
        }
    )


def rows_per_key(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def distribution_analysis(df: DataFrame) -> DataFrame:
    """Row counts per date, per state and in all, in long form ``(level, key, rows)``.  The
    table is counted once per (date, state); the levels are sums of those counts."""
    cells = df.groupBy("partition_date", "partition_state").agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(
        F.struct(F.lit("date").alias("level"), F.col("partition_date").cast("string").alias("key")),
        F.struct(F.lit("state").alias("level"), F.col("partition_state").alias("key")),
        F.struct(F.lit("all").alias("level"), F.lit("all").alias("key")),
    )
    return (
        cells.select("n", F.inline(levels))
        .groupBy("level", "key")
        .agg(F.sum("n").alias("rows"))
    )


def distribution_summary(df: DataFrame) -> DataFrame:
    """One row: rows, distinct dates and states, their averages, recommended layout."""
    level = F.col("level")
    counted = distribution_analysis(df).agg(
        F.coalesce(F.sum(F.when(level == "all", F.col("rows"))), F.lit(0)).alias("total_rows"),
        F.count_if(level == "date").alias("unique_dates"),
        F.count_if(level == "state").alias("unique_states"),
    )
    per = lambda n: F.coalesce(
        F.try_divide(F.col("total_rows").cast("double"), F.col(n).cast("double")), F.lit(0.0)
    )
    averaged = counted.withColumns(
        {"avg_rows_per_state": per("unique_states"), "avg_rows_per_date": per("unique_dates")}
    )
    dates, states = F.col("unique_dates"), F.col("unique_states")
    by_date, by_state = F.col("avg_rows_per_date"), F.col("avg_rows_per_state")
    return averaged.withColumn(
        "recommended_strategy",
        F.when((dates > 100) & (states > 20), "hierarchical")
        .when((by_date > by_state) & (dates > 10), "date_primary")
        .when((by_state > by_date) & (states > 5), "state_primary")
        .otherwise("simple"),
    )


def partitions_for_state(df: DataFrame, rules: LayoutRules = RULES) -> DataFrame:
    """One row: the number of partitions that gives ~128 MB each at 1000 bytes a row, at
    most 50 per state and at least one; 200 when nothing is known."""
    counted = rows_per_key(df, "partition_state").agg(
        F.sum("rows").alias("total"), F.count(F.lit(1)).alias("states")
    )
    wanted = F.greatest(
        F.lit(1).cast("bigint"), F.floor(F.col("total") / rules.rows_per_partition)
    )
    capped = F.least(wanted, F.col("states") * rules.max_partitions_per_state)
    return counted.select(
        F.when(F.col("states") == 0, rules.unknown_partitions)
        .otherwise(capped)
        .cast("int")
        .alias("optimal_partitions")
    )


def balanced(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Hash rows by the columns, so that equal values sit together, but never in one huge
    task: adaptive execution splits partitions above, and merges those below, its advisory
    size.  A plain ``repartition`` would put all rows of a frequent value into one task."""
    sizes = [] if partitions is None else [partitions]
    return df.hint("rebalance", *sizes, *[F.col(c) for c in columns])


def repartition_by_date(df: DataFrame) -> DataFrame:
    return balanced(df, "partition_year", "partition_month", "partition_day")


def repartition_by_state(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """By state.  ``partitions`` defaults to what ``partitions_for_state`` finds."""
    if partitions is None:
        partitions = partitions_for_state(df).first()[0]
    return balanced(df, "partition_state", partitions=partitions)


def repartition_hierarchical(df: DataFrame) -> DataFrame:
    return balanced(df, "partition_year", "partition_month", "partition_state")


def repartition_auto(df: DataFrame) -> DataFrame:
    """More than 30 dates and 10 states: hierarchical; else by the larger dimension."""
    seen = distribution_summary(df).select("unique_dates", "unique_states").first()
    if seen.unique_dates > 30 and seen.unique_states > 10:
        return repartition_hierarchical(df)
    if seen.unique_dates > seen.unique_states:
        return repartition_by_date(df)
    return repartition_by_state(df)


STRATEGIES = {
    "auto": repartition_auto, "date_only": repartition_by_date,
    "state_only": repartition_by_state, "hierarchical": repartition_hierarchical,
}


def apply_partitioning(df: DataFrame, strategy: str = "auto", roles: Roles = INCIDENT):
    """Prepare the partition columns and repartition by the named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](partition_columns(df, roles))


def with_place(ordered: DataFrame, place: str = "place") -> DataFrame:
    """Rows of a sorted table with their place from 1, without gathering them: the sort is range
    partitioned, its written order carries the place within a part, and one row per part is summed
    for the rest."""
    written = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    # monotonically_increasing_id holds the partition above bit 33, the position below
    part, position = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = written.join(F.broadcast(offsets), part == F.col("_part"))
    return placed.withColumn(place, F.col("_before") + position + 1).drop(
        "_at", "_part", "_before")


def estimate_size(df: DataFrame, fraction: float = 0.01) -> DataFrame:
    """One row: ``basis``, sampled rows, mean bytes of a row, rows, estimated MB.

    For rows of files that only a filter or a choice of columns stands between (``basis`` "files")
    the bytes are those of the files, each by the share of its rows that is kept: partition filters
    prune whole files, and Parquet counts its rows from the footers.  For any other frame ("rows")
    the JSON of a share of the rows is measured: those chosen by the hash of their values, and the
    first of every partition, so that no table of rows is without any; one scan either way."""
    spark = df.sparkSession
    files = _rows_by_file(df)
    schema = ("basis string, sampled_rows bigint, mean_row_bytes double, total_rows bigint,"
              " estimated_mb double")
    if files is not None:
        held = files.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("rows"), F.coalesce(
            F.sum(F.col("bytes") * F.col("kept") / F.col("rows")), F.lit(0.0)).alias("bytes")).first()
        mean = held.bytes / held.rows if held.rows else 0.0
        return spark.createDataFrame(
            [("files", held.rows, mean, held.rows, held.bytes / MEGABYTE)], schema)
    size = F.octet_length(F.to_json(F.struct("*")))
    key = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chosen = (F.pmod(key, F.lit(1_000_000)) < int(fraction * 1_000_000)) | (place == 0)
    seen = df.select(F.when(chosen, size).alias("bytes")).agg(
        F.count("bytes").alias("sampled"), F.avg("bytes").alias("mean"),
        F.count(F.lit(1)).alias("rows")).first()
    mean = seen.mean or 0.0
    return spark.createDataFrame(
        [("rows", seen.sampled, mean, seen.rows, mean * seen.rows / MEGABYTE)], schema)


def _rows_by_file(df: DataFrame) -> DataFrame | None:
    """``file``, ``bytes``, ``rows`` and how many of them the frame keeps, of every file it reads;
    None if rows cannot be traced to files."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    files = df.inputFiles() if node.nodeName().startswith("LogicalRelation") else []
    if not files or not all(f.endswith(".parquet") for f in files):
        return None
    kept = df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_size").alias("bytes"))
    kept = kept.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("kept"))
    # no column is read: the numbers of rows stand in the footers
    footers = df.sparkSession.read.parquet(*files).groupBy(
        F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return kept.join(footers, "file")


def estimated_mb(df: DataFrame) -> float:
    return estimate_size(df).first().estimated_mb


def estimate_partitions(df: DataFrame, strategy: str = "auto", rules: LayoutRules = RULES):
    """One row: expected partition count of a strategy, and the recommended one."""
    summary = distribution_summary(df)
    dates, states = F.col("unique_dates"), F.col("unique_states")
    if strategy == "date_only":
        expected = dates
    elif strategy == "state_only":
        expected = states
    elif strategy == "hierarchical":
        expected = F.least(dates * states, states * rules.max_partitions_per_state)
    else:
        expected = F.lit(max(1, int(estimated_mb(df) / rules.target_mb)))
    return summary.select(
        F.lit(strategy).alias("strategy"), expected.cast("bigint").alias("estimated_partitions"),
        "recommended_strategy",
    )


def partitions_by_size(size_mb: float, target_mb: int = RULES.target_mb) -> int:
    return max(1, int(size_mb / target_mb))


def right_size_partitions(df: DataFrame, size_mb: float | None = None, target_mb: int = 128):
    """Even partitions of about ``target_mb`` where the size is known, else of the session's
    advisory size.  Nothing runs beforehand, and the steps before keep their own parallelism:
    adaptive execution merges and splits while rows are on their way."""
    return repartition_to_size(df, (), target_mb, size_mb)


def repartition_to_size(
    df: DataFrame, columns: Sequence[str] = (), target_mb: int = 128, size_mb: float | None = None
) -> DataFrame:
    """As ``right_size_partitions``, with equal values of the columns side by side."""
    wanted = None if size_mb is None else partitions_by_size(size_mb, target_mb)
    return balanced(df, *[c for c in columns if c in df.columns], partitions=wanted)


def coalesce_small_files(df: DataFrame, target_mb: int = 128, size_mb: float | None = None):
    """For a write with fewer, larger files: the rows move once, instead of dragging the scan
    into few tasks as ``coalesce`` does."""
    return repartition_to_size(df, (), target_mb, size_mb)


def storage_for(size_mb: float) -> StorageLevel:
    """Memory below 100 MB, memory with disk above."""
    return StorageLevel.MEMORY_ONLY if size_mb < 100 else StorageLevel.MEMORY_AND_DISK


def cache_by_size(df: DataFrame, limit_mb: float | None = None) -> DataFrame:
    """Persist by planned size.  With ``limit_mb`` (1000 at ingestion) larger tables are left
    uncached."""
    size = planned_bytes(df) / MEGABYTE
    if limit_mb is not None and size >= limit_mb:
        return df
    return df.persist(storage_for(size))


def dataframe_metrics(df: DataFrame) -> DataFrame:
    """One row: records, columns and the number of non-empty partitions, in one scan."""
    per_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per_task.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.count(F.lit(1)).alias("partitions_with_rows"),
    )
