"""Tables and queries over JDBC.  Needs the database's driver on the class path."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayside.functions.cases import all_of
from wayside.operators.cleaning import dedup_by_key
from wayside.sources.scratch import materialise

BATCH_ROWS = 1000
#: Distinct keys that one task compares, on average.
KEYS_PER_TASK = 1_000_000
_BACKSLASH_URLS = ("jdbc:mysql:", "jdbc:mariadb:")


def bind_parameters(
    query: str, params: Mapping[str, object] | None, backslash_escapes: bool = False
) -> str:
    """Replace ``:name`` by a quoted literal; JDBC sources take no parameters of their own.
    ``backslash_escapes`` for databases that read a backslash in a literal as an escape."""
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, float)):
            return repr(value)
        text = str(value).replace("\\", "\\\\") if backslash_escapes else str(value)
        return "'" + text.replace("'", "''") + "'"

    given = dict(params or {})
    # quoted texts are matched first, so a colon inside one is left alone
    return re.sub(
        r"'(?:[^']|'')*'|:([A-Za-z_]\w*)",
        lambda m: literal(given[m[1]]) if m[1] and m[1] in given else m[0],
        query,
    )


def jdbc_query_source(
    spark: SparkSession,
    url: str,
    query: str,
    params: Mapping[str, object] | None = None,
    split_on: str | None = None,
    splits: int = 1,
    **options,
) -> DataFrame:
    """The rows of a query.  With ``split_on``, a column of the query, they are read by several
    tasks: the database cuts the column's values into ``splits`` parts of about as many rows
    (``split_points``), and every part is a query of its own (``key_predicates``)."""
    bound = bind_parameters(query, params, url.startswith(_BACKSLASH_URLS))
    if split_on is None or splits < 2:
        return spark.read.format("jdbc").option("url", url).option("query", bound).options(
            **options).load()
    points = split_points(spark, url, bound, split_on, splits, **options)
    return spark.read.jdbc(
        url, f"({bound}) q", predicates=key_predicates(split_on, points, url),
        properties={k: str(v) for k, v in options.items()})


def split_points(
    spark: SparkSession, url: str, query: str, column: str, splits: int, **options
) -> list[object]:
    """The least value of every part but the first, ascending and distinct: at most ``splits`` - 1
    values, found by one query that the database runs."""
    tiles = (
        f"SELECT part, MIN({column}) AS low FROM (SELECT {column}, NTILE({int(splits)}) OVER"
        f" (ORDER BY {column}) AS part FROM ({query}) q WHERE {column} IS NOT NULL) t GROUP BY part"
    )
    rows = jdbc_query_source(spark, url, tiles, **options).collect()
    lows = sorted({row["low"] for row in rows if row["low"] is not None})
    return lows[1:]


def key_predicates(column: str, points: Sequence[object], url: str = "") -> list[str]:
    """Conditions of which every value fulfils exactly one, nulls too: below the first point, from
    each point to the next, from the last point on."""
    shown = [
        bind_parameters(":v", {"v": v}, url.startswith(_BACKSLASH_URLS)) for v in points
    ]
    if not shown:
        return ["1 = 1"]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(shown, shown[1:])]
    return [f"{column} < {shown[0]} OR {column} IS NULL", *between, f"{column} >= {shown[-1]}"]


def jdbc_table_source(
    spark: SparkSession,
    url: str,
    table: str,
    split_on: str | None = None,
    bounds: tuple[object, object] | None = None,
    splits: int = 1,
    **options,
) -> DataFrame:
    """A whole table; with ``split_on`` and its bounds it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_on is not None and bounds is not None:
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", splits)
        )
    return reader.options(**options).load()


def jdbc_table_describe(
    spark: SparkSession, url: str, table: str, database: str, **options
) -> DataFrame:
    """Columns of a remote table, from its INFORMATION_SCHEMA."""
    query = """SELECT COLUMN_NAME, DATA_TYPE, IS_NULLABLE, COLUMN_DEFAULT
               FROM INFORMATION_SCHEMA.COLUMNS
               WHERE TABLE_SCHEMA = :database AND TABLE_NAME = :table"""
    return jdbc_query_source(spark, url, query, {"database": database, "table": table}, **options)


def jdbc_table_size(
    spark: SparkSession, url: str, table: str, database: str, **options
) -> DataFrame:
    query = """SELECT TABLE_NAME, TABLE_ROWS, DATA_LENGTH, INDEX_LENGTH
               FROM INFORMATION_SCHEMA.TABLES
               WHERE TABLE_SCHEMA = :database AND TABLE_NAME = :table"""
    return jdbc_query_source(spark, url, query, {"database": database, "table": table}, **options)


def without_existing(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target does not have yet; repeated new keys are kept once.

    The target is read once, and only keys are compared, each once however many rows have it.
    Beyond ``KEYS_PER_TASK`` they are dealt over more tasks: adaptive execution would merge partitions
    by their compressed size, which for keys is a small part of what a task then sorts."""
    sides = [materialise(side.select(*keys).distinct(), "keys") for side in (df, existing)]
    parts = ceil(max(side.count() for side in sides) / KEYS_PER_TASK)  # from the files' footers
    if parts > 1:
        sides = [side.repartition(parts, *keys) for side in sides]
    lacking = materialise(sides[0].join(sides[1], list(keys), "left_anti").select(
        *[F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)]), "lacking-keys")
    same = all_of([F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(keys)])
    fresh = materialise(df.join(lacking, same, "left_semi"), "fresh-rows")
    return dedup_by_key(fresh, keys)
