"""Writing tables to a database over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from wayside.operators.cleaning import dedup_by_key
from wayside.sources.jdbc import BATCH_ROWS, jdbc_table_source, without_existing

MODES = {"replace": "overwrite", "update": "append", "ignore": "append"}


def jdbc_sink(
    df: DataFrame,
    url: str,
    table: str,
    on_duplicate: str = "ignore",
    keys: Sequence[str] = (),
    batch_rows: int = BATCH_ROWS,
    connections: int | None = None,
    split_on: str | None = None,
    bounds: tuple[object, object] | None = None,
    splits: int = 1,
    **options,
) -> None:
    """``replace`` swaps the table, ``update`` and ``ignore`` append.  With ``keys``, ``ignore``
    leaves out rows whose key the target already has; ``split_on``, ``bounds`` and ``splits`` let
    several tasks read the target for that; ``update`` gives rows whose key the target has their new
    values (``jdbc_upsert``).  ``connections`` limits how many tasks write at once."""
    if on_duplicate not in MODES:
        raise ValueError(f"on_duplicate is one of {sorted(MODES)}")
    if keys and on_duplicate == "update":
        return jdbc_upsert(df, url, table, keys, batch_rows, connections, **options)
    if keys and on_duplicate == "ignore":
        target = jdbc_table_source(
            df.sparkSession, url, table, split_on, bounds, splits, **options)
        df = without_existing(df, target, keys)
    writer = df.write.format("jdbc").mode(MODES[on_duplicate]).options(**options)
    writer = writer.option("url", url).option("dbtable", table).option("batchsize", batch_rows)
    if connections:
        writer = writer.option("numPartitions", connections)
    writer.save()


def jdbc_upsert(
    df: DataFrame,
    url: str,
    table: str,
    keys: Sequence[str],
    batch_rows: int = BATCH_ROWS,
    connections: int | None = None,
    execute: Callable[[str, Sequence[str]], None] | None = None,
    **options,
) -> None:
    """Insert rows, and update those whose key the target has.

    All tasks write into a staging table, which one statement of the database then carries over;
    so a reader of the target sees all rows or none.  The staging table is replaced at the start
    and dropped at the end: a run that broke off can be repeated, and a repeated run changes
    nothing.  Of rows that share a key one is written.  The target needs a unique index on ``keys``
    (but for dialects with MERGE).  ``execute`` runs statements in one transaction; the default
    opens a connection of the driver that Spark has loaded for the URL."""
    staging = f"{table}_staging"
    rows = dedup_by_key(df, list(keys))
    writer = rows.write.format("jdbc").mode("overwrite").options(**options)
    writer = writer.option("url", url).option("dbtable", staging).option("batchsize", batch_rows)
    if connections:
        writer = writer.option("numPartitions", connections)
    writer.save()
    run = execute or (lambda to, statements: _execute(df.sparkSession, to, statements, options))
    run(url, [upsert_statement(url, table, staging, df.columns, keys), f"DROP TABLE {staging}"])


def upsert_statement(
    url: str, table: str, staging: str, columns: Sequence[str], keys: Sequence[str]
) -> str:
    """The statement that carries ``staging`` over into ``table``, in the dialect of the URL."""
    values = [c for c in columns if c not in keys]
    listed, key = ", ".join(columns), ", ".join(keys)
    take = f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging}"
    if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")):
        changed = ", ".join(f"{c} = VALUES({c})" for c in values or keys[:1])
        return f"{take} ON DUPLICATE KEY UPDATE {changed}"
    if url.startswith(("jdbc:postgresql:", "jdbc:sqlite:")):
        # without a condition SQLite takes ON for that of a join
        source = f"{take} WHERE true" if url.startswith("jdbc:sqlite:") else take
        changed = ", ".join(f"{c} = excluded.{c}" for c in values)
        return f"{source} ON CONFLICT ({key}) DO " + (f"UPDATE SET {changed}" if values else "NOTHING")
    same = " AND ".join(f"t.{c} = s.{c}" for c in keys)
    changed = ", ".join(f"t.{c} = s.{c}" for c in values)
    update = f" WHEN MATCHED THEN UPDATE SET {changed}" if values else ""
    new = ", ".join(f"s.{c}" for c in columns)
    return (f"MERGE INTO {table} t USING {staging} s ON ({same}){update}"
            f" WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({new})")


def _execute(
    spark: SparkSession, url: str, statements: Sequence[str], options: Mapping[str, object]
) -> None:
    """Run statements in one transaction over a connection of the driver's JVM."""
    java = spark.sparkContext._jvm.java
    properties = java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, str(value))
    connection = java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            statement = connection.createStatement()
            statement.executeUpdate(text)
            statement.close()
        connection.commit()
    finally:
        connection.close()


def jdbc_create_table(
    empty: DataFrame,
    url: str,
    table: str,
    column_types: Mapping[str, str] | None = None,
    table_options: str = "",
    **options,
) -> None:
    """Create a table from a frame's schema, with chosen column types and table options."""
    writer = empty.limit(0).write.format("jdbc").mode("errorifexists").options(**options)
    if column_types:
        text = ", ".join(f"{c} {t}" for c, t in column_types.items())
        writer = writer.option("createTableColumnTypes", text)
    if table_options:
        writer = writer.option("createTableOptions", table_options)
    writer.option("url", url).option("dbtable", table).save()


def export_gold(gold: Mapping[str, DataFrame], url: str, prefix: str = "", **options) -> None:
    """Replace one database table per gold frame."""
    for name, frame in gold.items():
        jdbc_sink(frame, url, f"{prefix}{name}", on_duplicate="replace", **options)
