"""Moving old rows of a partitioned table to an archive."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayside.operators.serving import retention_split

_STAGED = "_kept"


@dataclass
class Moved:
    """Folders moved whole, and folders of which rows were moved."""

    whole: list[str] = field(default_factory=list)
    split: list[str] = field(default_factory=list)


def move_old_rows(
    spark: SparkSession,
    path: str,
    archive: str,
    time: str,
    older_than: dt.date,
    partition: str,
    unit: str = "day",
    only_if: Column | None = None,
) -> Moved:
    """Move the rows of a Parquet table that are before a date, and fulfil the condition if there is
    one, to ``archive``, which has the same folders.

    The table is partitioned by ``partition``, the first day of the day, month or year (``unit``)
    that a row's ``time`` lies in.  So a folder's name bounds its rows: folders that begin on the
    date or later, and those without a date, are not touched; those that end before it are renamed,
    without being read, unless there is a condition; only the others are read and written anew.

    Rows are archived before they leave the table, in a folder named by the date, and what stays is
    written beside the table before it takes its place.  A run that broke off is repeated with the
    same date: it finishes what was begun and moves nothing twice.  A repeated run changes nothing.
    """
    files = _Files(spark)
    _put_in_place(files, path)
    moved = Moved()
    for name in files.folders(path, f"{partition}="):
        start = _date(name.split("=", 1)[1])
        if start is None or start >= older_than:
            continue
        if _after(start, unit) <= older_than and only_if is None:
            files.move(f"{path}/{name}", f"{archive}/{name}", "whole")
            moved.whole.append(name)
        else:
            rows = spark.read.parquet(f"{path}/{name}")
            kept, old = retention_split(rows, time, older_than, only_if)
            if old.isEmpty():
                continue
            old.write.mode("overwrite").parquet(f"{archive}/{name}/until={older_than}")
            kept.write.mode("overwrite").parquet(f"{path}/{_STAGED}/{name}")
            _put_in_place(files, path)
            moved.split.append(name)
    return moved


def archived_rows(spark: SparkSession, archive: str) -> DataFrame:
    """All rows moved so far, with the partition column."""
    return spark.read.option("basePath", archive).option("recursiveFileLookup", False).parquet(
        f"{archive}/*/*").drop("until")


def _put_in_place(files: _Files, path: str) -> None:
    """Let completely staged folders take the place of the table's; incomplete ones go."""
    for name in files.folders(f"{path}/{_STAGED}", ""):
        staged = f"{path}/{_STAGED}/{name}"
        if files.exists(f"{staged}/_SUCCESS"):
            files.delete(f"{path}/{name}")
            if files.has_rows(staged):
                files.rename(staged, f"{path}/{name}")
        files.delete(staged)
    files.delete(f"{path}/{_STAGED}")


def _date(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(unquote(text))
    except ValueError:
        return None


def _after(start: dt.date, unit: str) -> dt.date:
    """The first day that a folder does not hold."""
    if unit == "day":
        return start + dt.timedelta(days=1)
    months = {"month": 1, "year": 12}[unit] + start.month - 1
    return dt.date(start.year + months // 12, months % 12 + 1, 1)


class _Files:
    """The few file operations needed, over the file system of each path."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        target, system = self.at(path)
        return system.exists(target)

    def folders(self, path: str, prefix: str) -> list[str]:
        target, system = self.at(path)
        if not system.exists(target):
            return []
        found = (s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())
        return sorted(n for n in found if n.startswith(prefix))

    def has_rows(self, path: str) -> bool:
        target, system = self.at(path)
        return any(s.getPath().getName().endswith(".parquet") for s in system.listStatus(target))

    def delete(self, path: str) -> None:
        target, system = self.at(path)
        system.delete(target, True)

    def rename(self, source: str, target: str) -> None:
        (a, system), (b, _) = self.at(source), self.at(target)
        system.mkdirs(b.getParent())
        if not system.rename(a, b):
            raise OSError(f"could not move {source} to {target}")

    def move(self, source: str, folder: str, label: str) -> None:
        """Rename a folder to ``folder/until=label``; a number follows if there is one already."""
        number = 0
        while self.exists(target := f"{folder}/until={label}" + (f"-{number}" if number else "")):
            number += 1
        self.rename(source, target)
