"""Command line check: ``python tests/check.py [sf_dir] [name-part ...]``."""

import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession  # noqa: E402

from catalog import CATALOG  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in argv if not a.startswith("/")]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, entry in CATALOG.items():
        home = entry.run.__module__.rsplit(".", 1)[-1]
        if parts and not any(p in name or p == "@" + home for p in parts):
            continue
        start = time.time()
        try:
            rows, problems = compare(spark, con, entry, sf_dir)
        except Exception as error:  # report and go on
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:500]}"]
        bad += bool(problems)
        mark = "BAD " if problems else ("ok  " if entry.sql else "rows")
        print(f"{mark} {name:36s} {rows:7d} rows {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("    ", p, flush=True)
    print(f"{bad} bad")
    spark.stop()


main(sys.argv[1:])
