"""The options handed to Spark's JDBC source; no database is opened."""

import datetime as dt

import pytest

from wayside.sinks import jdbc as K
from wayside.sources import jdbc as J


class Recorder:
    """Stands for a reader or writer and for the frame it belongs to."""

    def __init__(self):
        self.seen, self.done = {}, None
        self.write = self.read = self

    def format(self, name):
        self.seen["format"] = name
        return self

    def mode(self, name):
        self.seen["mode"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **given):
        self.seen |= given
        return self

    def limit(self, n):
        self.seen["limit"] = n
        return self

    def load(self):
        self.done = "load"
        return self

    def save(self):
        self.done = "save"


def test_query_source():
    r = Recorder()
    J.jdbc_query_source(r, "jdbc:x", "select * from t where a = :a", {"a": 1}, user="u")
    assert r.seen == {"format": "jdbc", "url": "jdbc:x", "user": "u",
                      "query": "select * from t where a = 1"} and r.done == "load"


class Split(Recorder):
    """A database that answers the query for split points, and records the read by predicates."""

    def __init__(self, lows):
        super().__init__()
        self.lows = lows

    def collect(self):
        return [{"low": v} for v in self.lows]

    def jdbc(self, url, table, predicates, properties):
        self.seen |= {"table": table, "predicates": predicates, "properties": properties}
        return self


def test_query_source_reads_parts_in_parallel():
    r = Split([7, 1, None, 7, 3])
    J.jdbc_query_source(r, "jdbc:x", "select k from t where a = :a", {"a": "b"}, "k", 5, user="u")
    assert "NTILE(5) OVER (ORDER BY k)" in r.seen["query"] and "k IS NOT NULL" in r.seen["query"]
    assert r.seen["table"] == "(select k from t where a = 'b') q"
    assert r.seen["predicates"] == ["k < 3 OR k IS NULL", "k >= 3 AND k < 7", "k >= 7"]
    assert r.seen["properties"] == {"user": "u"}


@pytest.mark.parametrize("points", [[], [5], [1, 4, 9], ["a", "m'x"], [dt.date(2024, 1, 5)]])
def test_predicates_cover_every_value_once(spark, points):
    kind = {int: "int", str: "string", dt.date: "date"}[type(points[0])] if points else "int"
    values = {"int": list(range(-1, 12)), "string": ["", "a", "b", "m'x", "z"],
              "date": [dt.date(2024, 1, d) for d in range(3, 8)]}[kind]
    rows = spark.createDataFrame([(v,) for v in [*values, None, None]], f"k {kind}")
    # Spark reads the same literals and conditions as the database would
    tests = [t.replace("''", "\\'") for t in J.key_predicates("k", points)]
    assert len(tests) == len(points) + 1
    met = rows.selectExpr("k", "+".join(f"int(coalesce({t}, false))" for t in tests) + " as n")
    assert {r.n for r in met.collect()} == {1}


def test_table_source_reads_ranges_in_parallel():
    r = Recorder()
    J.jdbc_table_source(r, "jdbc:x", "t", "id", (0, 100), 8)
    assert (r.seen["partitionColumn"], r.seen["lowerBound"], r.seen["upperBound"],
            r.seen["numPartitions"]) == ("id", 0, 100, 8)


def test_describe_names_database_and_table():
    r = Recorder()
    J.jdbc_table_describe(r, "jdbc:x", "t'1", "d")
    assert "TABLE_SCHEMA = 'd'" in r.seen["query"] and "'t''1'" in r.seen["query"]


@pytest.mark.parametrize("choice, mode",
                         [("replace", "overwrite"), ("update", "append"), ("ignore", "append")])
def test_sink_modes(choice, mode):
    r = Recorder()
    K.jdbc_sink(r, "jdbc:x", "t", choice, connections=4)
    assert (r.seen["mode"], r.seen["batchsize"], r.seen["numPartitions"]) == (mode, 1000, 4)
    assert r.done == "save"


@pytest.mark.parametrize("url, statement", [
    ("jdbc:mysql://h/d", "INSERT INTO t (k, v) SELECT k, v FROM t_staging"
     " ON DUPLICATE KEY UPDATE v = VALUES(v)"),
    ("jdbc:postgresql://h/d", "INSERT INTO t (k, v) SELECT k, v FROM t_staging"
     " ON CONFLICT (k) DO UPDATE SET v = excluded.v"),
    ("jdbc:sqlserver://h", "MERGE INTO t t USING t_staging s ON (t.k = s.k) WHEN MATCHED THEN"
     " UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)"),
])
def test_upsert_stages_and_carries_over(monkeypatch, url, statement):
    r, run = Recorder(), []
    r.columns = ["k", "v"]
    monkeypatch.setattr(K, "dedup_by_key", lambda df, keys: df)
    K.jdbc_upsert(r, url, "t", ["k"], connections=3, execute=lambda to, texts: run.extend(texts))
    assert (r.seen["dbtable"], r.seen["mode"], r.seen["numPartitions"]) == ("t_staging", "overwrite", 3)
    assert r.done == "save" and run == [statement, "DROP TABLE t_staging"]


def test_upsert_of_keys_alone():
    assert K.upsert_statement("jdbc:sqlite:x", "t", "s", ["k"], ["k"]).endswith("DO NOTHING")
    assert "UPDATE" not in K.upsert_statement("jdbc:oracle:x", "t", "s", ["k"], ["k"])


def test_sink_with_keys_updates(monkeypatch):
    seen = {}
    monkeypatch.setattr(K, "jdbc_upsert", lambda df, url, table, keys, *rest, **o: seen.update(keys=keys))
    K.jdbc_sink(Recorder(), "jdbc:x", "t", "update", keys=["k"])
    assert seen == {"keys": ["k"]}


def test_sink_refuses_other_modes():
    with pytest.raises(ValueError):
        K.jdbc_sink(Recorder(), "jdbc:x", "t", "merge")


def test_create_table_writes_no_rows():
    r = Recorder()
    K.jdbc_create_table(r, "jdbc:x", "t", {"a": "DECIMAL(15,4)", "b": "VARCHAR(9)"}, "ENGINE=x")
    assert r.seen["limit"] == 0 and r.seen["mode"] == "errorifexists"
    assert r.seen["createTableColumnTypes"] == "a DECIMAL(15,4), b VARCHAR(9)"
    assert r.seen["createTableOptions"] == "ENGINE=x"


def test_export_replaces_one_table_per_frame():
    frames = {"kpi": Recorder(), "hotspots": Recorder()}
    K.export_gold(frames, "jdbc:x", prefix="gold_")
    assert [f.seen["dbtable"] for f in frames.values()] == ["gold_kpi", "gold_hotspots"]
    assert {f.seen["mode"] for f in frames.values()} == {"overwrite"}
