"""The severity model's figures, recomputed by SQL from the written predictions."""

import duckdb
import pytest

from catalog.base import featured
from wayside.operators import severity_model as M
from wayside.sources.scratch import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def written(spark):
    made = M.evaluated(featured(spark, SF))
    path = scratch_path(spark, "predictions")
    made.coalesce(1).write.parquet(path)
    return made, f"'{path.removeprefix('file:')}/*.parquet'"


def rows(frame, *columns):
    return sorted(tuple(None if r[c] is None else round(r[c], 9) for c in columns) for r in frame.collect())


def test_learned_and_held_out_rows_are_apart(spark):
    source = featured(spark, SF)
    held = source.where(M.is_held_out(source)).select("ID").distinct()
    rest = source.where(~M.is_held_out(source)).select("ID").distinct()
    assert held.intersect(rest).isEmpty()
    assert 0.15 < held.count() / source.select("ID").distinct().count() < 0.25


def test_figures(written):
    made, files = written
    con = duckdb.connect()
    known = f"from read_parquet({files}) where is_validated"
    assert rows(M.confusion(made), "actual_severity", "predicted_severity", "rows") == sorted(con.execute(
        f"select actual_severity, predicted_severity, count(*) {known} group by 1, 2").fetchall())
    classes = con.execute(f"""
     with p as (select actual_severity a, predicted_severity b {known}),
     s as (select a as severity from p union select b from p)
     select severity, count(*) filter (where a = severity), count(*) filter (where b = severity),
      round(count(*) filter (where a = severity and b = severity) / nullif(count(*) filter (where a = severity), 0), 9),
      round(count(*) filter (where a = severity and b = severity) / nullif(count(*) filter (where b = severity), 0), 9)
     from s, p group by severity""").fetchall()
    found = rows(M.per_class(made), "severity", "rows", "predicted", "recall", "precision")
    assert found == sorted(classes) and sum(c[1] for c in classes) > 1_500
    bins = con.execute(f"""
     select least(floor(confidence_score * 10), 9)::int, count(*), round(avg(confidence_score), 9),
      round(avg((actual_severity = predicted_severity)::int), 9) {known} group by 1""").fetchall()
    assert rows(M.calibration(made), "bin", "rows", "mean_confidence", "accuracy") == sorted(bins)
    bad = con.execute(f"select count(*) from read_parquet({files}) where predicted_severity not between 1 and 4"
                      " or confidence_score not between 0.25 and 1").fetchone()[0]
    assert bad == 0


def test_it_beats_the_majority_where_there_is_something_to_learn(spark):
    learn = spark.range(4_000).selectExpr(
        "concat('x', id) as ID", "int(1 + id % 4) as Severity", "double(id % 4 * 10 + id % 3) as temperature_fahrenheit",
        "case when id % 4 > 1 then 'Rain' else 'Clear' end as weather_category")
    classes = M.per_class(M.evaluated(learn, trees=5)).collect()
    assert all(c.recall > 0.95 and c.precision > 0.95 for c in classes)
    assert sum(c.majority_recall for c in classes) == 1.0


def test_predictions_of_few_and_no_rows(spark):
    kind = "is_validated boolean, actual_severity int, predicted_severity int, confidence_score double"
    none = spark.createDataFrame([], kind)
    assert M.per_class(none).count() == M.calibration(none).count() == M.confusion(none).count() == 0
    some = spark.createDataFrame([(True, 2, 3, 1.0), (True, 3, 3, 0.5), (False, None, 1, 0.4)], kind)
    assert rows(M.per_class(some), "severity", "rows", "predicted", "recall", "precision", "majority_recall") == [
        (2, 1, 0, 0.0, None, 1.0), (3, 1, 2, 1.0, 0.5, 0.0)]
    assert rows(M.calibration(some), "bin", "rows", "accuracy", "gap") == [(5, 1, 1.0, -0.5), (9, 1, 0.0, 1.0)]


def test_training_reads_written_rows_instead_of_deriving_them_in_each_pass(spark, monkeypatch):
    learn = spark.range(400).selectExpr(
        "concat('x', id) as ID", "int(1 + id % 4) as Severity", "double(id % 40) as temperature_fahrenheit",
        "case when id % 4 > 1 then 'Rain' else 'Clear' end as weather_category")
    seen, fit = [], M.Stages.fit
    monkeypatch.setattr(M.Stages, "fit", lambda self, df: seen.append(
        (df._jdf.queryExecution().optimizedPlan().toString(), df.columns)) or fit(self, df))
    assert M.train_severity_model(learn, trees=2, depth=2).score(learn).count() == 400
    assert len(seen) == 1 and "Range" not in seen[0][0] and "ID" not in seen[0][1]
