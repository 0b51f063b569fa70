"""A severity classifier over the feature columns: train, score, explain."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as Stages
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from wayside.model import INCIDENT, Roles, present_flags
from wayside.sources.scratch import discard, materialise

CATEGORIES = ("weather_category", "region", "urban_class", "control", "season")
NUMBERS = ("hour", "dow", "month", "temperature", "humidity", "visibility", "wind",
           "weather_score", "equipment_count", "safety_score")


@dataclass
class SeverityModel:
    fitted: PipelineModel
    inputs: list[str]
    version: str

    def score(self, df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
        """Per row: id, predicted severity, its probability, the actual one and whether it is known;
        place, weather, temperature, hour and first equipment that the prediction was made for; and
        of the model its type, version, inputs and their importance, with the time."""
        chances = vector_to_array("probability")
        flags = [f for f in present_flags(df.columns)]
        given = {
            "input_latitude": roles.lat, "input_longitude": roles.lng,
            "input_weather_condition": roles.weather, "input_temperature": roles.temperature,
            "input_hour": roles.hour,
        }
        inputs = [F.col(f"_{name}").alias(name) if c in df.columns else F.lit(None).alias(name)
                  for name, c in given.items()]
        equipment = reduce(
            lambda found, f: F.coalesce(found, F.when(F.col(f), f)), sorted(flags),
            F.lit(None).cast("string"))
        # numbers are filled for the forest, not for whoever reads the prediction
        kept = df.withColumns({f"_{name}": F.col(c) for name, c in given.items() if c in df.columns})
        return self.fitted.transform(_numbers_filled(kept, roles)).select(
            roles.id,
            F.col("prediction").cast("int").alias("predicted_severity"),
            F.array_max(chances).alias("confidence_score"),
            F.col(roles.severity).alias("actual_severity"),
            F.coalesce(F.col(roles.severity).between(1, 4), F.lit(False)).alias("is_validated"),
            *inputs,
            equipment.alias("input_infrastructure_type"),
            F.lit(type(self.fitted.stages[-1]).__name__).alias("model_type"),
            F.lit(self.version).alias("model_version"),
            F.lit(json.dumps(self.inputs)).alias("features_used"),
            F.lit(json.dumps(self.importance())).alias("feature_importance"),
            F.current_timestamp().alias("prediction_time"),
        )

    def importance(self) -> dict[str, float]:
        weights = self.fitted.stages[-1].featureImportances.toArray()
        return dict(zip(self.inputs, (float(w) for w in weights)))


def _numbers_filled(df: DataFrame, roles: Roles) -> DataFrame:
    numbers = [getattr(roles, n) for n in NUMBERS if getattr(roles, n) in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-999.0)) for c in numbers})


def train_severity_model(
    df: DataFrame,
    roles: Roles = INCIDENT,
    trees: int = 20,
    depth: int = 5,
    seed: int = 42,
    version: str = "1",
) -> SeverityModel:
    """A random forest on rows with severity 1 to 4.  Missing numbers get a value of their
    own, far outside the measures; unseen categories get an index of their own."""
    known = _numbers_filled(df.filter(F.col(roles.severity).between(1, 4)), roles)
    texts = [getattr(roles, c) for c in CATEGORIES if getattr(roles, c) in df.columns]
    numbers = [getattr(roles, n) for n in NUMBERS if getattr(roles, n) in df.columns]
    codes = [f"{c}_index" for c in texts]
    stages = Stages(
        stages=[
            StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=codes + numbers, outputCol="inputs"),
            RandomForestClassifier(featuresCol="inputs", labelCol="_label", numTrees=trees,
                                   maxDepth=depth, maxBins=64, seed=seed),
        ]
    )
    # written once, as narrow as the forest needs it: every pass of training would derive it again
    learned = materialise(known.select(
        *texts, *numbers, F.col(roles.severity).cast("double").alias("_label")).hint("rebalance"),
        "training-rows")
    fitted = stages.fit(learned)
    discard(learned)
    return SeverityModel(fitted, texts + numbers, version)


def is_held_out(df: DataFrame, roles: Roles = INCIDENT, folds: int = 5) -> Column:
    """True for rows that a model to be evaluated does not learn from: a hash of the id decides, so
    all rows of one id are on one side.  Rows without an id are held out."""
    digest = F.conv(F.substring(F.md5(F.col(roles.id).cast("string").cast("binary")), 1, 8), 16, 10)
    return F.coalesce(digest.cast("bigint") % folds == 0, F.lit(True))


def confusion(predictions: DataFrame) -> DataFrame:
    """``(actual_severity, predicted_severity, rows)`` of predictions whose severity is known."""
    return predictions.filter("is_validated").groupBy("actual_severity", "predicted_severity").agg(
        F.count(F.lit(1)).alias("rows"))


def per_class(predictions: DataFrame) -> DataFrame:
    """For every class that occurs or is predicted: its rows, how often it was predicted, recall and
    precision, and the recall of a model that always says the most frequent class (the lowest of
    equally frequent ones).  Everything follows from the confusion matrix, at most 25 rows."""
    cells = confusion(predictions)
    sides = cells.select("rows", F.inline(F.array(
        F.struct(F.col("actual_severity").alias("severity"), F.lit("actual").alias("side")),
        F.struct(F.col("predicted_severity").alias("severity"), F.lit("predicted").alias("side")))),
        (F.col("actual_severity") == F.col("predicted_severity")).alias("hit"))
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))
    actual = F.col("side") == "actual"
    classes = sides.groupBy("severity").agg(
        of(actual).alias("rows"), of(~actual).alias("predicted"), of(actual & F.col("hit")).alias("hits"))
    every = Window.partitionBy()  # the classes, five at most
    majority = F.max_by("severity", F.struct("rows", -F.col("severity"))).over(every)
    return classes.select(
        "severity", "rows", "predicted",
        F.try_divide(F.col("hits"), F.col("rows")).alias("recall"),
        F.try_divide(F.col("hits"), F.col("predicted")).alias("precision"),
        F.when(F.col("severity") == majority, 1.0).otherwise(0.0).alias("majority_recall"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of the confidence: rows, mean confidence, share of right predictions, and their gap.
    A calibrated model is right as often as it is confident."""
    number = F.least(F.floor(F.col("confidence_score") * bins), F.lit(bins - 1)).cast("int")
    right = F.col("predicted_severity") == F.col("actual_severity")
    grouped = predictions.filter("is_validated").groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence_score").alias("mean_confidence"),
        (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"))
    return grouped.withColumn("gap", F.col("mean_confidence") - F.col("accuracy"))


def evaluated(df: DataFrame, roles: Roles = INCIDENT, folds: int = 5, **training) -> DataFrame:
    """Predictions for the held-out rows by a model of the others, written once for the figures."""
    held = is_held_out(df, roles, folds)
    model = train_severity_model(df.filter(~held), roles, **training)
    return materialise(model.score(df.filter(held), roles), "held-out-predictions")
