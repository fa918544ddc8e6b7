"""Gate and side models of each fold, and the exchange of their probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.constants import FEATURES
from tickloom.functions import fits
from tickloom.session import reachable


@dataclass(frozen=True)
class Trees:
    """Boosted trees as the study sets them. Spark boosts on first derivatives and samples columns at each node, so the
    scores are like a second-order booster's, not equal to them."""

    rounds: int = 200
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: str = "0.8"
    least: int = 32
    seed: int = 42


def weighted(rows: DataFrame, label: str, balance: str) -> DataFrame:
    """rows with `_w`: positives weigh negatives / positives ("positive"), or both classes weigh n / (2 n_class)
    ("balanced")."""
    y = F.col(label)
    counts = rows.agg(F.sum(y.cast("double")).alias("_p"), F.count("*").cast("double").alias("_n"))
    held = rows.join(F.broadcast(counts))
    p, n = F.col("_p"), F.col("_n")
    if balance == "positive":
        w = F.when(y == 1, F.coalesce(F.try_divide(n - p, F.nullif(p, F.lit(0.0))), F.lit(1.0))).otherwise(1.0)
    else:
        w = F.when(y == 1, F.try_divide(n, 2 * F.nullif(p, F.lit(0.0)))).otherwise(F.try_divide(n, 2 * F.nullif(n - p, F.lit(0.0))))
    return held.withColumn("_w", F.coalesce(w, F.lit(1.0))).drop("_p", "_n")


def _vectors(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(rows)


def fit_trees(train: DataFrame, label: str, columns: tuple[str, ...] = FEATURES, trees: Trees = Trees()):
    """A scorer (rows, name) -> rows with the probability of the label."""
    model = GBTClassifier(
        featuresCol="_x", labelCol=label, weightCol="_w", maxIter=trees.rounds, maxDepth=trees.depth, stepSize=trees.rate, subsamplingRate=trees.rows, featureSubsetStrategy=trees.columns, minInstancesPerNode=trees.least, seed=trees.seed
    ).fit(_vectors(weighted(train, label, "positive"), columns))

    def score(rows: DataFrame, name: str) -> DataFrame:
        out = model.transform(_vectors(rows, columns))
        return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    return score


def fit_logistic(train: DataFrame, label: str, columns: tuple[str, ...] = FEATURES):
    """Standardised logistic regression with balanced classes and a unit ridge."""
    held = _vectors(weighted(train, label, "balanced"), columns)
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(held)
    scaled = scaler.transform(held)
    model = LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_w", maxIter=1000, regParam=1.0 / max(1, train.count()), standardization=False).fit(scaled)

    def score(rows: DataFrame, name: str) -> DataFrame:
        out = model.transform(scaler.transform(_vectors(rows, columns)))
        return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "_z", "rawPrediction", "probability", "prediction")

    return score


def affine_weights(model, scaler) -> tuple[list[float], float]:
    """A logistic model and its scaler as one linear form, for scoring in SQL."""
    w = [float(c) / float(s) if s else 0.0 for c, s in zip(model.coefficients, scaler.std)]
    return w, float(model.intercept) - sum(a * float(m) for a, m in zip(w, scaler.mean))


#: Side models by name: how they are fitted, and on what.
SIDE_MODELS = {"logistic_ofi": ("logistic", ("order_flow",)), "logistic_7": ("logistic", FEATURES), "trees": ("trees", FEATURES)}


def run_fold(windows: DataFrame, fold: str, trees: Trees = Trees(), side_models: tuple[str, ...] = tuple(SIDE_MODELS)) -> tuple[DataFrame, DataFrame]:
    """(train scores, test scores) of one fold's windows (part, features, touched, y): `gate_trained`, `gate_rv`, and
    on test p_up of each side model. The gate learns from every training window, the sides from touched ones only."""
    own = windows.filter(F.col("fold") == fold)
    train, test = own.filter("part = 'train'").withColumn("_t", F.col("touched").cast("double")), own.filter("part = 'test'")
    gate = fit_trees(train, "_t", trees=trees)
    sides = train.filter("touched").withColumn("_y", F.col("y").cast("double"))
    for name in side_models:
        kind, columns = SIDE_MODELS[name]
        fitted = fit_trees(sides, "_y", columns, trees) if kind == "trees" else fit_logistic(sides, "_y", columns)
        test = fitted(test, f"p_{name}")
    scored = [gate(rows, "gate_trained").withColumn("gate_rv", F.col("realized_variance")) for rows in (train.drop("_t"), test)]
    return scored[0], scored[1]


#: Windows of a fold, train and test, that one task fits and scores; a larger fold is fitted by pyspark.ml over all tasks.
ONE_TASK = 200_000


def run_folds(windows: DataFrame, n_folds: int, trees: Trees = Trees(), side_models: tuple[str, ...] = tuple(SIDE_MODELS)) -> DataFrame:
    """What run_fold gives, for all folds of windows at once, as (fold, part, start, bar_idx, gate_trained, gate_rv,
    p_<model>...): each fold, of ONE_TASK windows at most, is fitted inside one task. p_<model> is null on train."""
    reachable(windows.sparkSession)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "start"], kind="stable")
        train, touched = (own.part == "train").to_numpy(), own.touched.to_numpy(bool)
        if own[list(FEATURES)].isna().to_numpy().any() or not (train & touched).any():
            raise ValueError(f"fold {own.fold.iloc[0]!r} has undefined features or no touched training window")
        out = own[["fold", "part", "start", "bar_idx"]].assign(gate_trained=fits.boosted(own[list(FEATURES)].to_numpy(float), touched.astype(int), train, trees), gate_rv=own.realized_variance)
        for name in side_models:
            kind, columns = SIDE_MODELS[name]
            x, y, learn = own[list(columns)].to_numpy(float), own.y.to_numpy(), train & touched
            p = fits.boosted(x, y, learn, trees) if kind == "trees" else fits.logistic(x, y, learn)
            out[f"p_{name}"] = pd.Series(p, own.index).where(~train)
        return out

    slim = windows.select("fold", "part", "start", "bar_idx", "touched", "y", *FEATURES)
    fields = "fold string, part string, start long, bar_idx long, gate_trained double, gate_rv double" + "".join(f", p_{n} double" for n in side_models)
    return slim.repartition(n_folds, "fold").groupBy("fold").applyInPandas(run, fields)  # a number of tasks of its own, as adaptive execution would join such small ones


def join_probabilities(test: DataFrame, probabilities: DataFrame, name: str) -> DataFrame:
    """Test windows with an outside model's probabilities (fold, start, p_up) as p_<name>.

    They must match the windows one to one: missing, extra or repeated rows raise, naming the fold."""
    keys = ["fold", "start"]
    there = probabilities.groupBy(*keys).agg(F.count("*").alias("n"), F.first("p_up").alias("p_up"))
    both = test.select(*keys).withColumn("a", F.lit(1)).join(there, keys, "full")
    bad = both.filter("a is null or n is null or n > 1").select("fold").first()
    if bad:
        raise ValueError(f"probabilities of fold {bad['fold']!r} do not match its windows")
    return test.join(probabilities.select(*keys, F.col("p_up").alias(f"p_{name}")), keys)


def write_probabilities(test: DataFrame, column: str, path: str) -> None:
    test.select("fold", "start", F.col(column).alias("p_up")).write.partitionBy("fold").parquet(path)
