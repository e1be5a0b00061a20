"""Training sets, classifiers by fold, out-of-sample inference and meta labels."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Columns that a model must never see: keys, targets, what is known only after the event, and weights.
EXCLUDED = {
    "ticker", "ts", "label", "y", "label_index", "fold", "split", "price", "pt", "sl", "vertical_ts", "exit_ts", "exit_price", "hit", "holding", "ret", "uniqueness", "weight", "n_draws", "pos", "o", "h", "l", "c", "v"
}


def feature_names(df: DataFrame) -> list[str]:
    from quantloom.operators.reshape import numeric_columns

    return [c for c in numeric_columns(df) if c.lower() not in EXCLUDED]


def training_set(labels: DataFrame, features: DataFrame, regimes: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Labels joined with the features of their bar, the regime of their date, and their weights."""
    out = labels.join(features, ["ticker", "ts"])
    if regimes is not None:
        out = out.join(regimes, "ts", "left")
    if weights is not None:
        out = out.join(weights, ["ticker", "ts"], "left")
    return out.where("label IS NOT NULL")


def classifier(name: str, seed: int = 42, weight: str | None = "w", trees: int | None = None, inputs: int = 0, classes: int = 3):
    common = {"featuresCol": "x", "labelCol": "y"} | ({"weightCol": weight} if weight else {})
    if name == "logistic":
        return LogisticRegression(family="multinomial", regParam=1e-3, maxIter=50, **common)
    if name == "forest":
        return RandomForestClassifier(numTrees=trees or 100, maxDepth=10, minInstancesPerNode=50, seed=seed, **common)
    if name == "meta_forest":
        return RandomForestClassifier(numTrees=trees or 100, maxDepth=5, seed=seed, **common)
    if name == "boosted":  # Spark's boosted trees are binary; one against the rest stands in for more classes
        return OneVsRest(classifier=GBTClassifier(maxIter=trees or 100, maxDepth=5, stepSize=0.1, seed=seed), parallelism=classes, **common)
    if name == "perceptron":  # takes no weights
        return MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[inputs, 16, 8, classes], maxIter=50, seed=seed)
    raise ValueError(f"unknown model {name}")


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Column ``w``: rows over (classes times rows of the class)."""
    per = df.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
    k = Window.partitionBy()
    per = per.withColumn("w", F.sum("__n").over(k) / (F.count(F.lit(1)).over(k) * F.col("__n"))).drop("__n")
    return df.join(F.broadcast(per), y)


def filled(train: DataFrame, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fills nulls with the means of the training rows, and with zero where a feature has no value in them."""
    means = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    return lambda df: df.withColumns({f"{c}__i": F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))) for c in features})


def train_and_infer(master: DataFrame, folds: DataFrame, features: list[str], name: str = "logistic", trees: int | None = None) -> DataFrame:
    """(label_index, fold, label, probs, pred): each fold's test labels under the model of its training labels.

    ``master`` has label_index, y, w and the features; draws of a bootstrap come as weights.
    """
    number = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]

    def predicted(k: int) -> DataFrame:
        ids = folds.where(F.col("fold") == k).select("label_index", "split")
        rows = master.join(ids, "label_index")
        stages = [VectorAssembler(inputCols=[f"{c}__i" for c in features], outputCol="x"), classifier(name, trees=trees, inputs=len(features))]
        train = rows.where("split = 'Train' AND w > 0")
        fill = filled(train, features)
        model = Pipeline(stages=stages).fit(fill(train))
        out = model.transform(fill(rows.where("split = 'Test'")))
        probs = vector_to_array("probability") if "probability" in out.columns else vector_to_array("rawPrediction")
        return out.select("label_index", F.lit(k).alias("fold"), "y", probs.alias("probs"), F.col("prediction").cast("int").alias("pred"))

    with ThreadPoolExecutor(max(1, min(5, len(number)))) as pool:  # folds are fitted side by side
        parts = list(pool.map(predicted, number))
    return reduce(DataFrame.unionByName, parts)


def meta_labels(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("meta_label", (F.col("pred") == F.col("y")).cast("int"))


def meta_infer(master: DataFrame, features: list[str], trees: int | None = None, cv: str = "loo") -> DataFrame:
    """Meta model by fold: trained on the other folds (or, with ``walkforward``, the earlier ones), 1 above one half."""
    parts = None
    number = [r["fold"] for r in master.select("fold").distinct().orderBy("fold").collect()]
    for k in number:
        train = master.where(F.col("fold") < k if cv == "walkforward" else F.col("fold") != k)
        if cv == "walkforward" and k == number[0]:
            continue
        stages = [VectorAssembler(inputCols=[f"{c}__i" for c in features], outputCol="x"), classifier("meta_forest", trees=trees)]
        fill = filled(train, features)
        model = Pipeline(stages=stages).fit(fill(balanced(train)))
        p = F.get(vector_to_array("probability"), F.lit(1))
        out = model.transform(fill(master.where(F.col("fold") == k))).select("label_index", "fold", "y", p.alias("p"))
        out = out.withColumn("pred", (F.col("p") > 0.5).cast("int"))
        parts = out if parts is None else parts.unionByName(out)
    return parts
