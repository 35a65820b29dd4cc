"""Training with validation: epochs of Spark's logistic regression or any scorer, best one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import divided


def quality(scored: DataFrame, label: str = "methy_label") -> DataFrame:
    """Accuracy, precision and recall of rows with prob_1."""
    yes, true = F.col("prob_1") > 0.5, F.col(label) == 1
    c = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"))
    return c.select("n", divided(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"), divided(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), divided(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def weighted(rows: DataFrame, pos_weight: float = 1.0, label: str = "methy_label") -> DataFrame:
    """Add the weight of each row's class."""
    return rows.withColumn("weight", F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0))


def train(rows: DataFrame, valid: DataFrame, scorers, pos_weight: float = 1.0, tolerance: float = 0.0002, patience: int = 1):
    """Fit scorers in turn (each a setting), and return the one best on `valid` and its accuracy; stop when they no longer improve."""
    rows, best, top, worse = weighted(rows, pos_weight), None, -1.0, 0
    for scorer in scorers:
        fitted = scorer.fit(rows, "weight")
        accuracy = quality(fitted.transform(valid)).first().accuracy
        worse = 0 if accuracy > top - tolerance else worse + 1
        if accuracy > top:
            best, top = fitted, accuracy
        if worse > patience:
            break
    return best, top
