"""Quality of calls against what is known to be methylated or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.numbers import divided
from .samples import first_n

#: 0, 0.025 ... 0.675
THRESHOLDS = tuple(k * 25 / 1000 for k in range(28))


def labelled(methylated: DataFrame, unmethylated: DataFrame, per_class: int | None = None, seed: int = 0, key: str = "idx") -> DataFrame:
    """Calls of both kinds with `truth`; at most per_class random ones of each."""
    rows = methylated.withColumn("truth", F.lit(True)).unionByName(unmethylated.withColumn("truth", F.lit(False)))
    return rows if per_class is None else first_n(rows, "truth", per_class, seed, key)


def confusion(calls: DataFrame) -> DataFrame:
    """Counts and rates over calls with called_label and truth; a rate over nothing is 0."""
    yes, true = F.col("called_label") == 1, F.col("truth")
    c = calls.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"), F.count(F.lit(1)).alias("total_num"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "tp", "fp", "tn", "fn", divided(tp + tn, F.col("total_num")).alias("accuracy"), divided(tp, tp + fn).alias("recall"), divided(tn, tn + fp).alias("specificity"),
        divided(tp, tp + fp).alias("precision"), divided(fp, fp + tn).alias("fallout"), divided(fn, tp + fn).alias("miss_rate"), divided(fp, tp + fp).alias("fdr"), divided(tn, tn + fn).alias("npv"), "total_num",
    )


def batch_accuracy(calls: DataFrame, number: Column, batch: int = 512) -> DataFrame:
    """The mean of the accuracies of batches of `batch` rows, by the rows' numbers (from 0); the last may be smaller."""
    right = (F.col("called_label") == 1) == F.col("truth")
    each = calls.groupBy(F.floor(number / batch).alias("_b")).agg(F.avg(right.cast("double")).alias("accuracy"))
    return each.agg(F.count(F.lit(1)).alias("batches"), F.avg("accuracy").alias("mean_accuracy"))


def auroc(calls: DataFrame) -> DataFrame:
    """The area under the ROC curve by prob_1, 0 with one class only.

    Calls are counted by score first. Decimal scores of six digits are a million and one at most, so one window sums over them. Scores of any
    digits (0 to 1) fall into 65537 buckets: one window sums over buckets, the other within each.
    """
    by_score = calls.groupBy("prob_1").agg(F.count_if(F.col("truth")).alias("p"), F.count_if(~F.col("truth")).alias("q"))
    up_to = lambda w: F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = calls.schema["prob_1"].dataType
    if isinstance(kind, DecimalType) and kind.scale <= 6:
        below = up_to(Window.orderBy("prob_1"))
    else:
        by_score = by_score.withColumn("_b", F.floor(F.col("prob_1") * 65536))
        buckets = by_score.groupBy("_b").agg(F.sum("q").alias("q")).select(F.col("_b").alias("_c"), up_to(Window.orderBy("_b")).alias("_before"))
        by_score = by_score.join(buckets, F.col("_b").eqNullSafe(F.col("_c")))
        below = F.col("_before") + up_to(Window.partitionBy("_b").orderBy("prob_1"))
    area = by_score.withColumn("_a", F.col("p") * (below + F.col("q") / F.lit(2.0))).agg(F.sum("_a").alias("a"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return area.select(divided(F.col("a"), F.col("p") * F.col("q")).alias("auc"))


def threshold_sweep(calls: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """For each threshold: how many calls are far enough apart, how many of those are right, and their share.

    Calls are put into the 28 steps by arithmetic and counted once; thresholds then sum over the steps at or above them, so no call
    is repeated for each threshold.
    """
    steps = sorted(thresholds)
    gap = (F.col("prob_1") - F.col("prob_0")).cast("double")
    at = sum((F.when(F.abs(gap) >= t, 1).otherwise(0) for t in steps[1:]), F.when(F.abs(gap) >= steps[0], 1).otherwise(0))
    up = sum((F.when(gap >= t, 1).otherwise(0) for t in steps[1:]), F.when(gap >= steps[0], 1).otherwise(0))
    counts = calls.groupBy(at.alias("at"), up.alias("up"), F.col("truth")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("prob_cf"), F.lit(i + 1).alias("k")) for i, t in enumerate(steps))))
    spread = counts.withColumn("t", each)
    called = F.col("at") >= F.col("t.k")
    right = called & ((F.col("up") >= F.col("t.k")) == F.col("truth"))
    s = spread.groupBy(F.col("t.prob_cf").alias("prob_cf")).agg(F.sum("n").alias("total_num"), F.sum(F.when(called, F.col("n")).otherwise(0)).alias("called_num"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("correct"))
    return s.select("prob_cf", "total_num", "called_num", "correct", divided(F.col("called_num"), F.col("total_num")).alias("called_ratio"), divided(F.col("correct"), F.col("called_num")).alias("called_accuracy"))
