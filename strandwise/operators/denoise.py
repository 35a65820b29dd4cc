"""Clean training samples by scorers that are trained on their halves."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import divided
from . import samples as P
from .tables import exists, new_folder, removed, written

#: Fits that run at the same time.
FITS = 4
LOG = "iteration int, all_pos long, all_neg long, kept_pos long, kept_neg long, ratio double, stop boolean"


def rounds(rows: DataFrame, scorer, n: int = 3, seed: int = 0) -> DataFrame:
    """idx and prob_1, n times a row: in each round, random halves score each other. Fits don't need each other, so FITS of them run at once."""
    pairs = []
    for r in range(n):
        half = P.chance(seed + r, "idx") < "8"
        a, b = rows.filter(half), rows.filter(~half)
        pairs += [(a, b), (b, a)]
    with ThreadPoolExecutor(FITS) as pool:
        fitted = list(pool.map(inheritable_thread_target(rows.sparkSession)(scorer.fit), [train for train, _ in pairs]))
    return reduce(DataFrame.unionByName, (f.transform(test).select("idx", "prob_1") for f, (_, test) in zip(fitted, pairs)))


def statistics(scores: DataFrame) -> DataFrame:
    """The mean and population deviation of each row's scores."""
    return scores.groupBy("idx").agg(F.avg("prob_1").alias("mean_prob"), F.stddev_pop("prob_1").alias("std_prob"))


def clean(rows: DataFrame, stats: DataFrame, score_cf: float = 0.5, negatives_too: bool = False) -> DataFrame:
    """Positive rows whose mean is score_cf at least and, if asked for, negative rows whose mean is below 1 - score_cf."""
    keep = (F.col("methy_label") == 1) & (F.col("mean_prob") >= score_cf)
    if negatives_too:
        keep = keep | ((F.col("methy_label") != 1) & (F.col("mean_prob") < 1 - score_cf))
    return rows.join(stats.select("idx", "mean_prob"), "idx").filter(keep).drop("mean_prob")


def kept_ratio(rows: DataFrame, kept: DataFrame, negatives_too: bool = False) -> DataFrame:
    """The share of rows that were kept: of positives, or the mean of both kinds' shares."""
    count = lambda d, n: d.agg(F.count_if(F.col("methy_label") == 1).alias(f"{n}_pos"), F.count_if(F.col("methy_label") != 1).alias(f"{n}_neg"))
    both = count(rows, "all").crossJoin(count(kept, "kept"))  # a row each
    pos, neg = divided(F.col("kept_pos"), F.col("all_pos")), divided(F.col("kept_neg"), F.col("all_neg"))
    return both.select("all_pos", "all_neg", "kept_pos", "kept_neg", ((pos + neg) / 2 if negatives_too else pos).alias("ratio"))


def denoise(
    rows: DataFrame, scorer, iterations: int = 10, n: int = 3, score_cf: float = 0.5, ratio: float = 0.99, negatives_too: bool = False, seed: int = 0, report: list | None = None, path: str | None = None
) -> DataFrame:
    """Repeat: score in rounds, keep what is likely right, balance negatives to the positives' k-mers; until few rows go.

    Only counts come to the driver. Each iteration writes the probabilities of its rows, the rows it leaves, and then an entry of its log
    under `path`: a call with the same path goes on after the last iteration that has an entry, and gives the rows of one call that was never
    stopped. `report`, a list, gets the log. An iteration reads rows and negatives several times, so what is given is made once and kept in a table.
    """
    spark = rows.sparkSession
    path = path or new_folder(spark, "denoise")
    log: list[dict] = []
    while exists(spark, f"{path}/{len(log):04d}/log/_SUCCESS"):
        log.append(spark.read.schema(LOG).parquet(f"{path}/{len(log):04d}/log").first().asDict())
    if len(log) >= iterations or log and log[-1]["stop"]:
        given = None
    else:
        given = rows = written(rows, "denoise-given")
        pool = given.filter(F.col("methy_label") != 1)
    if log:
        rows = spark.read.schema(rows.schema).parquet(f"{path}/{len(log) - 1:04d}/rows")
    for i in range(len(log), iterations):
        if log and log[-1]["stop"]:
            break
        at = f"{path}/{i:04d}"
        statistics(rounds(rows, scorer, n, seed + 100 * i)).write.mode("overwrite").parquet(f"{at}/probabilities")
        kept = written(clean(rows, probabilities(spark, path, i), score_cf, negatives_too), "denoise-kept")
        positive = kept.filter(F.col("methy_label") == 1)
        negative = kept.filter(F.col("methy_label") != 1) if negatives_too else pool
        share = kept_ratio(rows, kept, negatives_too).first()
        positive.unionByName(P.select_like(positive, negative, seed + i)).write.mode("overwrite").parquet(f"{at}/rows")
        entry = {"iteration": i, **share.asDict(), "stop": bool(share.kept_pos == 0 or share.ratio >= ratio)}
        spark.createDataFrame([entry], LOG).coalesce(1).write.mode("overwrite").parquet(f"{at}/log")
        rows = spark.read.schema(rows.schema).parquet(f"{at}/rows")
        removed(kept)
        log.append(entry)
    if given is not None:
        removed(given)
    if report is not None:
        report += log
    return rows


def probabilities(spark: SparkSession, path: str, iteration: int = 0) -> DataFrame:
    """idx, mean_prob and std_prob of the rows that an iteration scored."""
    return spark.read.parquet(f"{path}/{iteration:04d}/probabilities")
