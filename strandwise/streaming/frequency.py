"""Site frequencies over calls that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.frequency import ATTRIBUTES, MEASURES, callable_, with_rmet

COLUMNS = [*MEASURES, "first"]


def read_calls(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Calls of the files that come into a folder, with `line`: the file, the split and the place in it, which order calls as their files do.

    Streams have no row numbers; a task counts the lines of each split as it reads them, and a split is read the same after a restart.
    """
    text = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    told = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            places = []
            for split in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                places.append(at.get(split, 0))
                at[split] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "at"])

    numbered = told.mapInArrow(count, "value string, file string, block long, at long")
    cells = F.from_csv("value", F.lit(schemas.CALLS), {"sep": "\t", "mode": "FAILFAST"})
    return numbered.select(cells.alias("c"), F.struct("file", "block", "at").alias("line")).select("c.*", "line")


def site_frequency(calls: DataFrame, order: tuple[str, ...] = ("line",), prob_cf: float = 0.5) -> DataFrame:
    """What operators.frequency.site_frequency gives, so far: the state has a row a site, with its sums and the attributes of its first call by `order`.

    The state is that of Spark's own aggregation: sums and a minimum are combined before the shuffle, and no Python runs for a call.
    """
    sums = callable_(calls, prob_cf).groupBy("chrom", "pos").agg(
        F.sum("prob_0").cast("double").alias("prob_0_sum"), F.sum("prob_1").cast("double").alias("prob_1_sum"),
        F.count_if(F.col("called_label") == 1).alias("met"), F.count_if(F.coalesce(F.col("called_label") != 1, F.lit(True))).alias("unmet"),
        F.count(F.lit(1)).alias("coverage"), F.min_by(F.struct(*ATTRIBUTES), F.struct(*order)).alias("first"),
    )
    return sums.select("chrom", "pos", *COLUMNS)


def run(calls: DataFrame, path: str, checkpoint: str, order: tuple[str, ...] = ("line",), prob_cf: float = 0.5, once: bool = False) -> StreamingQuery:
    """Keep changed sites up to date under `path`, a folder for each batch; the last batch of a site counts. `once` ends with what is there."""

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    writer = site_frequency(calls, order, prob_cf).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each site, with all columns of a frequency."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("chrom", "pos").agg(F.max_by(F.struct(*COLUMNS), "batch").alias("r")).select("chrom", "pos", "r.*")
    return with_rmet(newest.select("chrom", "pos", *MEASURES, "first.*"))
