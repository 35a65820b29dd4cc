"""Helpers that the operators of this subpackage share: written intermediates, keys, distributed running sums."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Where folders are noted while a caller collects them; see collecting().
_noted: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for noted in _noted[-1:]:
        noted.append(path)
    return path


@contextlib.contextmanager
def collecting(noted: list[str]) -> Iterator[None]:
    """Note the folders that are made here, for a caller who knows when they can be removed."""
    _noted.append(noted)
    try:
        yield
    finally:
        _noted.pop()


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, and empty the list."""
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that save() made and that no later step reads."""
    remove(df.sparkSession, [file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]])


def row_keys(df: DataFrame, key: str) -> DataFrame:
    """Add a key for each row that is the same whenever the table is read: the file and the row's place in it.

    A table that isn't read from Parquet files is written first, as numbers of rows may change from one reading to the next.
    """
    try:
        return df.withColumn(key, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        return save(df.withColumn(key, F.monotonically_increasing_id().cast("string")), "rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """How many words a text has; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def n_buckets(rows: int, per_bucket: int = 400, most: int = 1 << 14) -> int:
    """A power of two, so that a bucket holds about per_bucket of so many rows."""
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, rows) / per_bucket))))


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, before: str, total: str) -> DataFrame:
    """Add the running sum of `value` before each row, in the order (bucket, order) of its group, and the group's total.

    Buckets are summed first (with map-side partial sums), the sums of a group's few buckets are accumulated,
    and rows are put in order within their bucket only, so no group, however large, is ordered by one task.
    """
    df = df.withColumn("_v", value)
    sums = df.groupBy(*group, bucket).agg(F.sum("_v").alias("_s"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_s").over(upto), F.lit(0).cast("long")).alias("_o"), F.sum("_s").over(whole).alias(total),
    )
    on = F.col(bucket) == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, on)
    return joined.withColumn(before, F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0).cast("long"))).drop("_v", "_o", "_b", *(f"_g{i}" for i in range(len(group))))
