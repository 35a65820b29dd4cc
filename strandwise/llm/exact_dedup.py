"""Exact deduplication with the disk-backed keyed state of Structured Streaming."""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_folder, save

STATE = "digest string, n_bytes long, stays struct<doc_id:long,locator:string>, n_rows long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
KEY = ["digest", "n_bytes"]


@contextlib.contextmanager
def _settings(spark, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_state(rows: DataFrame) -> DataFrame:
    """The streaming plan: state keyed by digest and length, which never expires.

    `rows` (a stream) has digest, n_bytes, doc_id and locator; the state of a key is the largest doc_id (the stable
    identifier of the row that stays; null is the smallest), the locator of that row's content, and the number of rows.
    Rows are combined before the shuffle, so a digest that a third of all rows share costs one row a task.
    """
    return rows.groupBy(*KEY).agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("n_rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder (nothing, if it isn't there)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def _hand_over(spark: SparkSession, rows: DataFrame, state_dir: str, call: str) -> None:
    """Write a call's rows, in a folder for each slot; they count once the folder has its name among the others."""
    with _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "64"}):  # a task has a file open for each slot, and sorts nothing
        rows.write.mode("overwrite").partitionBy("slot").option("compression", "zstd").parquet(f"{state_dir}/incoming/{call}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(state_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{state_dir}/rows"))
    if not files.rename(path(f"{state_dir}/incoming/{call}"), path(f"{state_dir}/rows/{call}")):
        raise OSError(f"can't move the rows of call {call} to {state_dir}/rows")


def run_state(spark: SparkSession, state_dir: str, call: str, schema: StructType, batches: int) -> None:
    """Feed what is new in {state_dir}/rows through digest_state, and note that the call is done.

    New files come in `batches` micro-batches, each of which meets the state that the ones before it, of this call or an earlier
    one, left in the store. A micro-batch writes the states it changed into a folder of its own, over what a failed attempt
    left there; after a failure, the stream goes on with the micro-batch that failed.
    """

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/states/{call}/batch={k}")

    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{state_dir}/rows/{call}")
    each = max(1, math.ceil(len(rows.inputFiles()) / batches))
    with _settings(spark, STORE):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", each).parquet(f"{state_dir}/rows")
        digest_state(source).writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/done/{call}")


def states_of(spark: SparkSession, state_dir: str, call: str) -> DataFrame:
    """The state of each key that a call's rows have, as it was after that call."""
    if not _exists(spark, f"{state_dir}/states/{call}"):
        return spark.createDataFrame([], STATE)
    states = spark.read.schema(f"{STATE}, batch long").parquet(f"{state_dir}/states/{call}")
    return states.groupBy(*KEY).agg(F.max_by(F.struct("stays", "n_rows"), "batch").alias("s")).select(*KEY, "s.*")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] | None = None, state_dir: str | None = None, batches: int = 4, keep: Sequence[str] = (), call: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns that `keep` names as keep_<name>.

    Equal texts form a group, of which the row with the largest doc_id stays. Rows are written to the state's folder with a locator
    each, dealt to `batches` slots. Digests go through the streaming state in as many micro-batches (`digest` is SHA-256 of the whole UTF-8 text
    unless given). On each hit, the whole text is compared with the content at the locator that the state holds;
    where a digest turns out to stand for different texts, its rows form groups by the text itself.

    With a `state_dir` that earlier calls used, their rows count, too: groups reach over all calls, and the rows of this call are returned. Of
    earlier rows, only the slots are read in which a hit's locator lies; states are those of this call's keys. Calls come one after another.

    After a failure, the same call made again goes on where the other stopped, and gives what it would have given: a call is known by `call`,
    or else by a digest of its rows, which are handed over once. A finished call made again gives its rows again and counts nothing twice; equal tables that are
    to count each need a `call` of their own. Rows of a call that failed after they were handed over, and is never made again, count.

    Edge cases: a null text counts as empty; a null doc_id is smaller than any other; of several rows with the largest
    doc_id the one with the largest locator stays; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    of, lasting = digest or (lambda c: F.sha2(c, 256)), state_dir is not None
    state_dir = state_dir or new_folder(spark, "dedup")
    extra = [F.col(c).alias(f"keep_{c}") for c in keep if c != "text"]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNull().alias("lacks"), F.coalesce(F.col("text"), F.lit("")).alias("content"), *extra)
    read = read.withColumn("text_sha256", F.sha2("content", 256)).withColumn("digest", of(F.col("content"))).withColumn("n_bytes", F.octet_length("content").cast("long"))
    if call is None and lasting:
        mark = F.xxhash64("doc_id", "lacks", "text_sha256").cast("decimal(20,0)")
        call = hashlib.sha256(repr(read.agg(F.count(F.lit(1)), F.sum(mark), F.min(mark), F.max(mark)).first()).encode()).hexdigest()
    call = call or uuid.uuid4().hex
    place = F.monotonically_increasing_id()
    rows = read.withColumn("slot", F.pmod(place, F.lit(batches)).cast("int")).withColumn("locator", F.concat_ws("#", F.lit(call), "slot", place))
    schema = rows.drop("slot").schema
    done = set(_names(spark, f"{state_dir}/done"))
    for left in _names(spark, f"{state_dir}/rows"):
        if left not in done and left != call:
            run_state(spark, state_dir, left, schema, batches)
    if not _exists(spark, f"{state_dir}/rows/{call}"):
        _hand_over(spark, rows, state_dir, call)
    if call not in done:
        run_state(spark, state_dir, call, schema, batches)
    told = lambda names, slots=None: _rows(spark, state_dir, names, schema, slots)
    mine = told([call])
    states = save(states_of(spark, state_dir, call), "dedup-states")

    hits = states.filter("n_rows > 1")
    met = save(mine.select(*KEY, F.col("locator").alias("mine"), "content").join(hits.select(*KEY, "stays.locator"), KEY), "dedup-hits")
    stays = met.filter("mine = locator").select(*KEY, F.col("content").alias("kept_content"))
    parts = F.split("locator", "#")
    elsewhere = met.filter(parts[0] != call).select(parts[0].alias("call"), parts[1].cast("int").alias("slot")).distinct().collect() if lasting else []  # a row a slot
    for other in sorted({r.call for r in elsewhere}):
        content = told([other], [r.slot for r in elsewhere if r.call == other]).select("locator", F.col("content").alias("kept_content"))
        stays = stays.unionByName(met.filter(parts[0] == other).select(*KEY, "locator").distinct().join(content, "locator").select(*KEY, "kept_content"))
    differ = met.join(stays, KEY).filter("content <> kept_content").select(*KEY).distinct()
    differ = save(differ, "dedup-differ")
    if lasting:
        differ.write.mode("overwrite").parquet(f"{state_dir}/differ/{call}")
        known = spark.read.schema("digest string, n_bytes long").parquet(*(f"{state_dir}/differ/{c}" for c in _names(spark, f"{state_dir}/differ")))
        differ = save(known.distinct(), "dedup-differ")
    kept = [F.when(~F.col("lacks"), F.col("content")).alias("keep_text")] if "text" in keep else []
    shown = ["doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("n_rows").alias("group_size"), (F.col("locator") == F.col("stays.locator")).alias("kept"), "text_sha256", *kept, *(f"keep_{c}" for c in keep if c != "text")]
    if differ.isEmpty():
        return mine.join(states, KEY).select(*shown)
    upto = _names(spark, f"{state_dir}/rows") if lasting else [call]
    apart = told(upto).join(differ, KEY, "left_semi")
    by_text = save(apart.groupBy("content").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("n_rows")), "dedup-by-text")
    return mine.join(states.join(differ, KEY, "left_anti"), KEY).select(*shown).unionByName(mine.join(differ, KEY, "left_semi").join(by_text, "content").select(*shown))


def _rows(spark: SparkSession, state_dir: str, calls: Sequence[str], schema: StructType, slots: Sequence[int] | None = None) -> DataFrame:
    """The rows of calls, or of some slots of one."""
    paths = [f"{state_dir}/rows/{c}" for c in calls] if slots is None else [f"{state_dir}/rows/{c}/slot={s}" for c in calls for s in sorted(slots)]
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
