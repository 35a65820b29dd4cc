"""A pipeline over documents: toxicity, exact dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Near copies are dropped by row, so ids may be null or repeat.
A stage removes what earlier ones left in the shared folder and its input doesn't read, so run one pipeline at a time in a process.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from strandwise.llm.common import collecting, new_folder, remove, row_keys, save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Folders that stages of this process wrote on their way and that are still there.
_left: list[str] = []


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage first removes what earlier ones left, but for folders that its input still reads from.

    An input that was written and read again reads from none, so disks hold what one stage needs; inputs that are plans over an earlier stage keep
    what that one wrote, however many stages are put together.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        kept = [folder for folder in _left if any(_name(folder) in file for file in read)]
        remove(spark, [folder for folder in _left if folder not in kept])
        _left[:] = kept
        with collecting(_left):
            return function(spark, docs, sf_dir)

    return run_stage


def _name(folder: str) -> str:
    """A folder's own name, which no other has."""
    return f"/{folder.rstrip('/').rsplit('/', 1)[1]}/"


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of documents that are here."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, threshold=0.3, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    kept = exact_dedup.exact_dedup(docs, keep=COLUMNS).filter("kept")
    return kept.select(*(F.col(f"keep_{c}").alias(c) for c in COLUMNS))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows whose five-word shingles are similar to 0.8 or more, one stays: that of the smallest doc_id, null last."""
    keyed = save(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_key")), "near-rows")
    found = jaccard.jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"), n=5, share=(80, 100))
    found = save(found.filter("component_id < doc_id").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_of")), "near-found")
    members = found.union(found.select(F.col("_of").alias("_key"), "_of").distinct())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "_key")).alias("stays")
    stays = members.join(keyed.select("_key", "doc_id"), "_key").groupBy("_of").agg(least).select("stays._key")
    return keyed.join(members.join(stays, "_key", "left_anti"), "_key", "left_anti").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as often as the mix reads it, whole each time, in the order of training; documents it never reaches go.

    Positions are found on keys and sizes; texts join them and are range-sorted by position. The last document of a source may be read
    in part by the mix but stands here whole, so the words of a source exceed its target by less than that document's.
    """
    keyed = row_keys(docs, "_key")
    mixed = mixing.mix(keyed, keep=("_key",), ordered=False, passes=True)
    read = save(mixed.filter("copies > 0").select(F.col("keep__key").alias("_key"), F.explode("positions").alias("position")), "mixed")
    return keyed.join(read, "_key").orderBy("position", "doc_id", "_key").select(*COLUMNS)


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests that show that they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", tokenize)]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"pipeline-{k}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
