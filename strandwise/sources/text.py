"""Readers of headerless tab-separated relations, FASTA, GFF3 and lists. Spark reads gzip by the file's suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.annotation import annotate
from ..operators.extract import from_text
from ..operators.tables import written


def tsv(spark: SparkSession, paths: str | Sequence[str], schema: str, contains: str | None = None) -> DataFrame:
    """Rows of files, or of the files of folders whose name holds `contains`; files have `file_idx`, rows their order in a file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input path")
    reader = spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST")
    if contains is not None:
        reader = reader.option("pathGlobFilter", f"*{contains}*")
    return reader.csv(paths)


def numbered(rows: DataFrame) -> DataFrame:
    """Add `line` (file, at): the file and the number of the row in it, from 0 without gaps, whatever splits the file is read in.

    `rows` come straight from files, a row a line. Spark numbers the rows of a task; what a split's first row has, and how many rows lie in the splits
    before it, is one row a split, which meets the rows. Nothing is sorted.
    """
    told = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = told.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    line = F.struct(F.col("_file").alias("file"), (F.col("_before") + F.col("_id") - F.col("_first")).alias("at"))
    return told.join(splits, ["_file", "_block"]).withColumn("line", line).drop("_file", "_block", "_id", "_first", "_before")


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """value and line of the lines of text files."""
    return numbered(spark.read.text([paths] if isinstance(paths, str) else list(paths)))


def at_lines(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The numbered rows whose `line` is among those of `wanted` (line); a lookup, without a sort."""
    return rows.join(wanted.select("line").distinct(), "line", "left_semi")


def without_lines(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The other rows."""
    return rows.join(wanted.select("line").distinct(), "line", "left_anti")


def calls(spark: SparkSession, paths, contains: str | None = None) -> DataFrame:
    return numbered(tsv(spark, paths, schemas.CALLS, contains))


def frequencies(spark: SparkSession, paths, contains: str | None = None) -> DataFrame:
    return numbered(tsv(spark, paths, schemas.FREQ, contains))


def bed(spark: SparkSession, paths) -> DataFrame:
    return tsv(spark, paths, schemas.BED)


def features(spark: SparkSession, paths, contains: str | None = None, with_lines: bool = False) -> DataFrame:
    """Features of files; `with_lines` adds their line, by which training addresses samples."""
    rows = tsv(spark, paths, schemas.FEATURE_TEXT, contains)
    return from_text(numbered(rows) if with_lines else rows)


def reads(spark: SparkSession, path: str) -> DataFrame:
    """The canonical relation of reads, as Parquet."""
    return spark.read.schema(schemas.READS).parquet(path)


def fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """name (to the first space), seq and len of each contig; those without a sequence go.

    A record is what stands between lines that begin with >. For large contigs, see fasta_tiles.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.col("value"), "^>", "")
    seq = F.regexp_replace(F.regexp_replace(body, "^[^\n]*(\n|$)", ""), r"\s", "")
    rows = text.select(F.regexp_extract(body, r"^(\S*)", 1).alias("name"), (F.upper(seq) if upper else seq).alias("seq"))
    return rows.withColumn("len", F.length("seq").cast("long")).filter("len > 0")


def fasta_lines(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """name, record, at, bases of each line of sequence: `at` is the place of its first base in the contig, record (file, line) tells records apart.

    Files are read in splits. Within a split, lines are in their order; each split then has one row for what it leaves to the next: the
    last header in it and the bases after that, carried over splits without headers. So a contig of any length is read by many tasks,
    and no row holds more than a line.
    """
    value = F.regexp_replace("value", r"\s", "")
    head = F.col("value").startswith(">")
    told = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    told = told.select("file", "block", "id", F.when(head, F.struct(F.regexp_extract("value", r"^>(\S*)", 1).alias("name"), F.col("block").alias("block"), F.col("id").alias("id"))).alias("head"), F.when(~head, F.upper(value) if upper else value).alias("bases"))
    rows = written(told.filter("head is not null or bases <> ''"), "fasta-lines")
    size = F.coalesce(F.length("bases"), F.lit(0)).cast("long")
    inside = Window.partitionBy("file", "block").orderBy("id")
    rows = rows.withColumn("mine", F.last("head", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("size", size)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("file", "block", "mine").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # What each split leaves: its last header, if it has one, and the bases after it.
    ends = rows.groupBy("file", "block").agg(F.max_by(F.struct("mine", (F.col("before") + F.col("size")).alias("bases")), "id").alias("end"))
    files = Window.partitionBy("file").orderBy("block")
    ends = ends.select("file", "block", "end.mine", "end.bases")
    runs = ends.withColumn("run", F.count("mine").over(files))  # splits since the same header share a run
    carry = Window.partitionBy("file", "run").orderBy("block")
    runs = runs.select("file", "block", F.first("mine").over(carry).alias("mine"), F.sum("bases").over(carry).alias("bases"))
    given = runs.select("file", "block", F.lag("mine").over(files).alias("given"), F.lag("bases").over(files).alias("given_bases"))
    rows = rows.filter("bases is not null").join(given, ["file", "block"])
    first = F.col("mine").isNull()
    of = F.coalesce("mine", "given")
    at = F.col("before") + F.when(first, F.coalesce("given_bases", F.lit(0))).otherwise(0)
    return rows.select(of["name"].alias("name"), F.struct("file", of["block"].alias("block"), of["id"].alias("id")).alias("record"), at.alias("at"), "bases").filter("name is not null")


def fasta_lengths(lines: DataFrame) -> DataFrame:
    """name and len of each contig, from its lines."""
    return lines.groupBy("name", "record").agg(F.sum(F.length("bases").cast("long")).alias("len")).select("name", "len")


def fasta_tiles(lines: DataFrame, left: int = 0, right: int = 0, size: int = 1 << 18) -> DataFrame:
    """Tiles of contigs as functions.sequence.tiles gives them, made of lines (see fasta_lines): a line goes to each tile that it has bases of."""
    whole = lines.groupBy("record").agg(F.sum(F.length("bases").cast("long")).alias("whole"))
    stop = F.col("at") + F.length("bases")
    ks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - right) / size)), F.floor((stop - 1 + left) / size))
    each = lines.select("*", F.explode(ks).alias("k")).withColumn("first", F.greatest(F.col("k") * size - left, F.lit(0))).withColumn("end", (F.col("k") + 1) * size + right)
    skip = F.greatest(F.col("first") - F.col("at"), F.lit(0)).cast("int")
    piece = F.substring("bases", skip + 1, (F.least(stop, F.col("end")) - F.col("at")).cast("int") - skip)
    parts = each.withColumn("piece", piece).filter("piece <> ''").groupBy("name", "record", "k", "first").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("x"))
    rows = parts.join(whole, "record").filter(F.col("k") * size < F.col("whole"))
    return rows.select("name", (F.col("k") * size).alias("begin"), "first", F.array_join("x.piece", "").alias("part"), "whole")


def contig_names(spark: SparkSession, source: str) -> DataFrame:
    """Names of a FASTA file (as they are), a file of a name a line, or a comma-separated list (sorted, distinct)."""
    if "/" not in source and "." not in source:
        names = spark.createDataFrame([(x.strip(),) for x in source.split(",")], "name string")
        return names.distinct().orderBy("name")
    lines = spark.read.text(source)
    if source.removesuffix(".gz").endswith((".fa", ".fasta", ".fna")) or not lines.filter(F.col("value").startswith(">")).isEmpty():
        return lines.filter(F.col("value").startswith(">")).select(F.regexp_extract("value", r"^>(\S*)", 1).alias("name"))
    return lines.select(F.trim("value").alias("name")).filter("name <> ''").distinct().orderBy("name")


def positions(spark: SparkSession, path: str, columns: int = 3, header: bool = False) -> DataFrame:
    """Distinct chrom, pos and, of three columns, strand; a line with fewer columns is an error. With `header`, each file has one."""
    # Spark leaves out the header of each file, however files are split; a line is one column, as nothing parts it.
    whole = spark.read.schema("value string").option("sep", "\x01").option("quote", "")
    lines = whole.option("header", True).csv(path) if header else spark.read.text(path)
    words = F.split(F.rtrim("value"), r"\s+")
    short = F.raise_error(F.concat(F.lit(f"fewer than {columns} columns: "), F.col("value")))
    cells = lines.filter(F.length(F.trim("value")) > 0).select(F.when(F.size(words) >= columns, words).otherwise(short.cast("array<string>")).alias("w"))
    picked = [F.col("w")[0].alias("chrom"), F.col("w")[1].alias("pos")] + ([F.col("w")[2].alias("strand")] if columns > 2 else [])
    rows = cells.select(*picked).distinct()
    return rows.withColumn("pos", F.col("pos").cast("long")) if columns > 2 else rows


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows with attributes as a map and relations; starts become 0-based."""
    return annotate(spark.read.schema(schemas.GFF).option("sep", "\t").option("comment", "#").csv(path))


def count_lines(spark: SparkSession, path: str, header: bool = False) -> int:
    n = spark.read.text(path).count()
    return max(0, n - 1) if header else n


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether files have no line; looks at one."""
    return spark.read.text(path).isEmpty()
