"""Gene annotation: attributes, relations, and coordinates of transcripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import let
from .intervals import carried, interval_join
from .tables import written


def attributes(text: Column) -> Column:
    """The map of `key=value;...`: of equal keys the last counts, and a value ends where another = follows."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda x: F.split(F.trim(x), "=")), lambda p: F.size(p) > 1)
    names = lambda ps: F.array_distinct(F.transform(ps, lambda p: p[0]))
    return let(pairs, lambda ps: F.map_from_arrays(names(ps), F.transform(names(ps), lambda k: F.element_at(F.filter(ps, lambda p: p[0] == k), -1)[1])))


def attribute(text: Column, key: str, after_colon: bool = False) -> Column:
    """What attributes() has for a key, by one regular expression instead of a map: null without it; the second part by colons if there is one and it is asked for."""
    skip, stop = ("(?:=[^;=:]*(?=:))?", ":") if after_colon else ("", "")
    value = F.regexp_extract(text, rf"(?s)\A(?:.*;)? *{re.escape(key)}(?==){skip}([={stop}][^;={stop}]*?)(?:[={stop}]| *(?:;|\z))", 1)
    return F.when(value != "", F.substring(value, 2, 2**31 - 1))


def annotate(gff: DataFrame) -> DataFrame:
    """Add attrs, id, parent and rank to rows with 1-based starts, which become 0-based."""
    text = F.col("attributes")
    found = {"attrs": attributes(text), "id": F.coalesce(attribute(text, "ID", True), attribute(text, "Name")), "parent": attribute(text, "Parent", True), "rank": attribute(text, "rank").cast("int")}
    return gff.withColumn("start", F.col("start") - 1).withColumns(found)


def with_attribute(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.filter(F.try_element_at(F.col("attrs"), F.lit(key)) == value)


def kinds(rows: DataFrame, key: str) -> DataFrame:
    """The distinct values of an attribute."""
    return rows.select(F.try_element_at(F.col("attrs"), F.lit(key)).alias("value")).filter("value is not null").distinct()


def features(rows: DataFrame) -> DataFrame:
    return rows.select("feature").distinct()


def exons(rows: DataFrame) -> DataFrame:
    return rows.filter("feature = 'exon' and parent is not null")


def transcript_lengths(rows: DataFrame) -> DataFrame:
    return exons(rows).groupBy("parent").agg(F.sum(F.col("end") - F.col("start")).alias("length"), F.count(F.lit(1)).alias("exons"))


def transcript_map(rows: DataFrame) -> DataFrame:
    """parent, chrom, strand, start, end, begin, length: where each exon lies in the genome, and from which base on in its transcript.

    Exons are in the order of their rank, and run backwards on the minus strand.
    """
    strands = rows.filter("feature <> 'exon' and id is not null").groupBy("id").agg(F.max_by(F.struct("chrom", "strand"), F.col("start")).alias("t"))
    w = Window.partitionBy("parent").orderBy("rank", "start", "end").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    placed = exons(rows).select("parent", "rank", "start", "end", F.coalesce(F.sum(length).over(w), F.lit(0)).alias("begin"))
    return placed.join(strands, placed.parent == strands.id).select("parent", "t.chrom", "t.strand", "start", "end", "begin", length.alias("length"))


def place(at: Column) -> Column:
    """The genome position of base `at` of a transcript, by the row of transcript_map that holds it."""
    i = at - F.col("begin")
    return F.when(F.col("strand") == "-", F.col("end") - 1 - i).otherwise(F.col("start") + i)


def to_genome(placed: DataFrame, points: DataFrame) -> DataFrame:
    """Points (parent, at, and other columns) with chrom, strand and pos; those beyond their transcript go."""
    found = carried(points, placed, ["parent"], "at", "begin", "length", ["chrom", "strand", "start", "end", "begin"])
    return found.withColumn("pos", place(F.col("at"))).select(*points.columns, "chrom", "strand", "pos")


def to_transcripts(placed: DataFrame, points: DataFrame) -> DataFrame:
    """Points (chrom, pos, and other columns) with parent, strand and at of each transcript that has an exon there."""
    spots = points.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})
    exon = written(placed.select("chrom", "start", "end", "parent", "strand", "begin"), "exons")  # the join reads it twice
    both = interval_join(spots, exon, ("point", "exon"))
    at = F.col("exon_begin") + F.when(F.col("exon_strand") == "-", F.col("exon_end") - 1 - F.col("point_pos")).otherwise(F.col("point_pos") - F.col("exon_start"))
    return both.select(*(F.col(f"point_{c}").alias(c) for c in points.columns), F.col("exon_parent").alias("parent"), F.col("exon_strand").alias("strand"), at.alias("at"))


def transcript_coordinates(rows: DataFrame) -> DataFrame:
    """parent, at (from 0), chrom, strand, pos of each base of each transcript: transcript_map written out, for those who want a row a base."""
    each = transcript_map(rows).filter("length > 0").withColumn("at", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length") - 1)))
    return each.select("parent", "at", "chrom", "strand", place(F.col("at")).alias("pos"))
