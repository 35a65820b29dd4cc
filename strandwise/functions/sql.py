"""Functions for SQL: register_functions(spark) adds them to a session, and spark.sql can call them.

Scalar functions are SQL themselves, so Catalyst sees through them; table functions are Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import sequence as S




COMPLEMENT = f"translate(reverse(regexp_replace({{0}}, '[^{S.DNA}]', 'N')), '{S.DNA}', '{S.DNA_COMPLEMENT}')"
CLASS = "CASE WHEN {0} RLIKE '^CG[ACGTN]$' THEN 'CG' WHEN {0} RLIKE '^C[ACTH]G$' THEN 'CHG' WHEN {0} RLIKE '^C[ACT][ACT]$|^CHH$' THEN 'CHH' END"
BASES = "map(" + ", ".join(f"'{k}', split('{v}', '')" for k, v in S.IUPAC.items()) + ")"
PICKED = "slice(array_sort(transform(sequence(0, size(x) - 1), i -> struct(md5(concat_ws('|', seed, key, i)) AS d, i AS i))), 1, width)"

#: Arguments, result and body of each function.
FUNCTIONS = {
    "reverse_complement": ("seq STRING", "STRING", COMPLEMENT.format("seq")),
    "expand_motif": ("motif STRING", "ARRAY<STRING>", f"aggregate(split(upper(trim(motif)), ''), array(''), (found, m) -> flatten(transform(found, f -> transform({BASES}[m], b -> f || b))))"),
    "motif_class": ("three STRING", "STRING", CLASS.format("three")),
    "kmer_class": ("k_mer STRING", "STRING", CLASS.format("substring(k_mer, length(k_mer) div 2 + 1, 3)")),
    "rectangle": (
        "x ARRAY<DOUBLE>, width INT, key STRING, seed INT", "ARRAY<DOUBLE>",
        "CASE WHEN width >= size(x) THEN concat(array_repeat(0.0D, cast((width - size(x)) div 2 AS INT)), x, array_repeat(0.0D, cast((width - size(x) + 1) div 2 AS INT))) "
        f"ELSE transform(array_sort(transform({PICKED}, e -> e.i)), i -> element_at(x, i + 1)) END",
    ),
}


@udtf(returnType="pos: long")
class MotifScan:
    """motif_scan(seq, motif, offset): the places of base `offset` of every sequence that the motif stands for."""

    def eval(self, seq: str, motif: str, offset: int) -> Iterator[tuple[int]]:
        if seq is None or motif is None:
            return
        x = np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)
        wide = len(motif.strip())
        hit = np.ones(max(0, len(x) - wide + 1), dtype=bool)
        for j, letter in enumerate(motif.strip().upper().replace("U", "T")):
            hit &= np.isin(x[j : j + len(hit)], np.frombuffer(S.IUPAC[letter].encode(), dtype=np.uint8))
        for pos in np.flatnonzero(hit).tolist():
            yield (pos + offset,)


@udtf(returnType="at: long, pos: long")
class TranscriptBases:
    """transcript_bases(start, end, begin, strand): the bases of an exon (a row of transcript_map), in the order of the transcript."""

    def eval(self, start: int, end: int, begin: int, strand: str) -> Iterator[tuple[int, int]]:
        if start is not None and end is not None:
            for i in range(end - start):
                yield begin + i, end - 1 - i if strand == "-" else start + i


def register_functions(spark: SparkSession) -> None:
    """Add reverse_complement, expand_motif, motif_class, kmer_class, rectangle, and the tables motif_scan and transcript_bases to a session."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("motif_scan", MotifScan)
    spark.udtf.register("transcript_bases", TranscriptBases)
