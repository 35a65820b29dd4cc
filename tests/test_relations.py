"""Interval joins, coordinates of transcripts, proportional shuffles, functions in SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise import cli
from strandwise.functions import numbers as N
from strandwise.functions import sequence as S
from strandwise.functions import signal as G
from strandwise.functions.sql import register_functions
from strandwise.operators import annotation, intervals, samples
from strandwise.plans import views as V

D = "/root/testdata/sf0.001"


def uneven(seed, n, crowd=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randint(0, 2_000_000)
        rows.append((rng.choice(["c1", "c2"]), start, start + rng.choice([0, 1, 60, 64, 65, 5000, 700_000, 3_000_000]), i))
    rows += [("c1", 1000 + i % 7, 1010 + i % 5, n + i) for i in range(crowd)]
    return rows + [("c1", 0, 2_000_000_000, -1), ("c2", 64, 128, -2), ("c3", 1, 2, -3), (None, 1, 2, -4)]


@pytest.mark.parametrize("dense", [10_000, 20])
def test_interval_join(spark, dense):
    a, b = uneven(1, 120, 90), uneven(2, 150, 60)
    schema = "chrom string, start long, end long, id long"
    left, right = spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(2)
    got = sorted((r.left_id, r.right_id) for r in intervals.interval_join(left, right, dense=dense).collect())
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert got == want and len(want) > 5000


def test_entries_of_long_intervals_are_few(spark):
    """An interval over a whole chromosome has two entries a level at most, where bins of 10 000 would have 25 000."""
    one = spark.createDataFrame([("c", 3, 250_000_000, 1)], "chrom string, start long, end long, id long")
    levels = F.array(*(F.lit(i) for i in range(intervals.LEVELS)))
    entries = intervals._entries(one, "x", levels)
    assert entries.groupBy("level").count().agg(F.max("count")).first()[0] <= 2 and entries.count() < 40
    assert [r[0] for r in spark.sql("select * from values (0, 0), (0, 1), (0, 64), (0, 65), (0, 512), (0, 513) as t(a, b)").select(intervals.level(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 1, 1, 2]


def test_interval_join_of_nothing(spark):
    none = spark.createDataFrame([], "chrom string, start long, end long, id long")
    some = spark.createDataFrame([("c", 1, 2, 1)], none.schema)
    assert intervals.interval_join(none, some).count() == intervals.interval_join(some, none).count() == 0


def genes(spark):
    rows = [("mRNA", 1, 90, "+", "ID=transcript:p"), ("exon", 11, 20, "+", "Parent=transcript:p;rank=1"), ("exon", 31, 35, "+", "Parent=transcript:p;rank=2"), ("mRNA", 1, 90, "-", "ID=transcript:m"), ("exon", 41, 60, "-", "Parent=transcript:m;rank=1"), ("exon", 12, 18, "-", "Parent=transcript:m;rank=2"), ("exon", 5, 4, "-", "Parent=transcript:m;rank=3")]
    return annotation.annotate(spark.createDataFrame([("c", "made", f, a, b, ".", s, ".", t) for f, a, b, s, t in rows], "chrom string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string"))


@pytest.mark.parametrize("width", [1 << 16, 4])
def test_transcripts_both_ways(spark, width, monkeypatch):
    rows = genes(spark)
    placed = annotation.transcript_map(rows)
    bases = {(r.parent, r["at"]): (r.chrom, r.strand, r.pos) for r in annotation.transcript_coordinates(rows).collect()}
    assert bases == {("p", i): ("c", "+", 10 + i if i < 10 else 20 + i) for i in range(15)} | {("m", i): ("c", "-", 59 - i if i < 20 else 37 - i) for i in range(27)}
    monkeypatch.setattr(annotation, "carried", lambda *a: intervals.carried(*a, width=width))
    points = spark.createDataFrame([(p, at, n) for p in ("p", "m", "x") for at in range(-1, 30) for n in (1, 2)], "parent string, at long, n int")
    got = sorted(tuple(r) for r in annotation.to_genome(placed, points).collect())
    assert got == sorted((p, at, n, *place) for (p, at), place in bases.items() for n in (1, 2))
    spots = spark.createDataFrame([(c, pos, 7) for c in ("c", "d") for pos in range(0, 70)], "chrom string, pos long, n int")
    back = sorted((r.parent, r["at"], r.chrom, r.strand, r.pos) for r in annotation.to_transcripts(placed, spots).collect())
    assert back == sorted((p, at, *place) for (p, at), place in bases.items())


def test_transcript_command(spark, tmp_path):
    lines = ["##gff-version 3"] + ["\t".join(("c", "made", f, str(a), str(b), ".", "+", ".", t)) for f, a, b, t in (("mRNA", 1, 9, "ID=transcript:p"), ("exon", 3, 5, "Parent=transcript:p;rank=1"))]
    (tmp_path / "g.gff3").write_text("\n".join(lines))
    for bases, n in (("no", 1), ("yes", 3)):
        a = cli.parser().parse_args(["transcripts", "--gff", f"file://{tmp_path}/g.gff3", "--bases", bases, "--out", f"file://{tmp_path}/{bases}"])
        a.run(spark, a)
        assert spark.read.parquet(f"file://{tmp_path}/{bases}").count() == n


@pytest.mark.parametrize("sizes", [(700, 300), (1000, 1), (5, 0), (250, 250, 500), (0, 0)])
def test_shuffles_keep_proportions(spark, sizes):
    parts = [spark.range(n).select(F.concat(F.lit(f"{i}/"), F.col("id").cast("string")).alias("idx")) for i, n in enumerate(sizes)]
    rows = samples.mixed_order(parts, 3, stretch=100)
    got = sorted((r.position, r.part, r.idx) for r in rows.collect())
    assert [g[0] for g in got] == list(range(sum(sizes)))
    for begin in range(0, sum(sizes) - 99, 100):
        for i, n in enumerate(sizes):
            assert abs(sum(g[1] == i for g in got[begin : begin + 100]) - 100 * n / sum(sizes)) <= 2
    files = [r.idx for r in samples.in_order(rows).collect()]
    assert files == [g[2] for g in got] and (sum(sizes) < 100 or files != sorted(files))
    assert sorted(r.idx for r in samples.mixed_order(parts, 3, stretch=7).collect()) == sorted(g[2] for g in got)


def test_shuffle_command(spark, tmp_path):
    for name, n in (("a", 400), ("b", 100)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    a = cli.parser().parse_args(["shuffle", "--rows", f"file://{tmp_path}/a", f"file://{tmp_path}/b", "--stretch", "50", "--out", f"file://{tmp_path}/out"])
    a.run(spark, a)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    rows = [x for p in files for x in p.read_text().split()]
    assert len(rows) == 500 and all(9 <= sum(x[0] == "b" for x in rows[i : i + 50]) <= 11 for i in range(0, 500, 50)) and rows != sorted(rows)


def test_sql_functions(spark):
    register_functions(spark)
    seqs = ["ACGTN", "acX", "", "CGCGA", "CHH", "CAG", "CHG", None]
    t = spark.createDataFrame([(s,) for s in seqs], "s string")
    t.createOrReplaceTempView("seqs")
    got = spark.sql("select reverse_complement(s) as r, motif_class(s) as m, kmer_class(s) as k from seqs").collect()
    want = t.select(S.reverse_complement(F.col("s")).alias("r"), S.motif_class(F.col("s")).alias("m"), S.kmer_class(F.col("s")).alias("k")).collect()
    assert got == want
    for motif in ("CG", "chg ", "CHN", "a"):
        assert spark.sql(f"select expand_motif('{motif}') as m").first().m == S.expand_iupac(motif)
    V.signals(spark, D).createOrReplaceTempView("reads")
    for width in (3, 64, 71):
        sql = spark.sql(f"select rectangle(raw, {width}, read_id, 5) as x from reads order by read_id").collect()
        assert sql == V.signals(spark, D).orderBy("read_id").select(G.rectangle(F.col("raw"), width, F.col("read_id"), 5).alias("x")).collect()
    V.contigs(spark, D).limit(20).createOrReplaceTempView("contigs")
    hits = spark.sql("select name, pos from contigs, lateral motif_scan(seq, 'CHG', 1) order by name, pos").collect()
    assert hits == S.scan_motifs(spark.table("contigs"), S.parse_motifs("CHG"), 1).orderBy("name", "pos").collect()
    rows = genes(spark)
    annotation.transcript_map(rows).createOrReplaceTempView("exons")
    bases = spark.sql("select parent, b.at, chrom, strand, b.pos from exons, lateral transcript_bases(start, end, begin, strand) b order by parent, at").collect()
    assert bases == annotation.transcript_coordinates(rows).orderBy("parent", "at").collect()
    assert "BatchEvalPython" not in spark.sql("select reverse_complement(s), rectangle(array(1.0D), 3, s, 1) from seqs")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1 << 12, 16])
def test_overlap_totals_make_no_pairs(spark, width):
    a, b = uneven(1, 120, 90), uneven(2, 150, 60)
    schema = "chrom string, start long, end long, id long"
    left, right = spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame([(*x[:3], None if x[3] % 3 == 0 else x[3]) for x in b], schema.replace("id", "v")).repartition(2)
    got = {r.id: (r.n, r.v) for r in intervals.overlap_totals(left, right, ["v"], width).collect()}
    want = {}
    for x in a:
        met = [y[3] for y in b if x[0] and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]]
        values = [v for v in met if v % 3]
        want |= {x[3]: (len(met), sum(values) if values else None)} if met else {}
    assert got == want and sum(n for n, _ in got.values()) > 5000


def test_kernels_yield_bounded_batches():
    """A batch of tiles is looked at in slices, so what a kernel holds doesn't grow with the batch."""
    batch = pa.RecordBatch.from_pydict({"name": list("abcdef"), "part": ["C" * n for n in (3, 4, 0, 20, 1, 1)]})
    slices = list(S.few_bases(iter([batch]), 7))
    assert [s.column("name").to_pylist() for s in slices] == [["a", "b", "c"], ["d"], ["e", "f"]]


def test_first_n_shuffles_few_rows(spark):
    """Beyond the row limit of Spark's windows, only rows up to a class's n-th are ranked."""
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("idx"), F.when(F.col("id") % 10 > 0, F.col("id") % 2 == 0).alias("truth"))
    found = samples.first_n(rows, "truth", 2000, 4)
    want = {}
    for r in rows.withColumn("c", samples.chance(4, "idx")).collect():
        want.setdefault(r.truth, []).append((r.c, r.idx))
    got = {}
    for r in found.collect():
        got.setdefault(r.truth, set()).add(r.idx)
    assert got == {k: {i for _, i in sorted(v)[:2000]} for k, v in want.items()}
    near = [m for m in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in m]
    assert near, "rows are narrowed by a class's last digits first"


def test_rounding_of_features(spark):
    """Six digits by scaling, as NumPy has it: halves that a double doesn't hit, and a sign that stays on zero."""
    values = [(k + 0.5) / 1e6 for k in range(31690, 32690)] + [-1e-7, 2e-7, -0.0020]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", N.around(F.col("v")).alias("a"), F.bround("v", 6).alias("b")).orderBy("i").collect()
    assert [str(r.a) for r in rows] == [str(x) for x in np.around(values, 6).tolist()] and [r.a for r in rows] != [r.b for r in rows]
    raw = spark.createDataFrame([([0.0, 1.0, -1.0, -1e-7],)], "raw array<double>")
    assert str(raw.select(G.normalize(F.col("raw"), "zscore", 6)[3].alias("v")).first().v) == "-0.0"


def test_one_attribute_is_what_the_map_has(spark):
    texts = ["Parent=a:b;Name=x", " Parent=1 ; Parent = 2;Parent=3=4;", "Parent=;x", "aParent=1;Parent= 5 =6;y=1", "Parent=  ;", "x;Parent", ";;Parent=a\n", "Parent=a\n;q=1", "Name=Parent=5", "\nParent=7", "", None, "Parent=1;;Parent=2 ", "=3;Parent==4", "Parent=9;Parent", "Parent=a:b:c;", "Parent=a:", "Parent=:b ", "Parent:a=b", "Parent=a: b =c:d", "Parent=a=b:c"]
    value = F.try_element_at(annotation.attributes(F.col("t")), F.lit("Parent"))
    second = F.coalesce(F.try_element_at(F.split(value, ":"), F.lit(2)), value)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(second.alias("a"), annotation.attribute(F.col("t"), "Parent", True).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.try_element_at(annotation.attributes(F.col("t")), F.lit("Parent")).alias("a"), annotation.attribute(F.col("t"), "Parent").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
