"""Raw reads as a data source, numbered lines, FASTA in splits, counters of one scan, calls that keep arriving."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandwise import cli
from strandwise.functions import sequence as S
from strandwise.operators import extract, frequency, motifs
from strandwise.plans import views as V
from strandwise.sources import raw, sinks, text
from strandwise.streaming import frequency as stream

D = "/root/testdata/sf0.001"
GROUP = "RawGenomeCorrected_000/BaseCalled_template"


def run(spark, *args):
    a = cli.parser().parse_args([*map(str, args)])
    a.run(spark, a)


@pytest.fixture
def split(spark):
    """Sets the size of splits."""
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def archive(path, i, chrom="chr1", short=False, **more):
    n = 8
    parts = {"signal": np.arange(40) + i, f"{GROUP}/start": np.arange(n) * 4, f"{GROUP}/length": np.full(n - short, 4), f"{GROUP}/base": np.array(list("ACGCCGTA"), dtype="S1")}
    about = {"read_id": f"r{i}", "align_strand": "+-"[i % 2], "chrom": chrom, "chrom_start": 10 * i, "digitisation": 8192.0, "range": 1400.0, "offset": 3.0, "read_start_rel_to_raw": 2}
    np.savez(path, attributes=json.dumps(about | more), **parts)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(6):
        archive(tmp_path / "in" / ("deep" if i > 3 else "") / f"{i}.npz", i, f"chr{i % 2}")
    archive(tmp_path / "in" / "short.npz", 7, short=True)
    (tmp_path / "in" / "bad.npz").write_bytes(b"no archive")
    (tmp_path / "in" / "notes.txt").write_text("not a read")
    return f"file://{tmp_path}/in"


def test_raw_reads(spark, folder):
    rows = raw.reads(spark, folder)
    good = rows.filter("reason is null").orderBy("read_id").collect()
    assert [r.read_id for r in good] == [f"r{i}" for i in range(6)] and good[1].raw[:2] == [1.0, 2.0]
    assert [tuple(e) for e in good[0].events[:2]] == [(2, 4, "A"), (6, 4, "C")] and good[0].read_strand == "t" and good[3].chrom_start == 30
    lost = {r.file.rsplit("/", 1)[1]: r.reason for r in raw.unreadable(rows).collect()}
    assert set(lost) == {"short.npz", "bad.npz"} and "differ in number" in lost["short.npz"]
    assert raw.reads(spark, folder, recursive=False).filter("reason is null").count() == 4
    assert raw.reads(spark, folder, subgroup="BaseCalled_complement").filter("reason is null").count() == 0
    assert spark.read.format("raw_reads").option("bytesAPartition", 1).load(folder).rdd.getNumPartitions() == 8
    assert spark.read.format("raw_reads").load(folder).rdd.getNumPartitions() == 1


def test_raw_reads_take_filters(spark, folder):
    rows = raw.reads(spark, folder).filter("chrom = 'chr1' and read_id in ('r1', 'r5', 'r2')")
    assert sorted(r.read_id for r in rows.collect()) == ["r1", "r5"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "").replace("PushedFilters", "")  # none is left to Spark
    other = raw.reads(spark, folder).filter("chrom = 'chr1' and chrom_start > 20")
    assert sorted(r.read_id for r in other.collect()) == ["r3", "r5"]


def test_pushed_filters_end_before_the_signal(tmp_path):
    archive(tmp_path / "a.npz", 1, short=True)  # its signal can't be read
    reader = raw.RawReader({"path": f"file://{tmp_path}"}, None or type("S", (), {"names": ["read_id", "reason"]}))
    left = list(reader.pushFilters([raw.EqualTo(("chrom",), "chr9"), raw.EqualTo(("file",), "x")]))
    assert len(left) == 1 and list(reader.read(reader.partitions()[0])) == []


def test_counts_of_one_scan(spark, folder, tmp_path):
    counts = Observation("c")
    rows = extract.features(raw.reads(spark, folder), ["CG"], k=3, width=4, counts=counts)
    n = rows.count()
    assert n == 12 and counts.get == {"reads": 8, "failed": 2, "unreadable": 2}
    run(spark, "extract", "--reads", folder, "--raw", "yes", "--k", 3, "--width", 4, "--report", f"{folder}/../report", "--out", f"{folder}/../features")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/../report").first().asDict() == {"reads": "8", "failed": "2", "unreadable": "2"}
    assert spark.read.text(f"{folder}/../features").count() == 12


def test_late_signals(spark):
    """Positions meet sites without arrays; the result is that of filtering all sites."""
    reads = V.signals(spark, D)
    wanted = V.calls(spark, D).filter("truth").select("chrom", "pos", "strand")
    here = reads.unionByName(reads.limit(3)).unionByName(reads.limit(3).withColumn("offset", F.lit(1.0)))
    every, some = (extract.features(here, ["C"], k=3, width=4, positions=p) for p in (None, wanted))
    w = wanted.withColumnRenamed("strand", "alignstrand").distinct()
    want = every.join(w, ["chrom", "pos", "alignstrand"], "left_semi").select(*some.columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(some) == key(want) and some.count() > 10
    plan = some._jdf.queryExecution().optimizedPlan()
    todo, seen = [plan], 0
    while todo:
        node = todo.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftSemi":
            seen += 1
            assert all("ArrayType" not in kid.schema().toString() for kid in kids)
        todo += kids
    assert seen == 1


@pytest.mark.parametrize("size", ["100", "1k", "1g"])
def test_numbered_lines(spark, tmp_path, split, size):
    files = {f"f{i}.txt": [f"{i}/{j}" + "x" * (j % 40) for j in range(n)] for i, n in enumerate((0, 1, 300, 77))}
    for name, rows in files.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    split(size)
    rows = text.lines(spark, f"file://{tmp_path}")
    found = {(r.line.file.rsplit("/", 1)[1], r.line["at"]): r.value for r in rows.collect()}
    assert found == {(name, i): v for name, values in files.items() for i, v in enumerate(values)}
    wanted = rows.filter("line.at % 50 = 7").select("line")
    assert sorted(r.value for r in text.at_lines(rows, wanted).collect()) == sorted(v for values in files.values() for i, v in enumerate(values) if i % 50 == 7)
    assert text.without_lines(rows, wanted).count() == 378 - 8
    assert text.is_empty(spark, f"file://{tmp_path}/f0.txt") and not text.is_empty(spark, f"file://{tmp_path}/f1.txt")
    (tmp_path / "numbers").write_text("3\n299\n1000\n")
    run(spark, "lines", "--rows", f"file://{tmp_path}/f2.txt", "--numbers", f"file://{tmp_path}/numbers", "--out", f"file://{tmp_path}/picked")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/picked").collect()) == sorted([files["f2.txt"][3], files["f2.txt"][299]])


def test_numbered_calls_and_features(spark, tmp_path, split):
    rows = V.calls(spark, D).limit(200).withColumn("read_strand", F.lit("t"))
    from strandwise import schemas

    rows.select(*schemas.names(schemas.CALLS)).coalesce(1).write.option("sep", "\t").csv(f"file://{tmp_path}/calls")
    want = None
    for size in ("500", "1g"):
        split(size)
        got = sorted((r.line["at"], r.pos, r.readname) for r in text.calls(spark, f"file://{tmp_path}/calls").collect())
        assert [g[0] for g in got] == list(range(200)) and (want is None or got == want)
        want = got
    sinks.features(extract.features(V.signals(spark, D), ["CG"], k=3, width=4).limit(50), f"file://{tmp_path}/features", one_file=True)
    assert sorted(r.line["at"] for r in text.features(spark, f"file://{tmp_path}/features", with_lines=True).collect()) == list(range(50))


FASTA = {"a one": "ACGTNacgta" * 30, "b": "", "c\tx": "CG", "a": "TTTT" * 5, "last": "ACCGGT" * 77}


@pytest.mark.parametrize("size", ["64", "200", "1g"])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_fasta_in_splits(spark, tmp_path, split, size, width):
    lines = ["lost before any header"]
    for name, seq in FASTA.items():
        lines += [f">{name}", *(seq[i : i + width] for i in range(0, len(seq), width)), ""]
    (tmp_path / "ref.fa").write_text("\n".join(lines))
    split(size)
    got = text.fasta_lines(spark, f"file://{tmp_path}/ref.fa")
    short = {n.split()[0] if n != "a" else "a2": s.upper() for n, s in FASTA.items()}
    whole = {}
    for r in sorted(got.collect(), key=lambda r: r["at"]):
        key = (r.name, tuple(r.record))
        assert r["at"] == len(whole.get(key, ""))
        whole[key] = whole.get(key, "") + r.bases
    assert sorted((k[0], s) for k, s in whole.items()) == sorted((n.removesuffix("2"), s) for n, s in short.items() if s)
    assert sorted((r.name, r.len) for r in text.fasta_lengths(got).collect()) == sorted((n.removesuffix("2"), len(s)) for n, s in short.items() if s)
    c = spark.createDataFrame([(n.removesuffix("2"), s) for n, s in short.items()], "name string, seq string")
    key = lambda df: sorted((r.name, r.begin, r["first"], r.part, r.whole) for r in df.collect())
    for margins in ((0, 0, 16), (2, 2, 5), (0, 1, 1000)):
        assert key(text.fasta_tiles(got, *margins)) == key(S.tiles(c, *margins))


def test_a_large_contig_is_read_by_many_tasks(spark, tmp_path, split):
    line, n = "ACGTACGGTCCCATGATGAC" * 3, 40_000
    (tmp_path / "big.fa").write_text(">big\n" + f"{line}\n" * n)
    split("100k")
    lines = text.fasta_lines(spark, f"file://{tmp_path}/big.fa")
    tiles = text.fasta_tiles(lines, 0, 1, 4096)
    assert lines.filter("length(bases) > 60").isEmpty() and text.fasta_lengths(lines).first().len == 60 * n
    assert tiles.count() == -(-60 * n // 4096) and spark.read.text(f"file://{tmp_path}/big.fa").rdd.getNumPartitions() > 20
    assert S.scan_tiles(tiles, ["CG"]).count() == (line * n).count("CG")


def test_motifs_of_the_reference(spark):
    """The kernel that finds cytosines gives the classes of the three bases, in tiles of any size, and rows of other tables meet them."""
    rng = np.random.default_rng(4)
    c = spark.createDataFrame([(f"c{i}", "".join(rng.choice(list("ACGTCGCGNHDRx"), 200))) for i in range(5)] + [("short", "C"), ("none", ""), ("g", "GG")], "name string, seq string")
    got = {size: sorted(map(str, motifs.reference_sites(c, size).collect())) for size in (1, 3, 64, 1000)}
    assert len({tuple(x) for x in got.values()}) == 1
    each = {(r.chrom, r.pos, r.strand): r.motif for r in motifs.reference_sites(c).collect()}
    for r in c.collect():
        for i, b in enumerate(r.seq):
            if b == "C":
                assert each[r.name, i, "+"] == spark_class(r.seq[i : i + 3])
            if b == "G" and i >= 2:
                three = r.seq[i - 2 : i + 1]
                back = "".join(S.DNA_COMPLEMENT[S.DNA.index(x)] if x in S.DNA else "?" for x in reversed(three))
                assert each[r.name, i, "-"] == spark_class(back)
    rows = spark.createDataFrame([("c0", p, s, 1) for p in range(-1, 201) for s in "+-."] + [("other", 1, "+", 1)], "chrom string, pos long, strand string, n int")
    marked = motifs.classify_by_reference(rows, motifs.reference_sites(c)).collect()
    assert len(marked) == 607 and all(r.motif == each.get((r.chrom, r.pos, r.strand)) for r in marked)


def spark_class(three):
    for kind, pattern in (("CG", "CG[ACGTN]"), ("CHG", "C[ACTH]G"), ("CHH", "C[ACT][ACT]|CHH")):
        if re.fullmatch(pattern, three):
            return kind


def test_streamed_frequencies(spark, tmp_path):
    """All columns of the batch, the first call's attributes included, and after a restart, too; files come out of order."""
    from strandwise import schemas

    rows = V.calls(spark, D).select(*schemas.names(schemas.CALLS)).limit(600).toPandas()
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, part: part.to_csv(folder / name, sep="\t", header=False, index=False)
    put("b.tsv", rows[:200])
    put("c.tsv", rows[150:400])
    calls = stream.read_calls(spark, f"file://{folder}", 1)
    start = lambda: stream.run(calls, f"file://{tmp_path}/out", f"file://{tmp_path}/state", once=True).awaitTermination()
    start()
    put("a.tsv", rows[350:])  # before the others by name, after them in time
    start()
    key = lambda df: sorted(map(str, df.select(*frequency.FREQ).collect()))
    batch = frequency.site_frequency(text.calls(spark, f"file://{folder}"), ["line"])
    assert key(stream.latest(spark, f"file://{tmp_path}/out")) == key(batch) and batch.count() > 50
