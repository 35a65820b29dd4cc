"""Hand-computed cases, invariants and plans of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise.functions import numbers as N
from strandwise.functions import sequence as S
from strandwise.functions import signal as G
from strandwise.operators import annotation, denoise, evaluate, extract, frequency, motifs, samples, score
from strandwise.plans import views as V
from strandwise.plans.queries import QUERIES
from strandwise.sources import sinks, text

D = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def calls(spark, rows):
    return spark.createDataFrame([(*r[:6], r[6], r[7], r[8], r[9], i) for i, r in enumerate(rows)], "chrom string, pos long, strand string, pos_in_strand long, readname string, read_strand string, p0 string, p1 string, called_label int, k_mer string, ord int").select(
        "*", F.col("p0").cast("decimal(7,6)").alias("prob_0"), F.col("p1").cast("decimal(7,6)").alias("prob_1")
    )


def test_percents(spark):
    at = lambda f, x: one(spark, f(F.lit(x)))[0]
    assert [at(N.percent, 0.025), at(N.percent_even, 0.025), at(N.percent_floor, 0.025), at(N.percent_floor, 0.29)] == [3, 2, 3, 28]


def test_sequences(spark):
    r = one(spark, S.reverse_complement(F.lit("ACN")), S.reverse_complement(F.lit("AX")), S.reverse_complement(F.lit("AX"), strict=True), S.kmer_class(F.lit("AACGT")), S.kmer_class(F.lit("AACAG")), S.kmer_class(F.lit("AACAA")), S.kmer_class(F.lit("AACNN")), S.center(F.lit("ACG")), S.window(F.lit("ACGTA"), F.lit(2), 3))
    assert list(r) == ["NGT", "NT", "", "CG", "CHG", "CHH", None, "ACG", "CGT"]
    assert S.expand_iupac("CHG") == ["CAG", "CCG", "CTG"]
    with pytest.raises(ValueError):
        S.parse_motifs("CG,CHG")


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_scan_of_tiles(spark, size):
    seq = "CCCGCCNCGACCC" * 5
    c = spark.createDataFrame([("x", seq), ("short", "C"), ("none", "")], "name string, seq string")
    assert sorted(r.pos for r in S.scan_motifs(c, ["CC"], 1, size).collect()) == [i + 1 for i in range(len(seq) - 1) if seq[i : i + 2] == "CC"]
    tiles = S.tiles(c, 2, 2, size, 7).filter("name = 'x'").collect()
    assert min(r.begin for r in tiles) == 0 and all(r.part.startswith(seq[r["first"] : r.begin + size]) for r in tiles) and all(r["first"] == max(0, r.begin - 2) for r in tiles)


def test_positions(spark):
    r = one(spark, N.genome_position(F.lit("-"), F.lit(100), F.lit(20), F.lit(3)), N.strand_position(F.lit("-"), F.lit(116), F.lit(1000)), N.strand_position(F.lit("-"), F.lit(116), F.lit(None).cast("long")))
    assert list(r) == [116, 883, -1]
    assert extract.Region.parse("chr1:5-10") == extract.Region("chr1", 5, 10) and extract.Region.parse("chr1") == extract.Region("chr1")


def test_signal(spark):
    x = F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4, 10)))
    r = one(spark, G.normalize(x, "mad"), G.normalize(x, "zscore"), G.normalize(F.array(F.lit(5.0), F.lit(5.0))), G.rectangle(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 6, F.lit("k")), G.rectangle(x, 3, F.lit("k")))
    v = np.array([1, 2, 3, 4, 10.0])
    assert np.allclose(r[0], np.round((v - 3) / (1 / 0.6744897501960817), 6)) and np.allclose(r[1], np.round((v - v.mean()) / v.std(), 6))
    assert r[2] == [5.0, 5.0] and r[3] == [0.0, 1.0, 2.0, 3.0, 0.0, 0.0] and len(r[4]) == 3 and r[4] == sorted(r[4])


def test_site_frequency(spark):
    rows = [("c", 5, "+", 5, "r", "t", "0.250000", "0.750000", 1, "AACGT"), ("c", 5, "-", 9, "s", "t", "0.900000", "0.100000", 0, "TTCGA"), ("c", 5, "+", 5, "u", "t", "0.400000", "0.600000", 1, "AACGT")]
    f = frequency.site_frequency(calls(spark, rows), ["ord"]).collect()
    assert len(f) == 1 and tuple(f[0]) == ("c", 5, "+", 5, 1.15, 0.85, 1, 1, 2, 0.5, "AACGT")
    assert frequency.used_ratio(calls(spark, rows)).first().used == 2


def test_invariants(spark):
    c = V.calls(spark, D)
    f = frequency.site_frequency(c, V.ORDER)
    assert f.filter("coverage <> met + unmet").isEmpty()
    plus = c.filter("strand = '+'")
    whole = frequency.site_frequency(plus, V.ORDER).select("chrom", "pos", "met", "coverage")
    parts = frequency.combine([frequency.site_frequency(plus.filter(f"ord1 % 2 = {i}"), V.ORDER) for i in (0, 1)]).select("chrom", "pos", "met", "coverage")
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
    s = V.samples(spark, D)
    picked = samples.sample(s, 100)
    assert picked.count() == 100 and samples.complement(s, picked).count() == s.count() - 100
    assert motifs.failures(motifs.classify(c)).agg(F.sum("n")).first()[0] == c.count()


def test_plans(spark):
    wanted = spark.createDataFrame([("chr1", 1, "+")], "chrom string, pos long, strand string")
    plan = extract.features(V.signals(spark, D), ["C"], positions=wanted)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "GreaterThan(doc_id,3)" in V.contigs(spark, D).filter("doc_id > 3")._jdf.queryExecution().executedPlan().toString()


def test_combine_sorts_once(spark):
    """Tables are dealt by site before they meet; after that there is one sort, and the last of equal sites and the last table's attributes count."""
    c = V.calls(spark, D)
    plan = frequency.combine([frequency.site_frequency(c.filter(f"ord1 % 2 = {i}"), V.ORDER) for i in (0, 1)])._jdf.queryExecution().executedPlan().toString()
    after, dealt, _ = plan.partition("REPARTITION_BY_NUM")
    assert dealt and after.count("Sort [") == 1 and plan.count("REPARTITION_BY_NUM") == 2
    rows = [[("c", 5, "+", 1, 1.0, 2.0, 1, 1, 2, 0.5, "old"), ("c", 5, "+", 9, 4.0, 8.0, 2, 0, 2, 1.0, "late"), ("c", 5, "-", 3, 0.5, 0.5, 1, 0, 1, 1.0, "minus")], [("c", 5, "+", 4, 16.0, 32.0, 0, 4, 4, 0.0, "last")], [("c", 6, "+", 6, 1.0, 1.0, 0, 1, 1, 0.0, "own")]]
    out = frequency.combine([spark.createDataFrame(r, V_FREQ) for r in rows]).orderBy("pos", "strand").collect()
    assert [tuple(r) for r in out] == [("c", 5, "+", 4, 20.0, 40.0, 2, 4, 6, 2 / 6, "last"), ("c", 5, "-", 3, 0.5, 0.5, 1, 0, 1, 1.0, "minus"), ("c", 6, "+", 6, 1.0, 1.0, 0, 1, 1, 0.0, "own")]


def test_bed_combine_keeps_its_tasks(spark):
    """Sums of few columns are made in as many tasks as the session asks for, however small the tables are."""
    bed = QUERIES["q_bed_combine"](spark, D)
    assert bed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rename_and_bed(spark):
    f = spark.createDataFrame([("a", 1, "+", 1, 0.0, 1.0, 1, 0, 1, 1.0, "k"), ("a", 1, "+", 1, 0.0, 2.0, 1, 1, 2, 0.5, "k")], "chrom string, pos long, strand string, pos_in_strand long, prob_0_sum double, prob_1_sum double, met long, unmet long, coverage long, rmet double, k_mer string")
    assert [r.percent for r in frequency.frequency_file_to_bed(f, ["prob_1_sum"], 1, {"a": "A"}).collect()] == [50]
    with pytest.raises(Exception, match="no name"):
        frequency.rename_chroms(f, {"b": "B"}).collect()


def test_strands(spark):
    f = spark.createDataFrame([("c", 10, "+", 10, 1.0, 1.0, 1, 1, 2, 0.5, "AACGT"), ("c", 11, "-", 3, 0.0, 1.0, 1, 0, 1, 1.0, "GACGA"), ("c", 30, "-", 3, 0.0, 1.0, 1, 0, 1, 1.0, "GACGA"), ("c", 21, "-", 3, 0.0, 1.0, 1, 0, 1, 1.0, "GACGA")], V_FREQ)
    sites = spark.createDataFrame([("c", 10), ("c", 20)], "chrom string, pos long")
    out = {r.pos: (r.strand, r.met, r.coverage, r.k_mer) for r in frequency.combine_strands(f, sites).collect()}
    assert out == {10: ("+", 2, 3, "AACGT"), 20: ("+", 1, 1, "-")}
    assert [r.pos for r in frequency.off_sites(f, sites).collect()] == [29]


V_FREQ = "chrom string, pos long, strand string, pos_in_strand long, prob_0_sum double, prob_1_sum double, met long, unmet long, coverage long, rmet double, k_mer string"


def test_evaluation(spark):
    rows = [("0.1", "0.9", 1, True), ("0.8", "0.2", 0, True), ("0.3", "0.7", 1, False), ("0.9", "0.1", 0, False)]
    c = spark.createDataFrame(rows, "a string, b string, called_label int, truth boolean").select(F.col("a").cast("decimal(7,6)").alias("prob_0"), F.col("b").cast("decimal(7,6)").alias("prob_1"), "called_label", "truth")
    q = evaluate.confusion(c).first()
    assert (q.tp, q.fp, q.tn, q.fn, q.accuracy, q.recall) == (1, 1, 1, 1, 0.5, 0.5)
    assert evaluate.auroc(c).first().auc == 0.75 and evaluate.auroc(c.filter("truth")).first().auc == 0
    sweep = {round(r.prob_cf, 3): r for r in evaluate.threshold_sweep(c).collect()}
    assert len(sweep) == 28 and max(sweep) == 0.675 and (sweep[0.0].called_num, sweep[0.0].correct) == (4, 2)
    assert (sweep[0.675].called_num, sweep[0.675].correct) == (2, 2)
    assert evaluate.confusion(c.limit(0)).first().accuracy == 0


def test_annotation(spark):
    gff = spark.createDataFrame([("c", "s", "mRNA", 101, 200, ".", "-", ".", "ID=transcript:T1;Parent=gene:G"), ("c", "s", "exon", 101, 103, ".", "-", ".", "Parent=transcript:T1;rank=2;Name=a;Name=b=c;"), ("c", "s", "exon", 150, 151, ".", "-", ".", "Parent=transcript:T1;rank=1")], text.schemas.GFF)
    g = annotation.annotate(gff)
    e = g.filter("rank = 2").first()
    assert (e.start, e.end, e.attrs["Name"], e.parent) == (100, 103, "b", "T1")
    assert [r.pos for r in annotation.transcript_coordinates(g).orderBy("at").collect()] == [150, 149, 102, 101, 100]
    assert annotation.transcript_lengths(g).first().length == 5


def test_neural_scores_do_not_depend_on_batches(spark):
    rows = extract.features(V.signals(spark, D), ["C"], k=5, width=6)
    model = score.BiLSTM.random(1, 5, 6, 8)
    a, b = ({(r.readname, r.pos): r.prob_1 for r in score.neural(rows, model, n).collect()} for n in (512, 3))
    assert a.keys() == b.keys() and a and all(math.isclose(a[k], b[k], abs_tol=2e-6) for k in a)
    assert {c for r in score.neural(rows, model).collect() for c in [r.called_label]} <= {0, 1}


def test_network_against_plain_loops():
    """One layer a branch and two joined, over three bases, by loops over units, steps and gates."""
    model = score.BiLSTM.random(5, 3, 4, 6, joined_layers=2)
    w, sig = model.weights, lambda x: 1 / (1 + math.exp(-x))
    rng = np.random.default_rng(2)
    bases, means, stds, lens, signals = rng.integers(0, 5, (1, 3)), rng.normal(size=(1, 3)), rng.random((1, 3)), rng.integers(1, 9, (1, 3)), rng.normal(size=(1, 3, 4))
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b, strict=True))

    def lstm(xs, name, layers):
        for layer in range(layers):
            ways = []
            for way, steps in (("", xs), ("_reverse", xs[::-1])):
                wi, wh, b = (w[f"{name}.{k}_l{layer}{way}"] for k in ("weight_ih", "weight_hh", "bias"))
                n = len(b) // 4
                h, c, out = [0.0] * n, [0.0] * n, []
                for x in steps:
                    gate = [dot(wi[r], x) + dot(wh[r], h) + float(b[r]) for r in range(4 * n)]
                    c = [sig(gate[n + u]) * c[u] + sig(gate[u]) * math.tanh(gate[2 * n + u]) for u in range(n)]
                    h = [sig(gate[3 * n + u]) * math.tanh(c[u]) for u in range(n)]
                    out.append(h)
                ways.append(out if not way else out[::-1])
            xs = [f + r for f, r in zip(*ways, strict=True)]
        return xs

    linear = lambda x, name: [dot(row, x) + float(b) for row, b in zip(w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]
    relu = lambda x: [max(0.0, v) for v in x]
    seq = [[*w["embed"][bases[0, t]], means[0, t], stds[0, t], lens[0, t]] for t in range(3)]
    joined = [a + b for a, b in zip(*([relu(linear(x, f"{name}_fc")) for x in lstm(xs, name, 1)] for name, xs in (("seq", seq), ("signal", [list(x) for x in signals[0]]))), strict=True)]
    last = lstm(joined, "joined", 2)
    n = len(last[0]) // 2
    top = linear(relu(linear(last[2][:n] + last[0][n:], "fc1")), "fc2")
    want = [math.exp(x) / sum(map(math.exp, top)) for x in top]
    assert np.allclose(model(bases, means, stds, lens, signals)[0], want, atol=1e-5)


def test_unknown_bases_count_as_n(spark):
    rows = extract.features(V.signals(spark, D), ["C"], k=5, width=6).limit(5)
    model = score.BiLSTM.random(1, 5, 6, 8)
    scores = lambda k: sorted(r.prob_1 for r in score.neural(rows.withColumn("k_mer", F.lit(k)), model).collect())
    assert scores("acnxT") == scores("ACNNT") and len(scores("ACNNT")) == 5


def test_headers_of_positions(spark, tmp_path):
    """Each file's header is left out, and nothing else, however the files are split."""
    for k in range(6):
        (tmp_path / f"{k}.txt").write_text("chrom\tpos\tstrand\n" + "".join(f"chr{k}\t{i}\t+\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = text.positions(spark, str(tmp_path), header=True)
        assert found.count() == 18_000 and found.filter("pos is null or chrom = 'chrom'").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_names_and_annotation_are_written(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">b one\nAC\n>a\nGG\n")
    sinks.contig_names(text.contig_names(spark, f"{tmp_path}/x.fa"), f"{tmp_path}/names")
    assert [r.value for r in spark.read.text(f"{tmp_path}/names").collect()] == ["a", "b"]
    (tmp_path / "x.gff3").write_text("##gff-version 3\nchr1\tmade\tgene\t5\t9\t.\t+\t.\tID=gene:g1;Name=n\n")
    rows = text.gff3(spark, f"{tmp_path}/x.gff3")
    sinks.annotation(rows, f"{tmp_path}/out")
    again = text.gff3(spark, f"{tmp_path}/out")
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in rows.collect()] and rows.first().start == 4


def test_select_like_fills_up(spark):
    pos = spark.createDataFrame([(i, "A" if i < 6 else "B") for i in range(10)], "idx int, k_mer string")
    neg = spark.createDataFrame([(i, "A" if i < 3 else "C" if i < 20 else "B") for i in range(40)], "idx int, k_mer string")
    n = {r.k_mer: r["count"] for r in samples.select_like(pos, neg).groupBy("k_mer").count().collect()}
    assert n == {"A": 3, "B": 4, "C": 3}


def test_denoise(spark):
    kept = denoise.denoise(V.samples(spark, D), score.Fixed("prob_1"), 2, 1, 0.75, 0.99)
    assert kept.filter("methy_label = 1 and prob_1 < 0.75").isEmpty()


def shuffled(df):
    """How many rows go through each exchange of a plan once it has run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        todo += inner + [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_select_like_shuffles_few_rows(spark):
    """Only rows of the bucket in which a quota ends are ranked; the choice is that of ranks over all rows."""
    pos = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(1000)], "idx int, k_mer string")
    neg = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(4000)], "idx int, k_mer string")
    picked = samples.select_like(pos, neg, 7)
    first = neg.withColumn("r", F.row_number().over(Window.partitionBy("k_mer").orderBy(samples.chance(7, "idx"), "idx"))).filter("r <= 500")
    assert sorted(r.idx for r in picked.collect()) == sorted(r.idx for r in first.collect())
    assert sum(shuffled(picked)) < 100


def test_denoise_makes_what_is_given_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score_of(i):
        made.add(1)
        return i % 10 / 10

    given = spark.range(200).select(F.col("id").alias("idx"), F.lit("A").alias("k_mer"), (F.col("id") % 2).cast("int").alias("methy_label"), score_of("id").alias("prob_1"))
    kept = denoise.denoise(given, score.Fixed("prob_1"), 2, 1, 0.5, 0.99)
    assert kept.filter("methy_label = 1").count() == 60 and kept.filter("methy_label = 0").count() == 60 and made.value == 200


def test_files_round_trip(spark, tmp_path):
    f = extract.features(V.signals(spark, D), ["C"], k=3, width=4)
    sinks.features(f, f"{tmp_path}/features", gzip=True)
    back = text.features(spark, f"{tmp_path}/features")
    assert back.count() == f.count() and back.dtypes == f.dtypes
    (tmp_path / "g.fa").write_text(">one first\nacg\nTT\n>two\n\n>three >x\nNN\n")
    assert [(r.name, r.seq) for r in text.fasta(spark, f"{tmp_path}/g.fa").orderBy("name").collect()] == [("one", "ACGTT"), ("three", "NN")]
    assert [r.name for r in text.contig_names(spark, f"{tmp_path}/g.fa").collect()] == ["one", "two", "three"]
    assert [r.name for r in text.contig_names(spark, "b,a,b").collect()] == ["a", "b"]
    (tmp_path / "p.txt").write_text("c 7 +\nc 7 +\n")
    assert [tuple(r) for r in text.positions(spark, f"{tmp_path}/p.txt").collect()] == [("c", 7, "+")]
    (tmp_path / "bad.txt").write_text("c 7\n")
    with pytest.raises(Exception, match="fewer"):
        text.positions(spark, f"{tmp_path}/bad.txt").collect()
    fr = frequency.site_frequency(V.calls(spark, D), V.ORDER)
    sinks.frequencies(fr, f"{tmp_path}/freq", sort=True)
    assert text.frequencies(spark, f"{tmp_path}/freq").count() == fr.count()


def test_streaming(spark, tmp_path):
    from strandwise.streaming import frequency as stream

    c = V.calls(spark, D)
    sinks.tsv(c.select(*text.schemas.names(text.schemas.CALLS)), f"{tmp_path}/calls")
    q = stream.run(stream.read_calls(spark, f"{tmp_path}/calls", 1), f"{tmp_path}/out", f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    a = stream.latest(spark, f"{tmp_path}/out").select("chrom", "pos", "met", "coverage")
    b = frequency.site_frequency(c, V.ORDER).select("chrom", "pos", "met", "coverage")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_all_sites_are_sorted(spark):
    d = "/root/testdata/sf0.001"
    found = [(r.chrom, r.pos, r.strand, r.n) for r in QUERIES["q_sites_sorted"](spark, d).collect()]
    assert len(found) == QUERIES["q_call_freq"](spark, d).count() > 10
    assert [x[:3] for x in found] == sorted(x[:3] for x in found) and [x[3] for x in found] == list(range(1, len(found) + 1))


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_sample_by_buckets_takes_the_same_rows(spark, n):
    rows = spark.range(1000).select(F.col("id").alias("idx"))
    few, many = samples.sample(rows, n, 5), samples.sample(rows, n, 5, few=-1)
    assert sorted(r.idx for r in many.collect()) == sorted(r.idx for r in few.collect()) and many.columns == ["idx"]


def test_read_runs_go_on_over_pieces(spark):
    data = [(f, i, (None, "a", "b", "c")[(i * i // 50 + i // 90) % 4]) for f, m in (("x", 400), ("y", 1), ("z", 57)) for i in range(m)]
    data += [(None, i, "a") for i in range(30)]
    rows = spark.createDataFrame(data, "file string, at long, readname string").repartition(7)
    want, last = {}, {}
    for f, i, name in data:
        run, before = last.get(f, (-1, object()))
        run += before != name
        last[f], want[f, i] = (run, name), (run, run // 3)
    got = samples.read_runs(rows, 3, ["at"], "file")
    assert got.columns == ["file", "at", "readname", "run", "batch"]
    assert {(r.file, r.at): (r.run, r.batch) for r in got.collect()} == want


def test_auroc_of_any_scores(spark):
    rng = np.random.default_rng(3)
    scores = [*rng.random(150).tolist(), *[0.0, 0.25, 0.25, 0.25, 0.2500001, 1.0, 1.0] * 3]
    data = [(s, bool(rng.integers(2))) for s in scores]
    p, q = [s for s, t in data if t], [s for s, t in data if not t]
    want = sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q))
    assert math.isclose(evaluate.auroc(spark.createDataFrame(data, "prob_1 double, truth boolean")).first().auc, want)
    assert evaluate.auroc(spark.createDataFrame([(0.5, True)], "prob_1 double, truth boolean")).first().auc == 0


def test_trained_scorers(spark):
    """On D, wrongly labelled positives score below half, so the kept positives are those of high prob_1."""
    best = QUERIES["q_train_linear"](spark, D).first()
    assert best.n > 500 and best.accuracy > 0.7 and best.recall > 0.75
    rows = V.samples(spark, D).withColumn("methy_label", ((F.col("methy_label") == 1) | F.col("truth")).cast("int")).withColumn("m", F.col("prob_1").cast("double"))
    kept = rows.join(denoise.clean(rows, denoise.statistics(denoise.rounds(rows, score.Linear(("m",)), 3))), "idx", "left_semi")
    limits = kept.agg(F.min("m").alias("low"), F.min("methy_label").alias("label")).first()
    assert limits.label == 1 and 0.2 < limits.low <= 0.5 and kept.count() < rows.filter("methy_label = 1").count()
