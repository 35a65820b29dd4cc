"""Commands: `python -m strandwise.cli COMMAND --help`."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import parse_motifs, scan_tiles
from .operators import denoise, evaluate, frequency, motifs, network, samples, score, tables
from .operators.annotation import transcript_coordinates, transcript_map
from .operators.extract import Region, features
from .sources import raw, sinks, text


def yes(value: str) -> bool:
    return value.strip().lower() in ("yes", "true", "t", "1")


def _reads(spark, a):
    return raw.reads(spark, a.reads, a.recursive, a.corrected_group, a.basecall_subgroup) if a.raw else text.reads(spark, a.reads)


def _features(spark, a, counts=None):
    contigs = text.fasta_lengths(text.fasta_lines(spark, a.reference)) if a.reference else None
    positions = text.positions(spark, a.positions) if a.positions else None
    return features(_reads(spark, a), parse_motifs(a.motifs, rna=not a.dna), contigs, positions, Region.parse(a.region), a.offset, a.k, a.width, a.label, a.method, counts=counts)


def _reported(spark, a, write) -> None:
    """Write what is made of reads; --report then tells of reads and failures, counted as they were read."""
    counts = Observation("reads") if a.report else None
    write(counts)
    if counts is not None:
        sinks.evaluation(spark.createDataFrame([counts.get]), a.report)


def extract(spark, a):
    _reported(spark, a, lambda counts: sinks.features(_features(spark, a, counts), a.out, a.gzip, rows_a_file=a.rows_a_file))


def call(spark, a):
    """Features are read, or made of reads and scored at once, without a file between."""
    model = score.BiLSTM(score.load_weights(spark, a.model), **_shape(a))
    write = lambda rows: sinks.calls(score.neural(rows, model, a.batch), a.out, a.gzip)
    if a.features:
        write(text.features(spark, a.features))
    else:
        _reported(spark, a, lambda counts: write(_features(spark, a, counts)))


def freq(spark, a):
    rows = text.calls(spark, a.calls, a.contains)
    contigs = text.contig_names(spark, a.contigs) if a.contigs else None
    sinks.frequencies(frequency.site_frequency(rows, ["line"], a.prob_cf, contigs), a.out, a.bed, a.sort, a.gzip)


def combine(spark, a):
    sinks.frequencies(frequency.combine([text.frequencies(spark, p) for p in a.freq], ["line"]), a.out, a.bed, a.sort, a.gzip)


def strands(spark, a):
    sites = scan_tiles(text.fasta_tiles(text.fasta_lines(spark, a.reference), 0, 1), ["CG"]).withColumnRenamed("name", "chrom")
    if a.bed:
        sinks.tsv(frequency.combine_strands_bed(text.bed(spark, a.freq), sites).orderBy("chrom", "start"), a.out)
    else:
        sinks.frequencies(frequency.combine_strands(text.frequencies(spark, a.freq), sites), a.out, sort=True, plain=True)


def bed(spark, a):
    sinks.tsv(frequency.frequency_file_to_bed(text.frequencies(spark, a.freq), ["line"], a.min_coverage), a.out)


def split(spark, a):
    rows = text.calls(spark, a.rows).drop("line") if a.calls else text.frequencies(spark, a.rows).drop("line")
    tiles = text.fasta_tiles(text.fasta_lines(spark, a.reference), 2, 2, size := 1 << 18) if a.reference else None
    marked = motifs.classify(rows) if tiles is None else motifs.classify_by_reference(rows, motifs.sites_of_tiles(tiles, size))
    motifs.split(marked, a.out)


def quality(spark, a):
    rows = evaluate.labelled(text.calls(spark, a.methylated).withColumnRenamed("line", "idx"), text.calls(spark, a.unmethylated).withColumnRenamed("line", "idx"), a.sites)
    whole = evaluate.confusion(rows).crossJoin(evaluate.auroc(rows))  # a row each
    sinks.evaluation(evaluate.threshold_sweep(rows).drop("total_num").crossJoin(whole).orderBy("prob_cf"), a.out)


def sample(spark, a):
    """Random lines of files, and the others, by their numbers."""
    rows = text.lines(spark, a.rows)
    picked = samples.sample(rows, a.n, a.seed, "line")
    picked.select("value").write.text(a.out)
    if a.rest:
        text.without_lines(rows, picked).select("value").write.text(a.rest)


def lines(spark, a):
    """The lines that have the numbers given (from 0)."""
    rows = text.lines(spark, a.rows)
    wanted = spark.read.schema("at long").csv(a.numbers)
    rows.filter("value is not null").join(wanted.distinct(), rows.line["at"] == wanted["at"], "left_semi").select("value").write.text(a.out)


def by_label(spark, a):
    sinks.features(samples.with_label(text.features(spark, a.features), a.label), a.out)


def by_positions(spark, a):
    sinks.features(samples.at_positions(text.features(spark, a.features), text.positions(spark, a.positions, 2, a.header), a.label), a.out)


def shuffle(spark, a):
    """The lines of one or more files in random order, in proportion everywhere."""
    parts = [text.lines(spark, path).withColumn("idx", F.to_json("line")) for path in a.rows]
    samples.in_order(samples.mixed_order(parts, a.seed, stretch=a.stretch)).select("value").write.text(a.out)


def contigs(spark, a):
    sinks.contig_names(text.contig_names(spark, a.reference), a.out)


def annotation(spark, a):
    rows = text.gff3(spark, a.gff)
    sinks.annotation(rows.filter(F.col("feature").isin(a.features.split(","))) if a.features else rows, a.out)


def transcripts(spark, a):
    """Where each exon of each transcript lies in the genome and in the transcript; a row a base, if asked for."""
    rows = text.gff3(spark, a.gff)
    (transcript_coordinates(rows) if a.bases else transcript_map(rows)).write.parquet(a.out)


def _shape(a) -> dict:
    return dict(branch_layers=a.branch_layers, joined_layers=a.joined_layers, hidden=a.hidden, module=a.module, use_base=a.base, use_length=a.length)


def _network(spark, a) -> score.BiLSTM:
    """A network with random weights; those of --init_model, if given, take their places."""
    model = score.BiLSTM.random(a.seed, a.k, a.width, **_shape(a))
    return model if not a.init_model else replace(model, weights=network.updated(model.weights, score.load_weights(spark, a.init_model)))


def _numbered(spark, path):
    """Samples with the numbers of their lines; files' names tell the lines of several files apart."""
    return text.features(spark, path, with_lines=True).withColumn("idx", F.to_json("line")).drop("line")


def train(spark, a):
    """Train the network; a run that was stopped goes on from its log under --out, and the best network is --out/best."""
    rows = _numbered(spark, a.features)
    schedule = network.Schedule(a.epochs, a.least_epochs, a.batch, a.rate, a.decay, a.decay_every, a.clip, a.pos_weight, a.optimiser, a.dropout, workers=a.workers, syncs=a.syncs, seed=a.seed)
    model, log = network.fit(rows, _network(spark, a), schedule, text.features(spark, a.valid), a.out)
    score.save_weights(spark, model.weights, f"{a.out}/best")
    sinks.evaluation(spark.createDataFrame(log, network.LOG).orderBy("epoch"), f"{a.out}/report")


def clean(spark, a):
    rows = _numbered(spark, a.features)
    if a.scorer == "linear":
        given, scorer = rows.select("*", *(F.col("signal_means")[i].alias(f"m{i}") for i in range(a.k))), score.Linear(tuple(f"m{i}" for i in range(a.k)))
    else:
        schedule = network.Schedule(a.epochs, a.epochs, a.batch, a.rate, pos_weight=a.pos_weight, dropout=a.dropout, enough=0.95, workers=a.workers, syncs=a.syncs, seed=a.seed)
        given, scorer = rows, network.Network(_network(spark, a), schedule)
    path = a.state or tables.new_folder(spark, "denoise")
    kept = denoise.denoise(given, scorer, a.iterations, a.rounds, a.score_cf, a.kept_ratio, a.negatives, a.seed, report := [], path)
    if a.report:
        sinks.evaluation(spark.createDataFrame(report, denoise.LOG), a.report)
    if a.probabilities and report:
        sinks.probabilities(denoise.probabilities(spark, path), a.probabilities)
    sinks.features(kept.select(rows.columns).drop("idx"), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise")
    sub = top.add_subparsers(required=True)

    def command(run, help_: str, *args):
        p = sub.add_parser(run.__name__, help=help_)
        p.set_defaults(run=run)
        for name, kw in args:
            p.add_argument(name, **kw)
        p.add_argument("--out", required=True)

    need, flag = {"required": True}, {"type": yes, "default": False}
    reading = (
        ("--raw", flag), ("--corrected_group", {"default": "RawGenomeCorrected_000"}), ("--basecall_subgroup", {"default": "BaseCalled_template"}), ("--recursive", {"type": yes, "default": True}), ("--reference", {}), ("--positions", {}), ("--region", {}), ("--motifs", {"default": "CG"}), ("--offset", {"type": int, "default": 0}),
        ("--dna", {"type": yes, "default": True}), ("--k", {"type": int, "default": 13}), ("--width", {"type": int, "default": 16}), ("--label", {"type": int, "default": 1}), ("--method", {"default": "mad", "choices": ["mad", "zscore"]}), ("--report", {"help": "where counts of reads and failures go"}),
    )
    shape = (
        ("--branch_layers", {"type": int, "default": 1}), ("--joined_layers", {"type": int, "default": 3}), ("--hidden", {"type": int, "default": 256}),
        ("--module", {"default": "both", "choices": ["both", "seq", "signal"]}), ("--base", {"type": yes, "default": True}), ("--length", {"type": yes, "default": True}),
    )
    learning = (
        *shape, ("--k", {"type": int, "default": 13}), ("--width", {"type": int, "default": 16}), ("--init_model", {"help": "weights that take the places of random ones"}), ("--batch", {"type": int, "default": 512}), ("--rate", {"type": float, "default": 0.001}),
        ("--pos_weight", {"type": float, "default": 1.0}), ("--dropout", {"type": float, "default": 0.5}), ("--workers", {"type": int}), ("--syncs", {"type": int, "default": 1, "help": "how often an epoch averages the tasks' weights"}), ("--seed", {"type": int, "default": 0}),
    )
    command(extract, "features of sites from reads", ("--reads", need), *reading, ("--gzip", flag), ("--rows_a_file", {"type": int, "default": 0}))
    command(
        call, "calls from features or reads", ("--features", {}), ("--reads", {}), *reading, ("--model", need), *shape, ("--batch", {"type": int, "default": 512}), ("--gzip", flag),
    )
    command(
        train, "train a network", ("--features", need), ("--valid", need), *learning, ("--epochs", {"type": int, "default": 10}), ("--least_epochs", {"type": int, "default": 5}), ("--decay", {"type": float, "default": 0.1}),
        ("--decay_every", {"type": int, "default": 2}), ("--clip", {"type": float, "default": 0.5}), ("--optimiser", {"default": "adam", "choices": ["adam", "rmsprop", "sgd"]}),
    )
    command(by_label, "features of one label", ("--features", need), ("--label", need | {"type": int}))
    command(by_positions, "features at positions, with another label if given", ("--features", need), ("--positions", need), ("--header", flag), ("--label", {"type": int}))
    command(shuffle, "lines of files in random order", ("--rows", need | {"nargs": "+"}), ("--seed", {"type": int, "default": 0}), ("--stretch", {"type": int, "default": 1000, "help": "rows in which each file has its share"}))
    command(lines, "lines by their numbers", ("--rows", need), ("--numbers", need))
    command(transcripts, "coordinates of transcripts", ("--gff", need), ("--bases", flag))
    command(contigs, "names of contigs", ("--reference", need))
    command(annotation, "rows of an annotation as GFF3", ("--gff", need), ("--features", {}))
    command(freq, "frequencies of sites from calls", ("--calls", need | {"nargs": "+"}), ("--contains", {}), ("--contigs", {}), ("--prob_cf", {"type": float, "default": 0.5}), ("--bed", flag), ("--sort", flag), ("--gzip", flag))
    command(combine, "sum frequency files", ("--freq", need | {"nargs": "+"}), ("--bed", flag), ("--sort", flag), ("--gzip", flag))
    command(strands, "sum both strands of CG sites", ("--freq", need), ("--reference", need), ("--bed", flag))
    command(bed, "bedMethyl from frequencies", ("--freq", need), ("--min_coverage", {"type": int, "default": 1}))
    command(split, "rows by motif", ("--rows", need), ("--calls", flag), ("--reference", {}))
    command(quality, "evaluate calls", ("--methylated", need | {"nargs": "+"}), ("--unmethylated", need | {"nargs": "+"}), ("--sites", {"type": int, "default": 100_000}))
    command(sample, "random lines", ("--rows", need), ("--n", need | {"type": int}), ("--seed", {"type": int, "default": 0}), ("--rest", {}))
    command(
        clean, "denoise training samples", ("--features", need), *learning, ("--scorer", {"default": "network", "choices": ["network", "linear"]}), ("--epochs", {"type": int, "default": 3}), ("--iterations", {"type": int, "default": 10}), ("--rounds", {"type": int, "default": 3}),
        ("--score_cf", {"type": float, "default": 0.5}), ("--kept_ratio", {"type": float, "default": 0.99}), ("--negatives", flag), ("--report", {}), ("--probabilities", {"help": "where the first iteration's mean probabilities go"}), ("--state", {"help": "a folder from which a stopped run goes on"}),
    )
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("strandwise").getOrCreate(), a)


if __name__ == "__main__":
    main()
