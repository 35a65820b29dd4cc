"""Training samples: filters, seeded sampling, balancing by k-mer. Rows carry a unique line number `idx`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Rows are dealt to 16 to this power buckets by the first digits of their chance.
DIGITS = 3


def chance(seed: int, *keys: str) -> Column:
    """A value that orders rows at random, the same in each run and engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def with_label(rows: DataFrame, label: int) -> DataFrame:
    return rows.filter(F.col("methy_label") == label)


def at_positions(rows: DataFrame, positions: DataFrame, label: int | None = None) -> DataFrame:
    """Rows at the positions (chrom, pos as text); they may be given another label."""
    wanted = positions.select("chrom", F.col("pos").cast("string").alias("_p")).distinct()
    kept = rows.withColumn("_p", F.col("pos").cast("string")).join(wanted, ["chrom", "_p"], "left_semi").drop("_p")
    return kept if label is None else kept.withColumn("methy_label", F.lit(label))


def sample(rows: DataFrame, n: int, seed: int = 0, key: str = "idx", few: int = 100_000) -> DataFrame:
    """n rows (all, if there are fewer): those of the least chance.

    Up to `few`, Spark keeps the best n of each task and merges those. More are taken by whole buckets of the chance's first five
    digits, counted first, and only the bucket in which the last row lies is sorted; so no task holds n rows.
    """
    if n <= few:
        return rows.orderBy(chance(seed, key), key).limit(n)
    rows = rows.withColumn("_b", F.conv(F.substring(chance(seed, key), 1, 5), 16, 10).cast("int"))
    upto = F.sum("m").over(Window.orderBy("_b"))  # a row a bucket, 16 ** 5 at most
    last = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", upto).filter(F.col("upto") >= n).orderBy("_b").first()
    if last is None:
        return rows.drop("_b")
    edge = rows.filter(F.col("_b") == last["_b"]).orderBy(chance(seed, key), key).limit(n - last.upto + last.m)
    return rows.filter(F.col("_b") < last["_b"]).unionByName(edge).drop("_b")


def complement(rows: DataFrame, picked: DataFrame, key: str = "idx") -> DataFrame:
    return rows.join(picked.select(key), key, "left_anti")


def shuffle(rows: DataFrame, seed: int = 0, key: str = "idx") -> DataFrame:
    """The rows in random order."""
    return in_order(mixed_order([rows], seed, key)).drop("part", "position")


def concat_shuffled(a: DataFrame, b: DataFrame, seed: int = 0, key: str = "idx") -> DataFrame:
    """The rows of both in one random order, in proportion everywhere; `part` tells where a row is from."""
    return in_order(mixed_order([a, b], seed, key)).drop("position")


def mixed_order(parts: Sequence[DataFrame], seed: int = 0, key: str = "idx", stretch: int = 1000) -> DataFrame:
    """The rows of all parts with `part` and their `position` (from 0) in an order in which every stretch has its share of each part.

    In two passes: rows of a part are ranked at random and cut into as many buckets as there are stretches of about `stretch` rows, so a bucket has
    each part in proportion to its size, to a row; within a bucket all are ranked at random. Ranks in a part come from counts of the first digits of a
    row's chance, and rows before a bucket from the parts' sizes, so no pass sorts more than a bucket or the rows of one value of the digits.
    """
    rows = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    rows = rows.withColumn("_c", chance(seed, "part", key)).withColumn("_b", F.conv(F.substring("_c", 1, 4), 16, 10).cast("int"))
    counts = written(rows.groupBy("part", "_b").agg(F.count(F.lit(1)).alias("_m")), "mixed-counts")
    sizes = {r.part: r.n for r in counts.groupBy("part").agg(F.sum("_m").alias("n")).collect()}  # a row a part
    total = sum(sizes.values())
    buckets = max(1, min(1 << 20, -(-total // stretch)))
    upto = F.sum("_m").over(Window.partitionBy("part").orderBy("_b")) - F.col("_m")  # a row a value of four digits
    rank = F.col("_upto") + F.row_number().over(Window.partitionBy("part", "_b").orderBy("_c", key)) - 1
    size = reduce(lambda found, x: F.when(F.col("part") == x[0], F.lit(x[1]).cast("long")).otherwise(found), sizes.items(), F.lit(1).cast("long"))
    ranked = rows.join(counts.select("part", "_b", upto.alias("_upto")), ["part", "_b"]).withColumn("_rank", rank).withColumn("_size", size)
    ranked = ranked.withColumn("_bucket", F.expr(f"_rank * {buckets} div _size"))
    before = F.expr(" + ".join([f"(_bucket * {n}L + {buckets - 1}) div {buckets}" for n in sizes.values()]) or "0L")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(chance(seed + 1, "part", key), "part", key)) - 1
    return ranked.withColumn("position", before + inside).drop("_c", "_b", "_upto", "_rank", "_size", "_bucket")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows in files, or tasks, by their position."""
    return rows.repartitionByRange("position").sortWithinPartitions("position")


def first_n(rows: DataFrame, by: str, n: int, seed: int = 0, key: str = "idx") -> DataFrame:
    """n random rows of each class.

    A class's rows are counted by the first four digits of their chance, which tells the digits that its n-th row has; only rows up to those
    are shuffled and ranked, so a task gets little more than n rows of a class, however many it has.
    """
    digits = F.substring(chance(seed, key), 1, 4)
    before = F.sum("_m").over(Window.partitionBy("_by").orderBy("_digits")) - F.col("_m")  # a row a value of four digits
    counts = rows.groupBy(F.col(by).alias("_by"), digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_m"))
    last = counts.withColumn("_before", before).filter(F.col("_before") < n).groupBy("_by").agg(F.max("_digits").alias("_last"))
    last = written(last, "first-n")  # a row a class, small enough to be sent to each task
    near = rows.join(last, F.col(by).eqNullSafe(F.col("_by"))).filter(digits <= F.col("_last")).drop("_by", "_last")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(chance(seed, key), key))
    return near.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def kmer_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k_mer").agg(F.count(F.lit(1)).alias("n"))


def kmer_ratios(rows: DataFrame) -> DataFrame:
    """k_mer, n, and its share of all rows. The window is over k-mers, which are few and fixed in number."""
    total = F.sum("n").over(Window.partitionBy())
    return kmer_counts(rows).withColumn("total", total).withColumn("ratio", F.col("n").cast("double") / F.col("total"))


def kmer_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many k-mers both have, and how many either alone."""
    both = a.select("k_mer").distinct().withColumn("a", F.lit(True)).join(b.select("k_mer").distinct().withColumn("b", F.lit(True)), "k_mer", "full")
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def _bucket(seed: int) -> Column:
    return F.substring(chance(seed, "idx"), 1, DIGITS)


def select_like(positive: DataFrame, negative: DataFrame, seed: int = 0) -> DataFrame:
    """Negative rows whose k-mers are spread as the positive ones'.

    Of a k-mer that positives have, ceil(total * ratio) rows; if these are fewer than the positives, the rest is shared
    evenly among the other k-mers; what still lacks comes from the rows that are left. Quotas come from counts of k-mers, so
    the three steps are one ranking within k-mers and one choice among what is left. Counts of a k-mer's buckets tell the one in
    which its quota ends: those before are taken whole, those after are not, and only that one's rows are shuffled and ranked.
    """
    ratios = written(kmer_ratios(positive).select("k_mer", "n", "ratio"), "ratios")
    total = ratios.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = written(negative.groupBy("k_mer", _bucket(seed).alias("_b")).agg(F.count(F.lit(1)).alias("m")), "buckets")
    have = buckets.groupBy("k_mer").agg(F.sum("m").alias("n")).join(ratios.select("k_mer", "ratio"), "k_mer", "left")
    have = written(have.withColumn("_quota", F.when(F.col("ratio").isNotNull(), F.ceil(F.lit(total) * F.col("ratio")))), "quotas")
    sums = have.agg(F.coalesce(F.sum(F.when(F.col("_quota").isNotNull(), F.least("_quota", "n"))), F.lit(0)).alias("got"), F.count_if(F.col("_quota").isNull()).alias("others")).first()
    lack = total - sums.got
    share = -(-lack // sums.others) if lack > 0 and sums.others else 0
    quotas = have.select("k_mer", F.coalesce(F.col("_quota"), F.lit(share)).cast("long").alias("_quota"))
    upto = F.sum("m").over(Window.partitionBy("k_mer").orderBy("_b"))  # 16 ** DIGITS rows a k-mer at most
    ends = buckets.withColumn("_upto", upto).join(quotas, "k_mer").filter(F.col("_upto") >= F.col("_quota"))
    ends = ends.groupBy("k_mer").agg(F.min("_b").alias("_end"), F.min_by(F.col("_quota") - F.col("_upto") + F.col("m"), "_b").alias("_of_end"))
    ends = quotas.join(ends, "k_mer", "left").select("k_mer", F.coalesce("_end", F.lit("g")).alias("_end"), "_of_end")  # g comes after all digits: all are taken
    placed = negative.withColumn("_b", _bucket(seed)).join(written(ends, "ends"), "k_mer")
    rank = F.row_number().over(Window.partitionBy("k_mer").orderBy(chance(seed, "idx"), "idx"))
    last = placed.filter(F.col("_b") == F.col("_end")).withColumn("_r", rank)
    own = ("_b", "_end", "_of_end", "_r")
    picked = placed.filter(F.col("_b") < F.col("_end")).drop(*own).unionByName(last.filter(F.col("_r") <= F.col("_of_end")).drop(*own))
    # Rows of other k-mers are in the pool only if a share of theirs was taken.
    taken = have.select(F.sum(F.least(F.coalesce(F.col("_quota"), F.lit(share)), F.col("n")))).first()[0] or 0
    if taken >= total:
        return picked
    left = placed.filter(F.col("_b") > F.col("_end")).drop(*own).unionByName(last.filter(F.col("_r") > F.col("_of_end")).drop(*own))
    pool = left.join(have.filter(F.col("_quota").isNotNull() | F.lit(share > 0)).select("k_mer"), "k_mer", "left_semi")
    return picked.unionByName(sample(pool, int(total - taken), seed + 1))


def read_runs(rows: DataFrame, reads: int, order: list[str], within: str) -> DataFrame:
    """Number the runs of consecutive rows of one read, and batches of so many runs, within each `within` (a file).

    Rows are range-partitioned by file and order. Runs are numbered within each piece; then, from one row a piece, come the runs
    before it, less one where a run goes on from the piece before.
    """
    pieces = written(rows.repartitionByRange(within, *order).withColumn("_p", F.spark_partition_id()), "pieces")
    w = Window.partitionBy(within, "_p").orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.lag("readname").over(w).eqNullSafe(F.col("readname")), 0).otherwise(1)
    runs = pieces.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    ends = runs.groupBy(within, "_p").agg(F.max("_run").alias("n"), F.min_by(F.struct("readname"), place).alias("first"), F.max_by(F.struct("readname"), place).alias("last"))
    files = Window.partitionBy(within).orderBy("_p")  # a row a piece
    ends = ends.withColumn("on", F.lag("last").over(files).eqNullSafe(F.col("first")).cast("int"))
    net = F.col("n") - F.col("on")
    ends = ends.select(F.col(within).alias("_w"), F.col("_p").alias("_q"), (F.sum(net).over(files) - F.col("n")).alias("_before"))
    at = runs[within].eqNullSafe(ends["_w"]) & (runs["_p"] == ends["_q"])
    numbered = runs.join(ends, at).withColumn("run", F.col("_run") + F.col("_before") - 1)
    return numbered.drop("_new", "_run", "_before", "_p", "_w", "_q").withColumn("batch", F.floor(F.col("run") / reads))
