"""Prefix tries of conversations by burst tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, save

NODE = "head string, depth long, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()
ROOT = "root"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0, in the order of turn, null first; ties by the turn's digest), t (SHA-256 of role and text), n (code points of text).

    Ranks come from a range partitioning by conversation and turn, so a conversation of any length is numbered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("t"), F.length(text).cast("long").alias("n"))
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "trie-rows")
    order = [F.asc_nulls_first("turn"), F.col("t"), F.col("row")]
    dealt = save(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-order")
    return running(dealt, ["conv_id"], "part", order, F.lit(1).cast("long"), "at", "size").select("conv_id", "at", "t", "n")


def rebuild(turns: DataFrame, period: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one: the first h turns of conversation c - c % period, then c's own after its first h.

    h is crc32 of the decimal c modulo `most`. Returns turns (conv_id, at, t, n), and every conversation with its size.
    """
    turns = save(turns, "trie-turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % period
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    bases = sizes.filter(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    plan = sizes.withColumns({"base": base, "h": h}).join(bases, "base", "left").withColumn("there", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    plan = save(plan, "trie-plan")
    heads = turns.filter((F.col("conv_id") % period == 0) & (F.col("at") < most)).select(F.col("conv_id").alias("base"), "at", "t", "n")
    first = plan.select("conv_id", "base", "h").join(heads, "base").filter("at < h").select("conv_id", "at", "t", "n")
    rest = turns.withColumn("h", h).filter("at >= h").join(plan.select("conv_id", "there"), "conv_id").select("conv_id", (F.col("at") - F.col("h") + F.col("there")).alias("at"), "t", "n")
    return first.unionByName(rest), plan.select("conv_id", (F.col("there") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))


def stretches(turns: DataFrame, sizes: DataFrame, length: int) -> DataFrame:
    """Conversations cut after every `length` turns: conv_id, s (the cut's number), ts, ns, digest, ended, head and next_head.

    The head of stretch s stands for all turns before it. It is the digest of a few digests: those of the runs of 1, 2, 4, .. stretches
    which s is the sum of; so prefixes of a conversation of any length are found in a few steps and no row grows with it.
    """
    cut = turns.groupBy("conv_id", F.expr(f"at div {length}").alias("s")).agg(F.array_sort(F.collect_list(F.struct("at", "t", "n"))).alias("x"))
    cut = cut.select("conv_id", "s", F.col("x.t").alias("ts"), F.col("x.n").alias("ns"))
    none = F.array().cast("array<string>"), F.array().cast("array<long>")
    last = F.greatest(F.expr(f"(size - 1) div {length}"), F.lit(0)).cast("long")
    rows = sizes.filter("size > 0").join(cut, "conv_id").unionByName(sizes.filter("size = 0").select("conv_id", "size", F.lit(0).cast("long").alias("s"), none[0].alias("ts"), none[1].alias("ns")))
    rows = save(rows.select("conv_id", "s", "ts", "ns", F.sha2(F.array_join("ts", ""), 256).alias("digest"), (F.col("s") == last).alias("ended")), "trie-stretches")
    most = rows.agg(F.max("s")).first()[0]
    if not most:
        return rows.withColumns({"head": F.lit(ROOT), "next_head": F.lit(None).cast("string")})
    level = save(rows.filter("not ended or s > 0").select("conv_id", F.col("s").alias("i"), "digest"), "trie-runs")
    runs = level.withColumn("level", F.lit(0))
    k = 0
    while most >> (k + 1):
        k += 1
        both = F.array_sort(F.collect_list(F.struct("i", "digest")))
        level = save(level.groupBy("conv_id", F.expr("i div 2").alias("i")).agg(both.alias("x")).filter("size(x) = 2").select("conv_id", "i", F.sha2(F.array_join("x.digest", ""), 256).alias("digest")), "trie-runs")
        runs = runs.unionByName(level.withColumn("level", F.lit(k)))
    bits = F.filter(F.sequence(F.lit(0), F.lit(k)), lambda b: F.expr("s").bitwiseAND(F.pow(F.lit(2), b).cast("long")) > 0)
    parts = rows.filter("s > 0").select("conv_id", "s", F.explode(bits).alias("level")).withColumn("i", (F.col("s") / F.pow(F.lit(2), F.col("level"))).cast("long") - 1)
    heads = parts.join(runs, ["conv_id", "level", "i"]).groupBy("conv_id", "s").agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("x"))
    heads = save(heads.select("conv_id", "s", F.sha2(F.concat_ws("/", F.col("s").cast("string"), F.array_join("x.digest", "")), 256).alias("head")), "trie-heads")
    tall = rows.filter("s > 0 or not ended").join(heads, ["conv_id", "s"], "left").withColumn("head", F.coalesce("head", F.lit(ROOT)))
    tall = tall.join(heads.select("conv_id", (F.col("s") - 1).alias("s"), F.col("head").alias("next_head")), ["conv_id", "s"], "left")
    return rows.filter("s = 0 and ended").withColumns({"head": F.lit(ROOT), "next_head": F.lit(None).cast("string")}).unionByName(tall)


def digests_of_ends(ended: DataFrame) -> DataFrame:
    """entry and ends: the SHA-256 of the decimal ids of an entry's conversations (`ended`: entry, conv_id), in order, joined by commas.

    Ids are sorted by range and joined into strings of some thousand; then an entry's strings are hashed one after another as they come.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, first, ids = None, None, []
        out: list[tuple] = []
        for batch in batches:
            for e, c in zip(batch.column("entry").to_pylist(), batch.column("conv_id").to_pylist()):
                if e != entry or len(ids) >= 8192:
                    if ids:
                        out.append((entry, first, ",".join(ids)))
                    entry, first, ids = e, c, []
                ids.append(str(c))
            if len(out) > 2048:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["entry", "first", "ids"])
                out = []
        if ids:
            out.append((entry, first, ",".join(ids)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["entry", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, sha = None, None
        out: list[tuple] = []
        for batch in batches:
            for e, ids in zip(batch.column("entry").to_pylist(), batch.column("ids").to_pylist()):
                if e == entry:
                    sha.update(b"," + ids.encode())
                    continue
                if entry is not None:
                    out.append((entry, sha.hexdigest()))
                entry, sha = e, hashlib.sha256(ids.encode())
            if len(out) > 2048:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["entry", "ends"])
                out = []
        if entry is not None:
            out.append((entry, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["entry", "ends"])

    joined = ended.repartitionByRange("entry", "conv_id").sortWithinPartitions("entry", "conv_id").mapInArrow(join, "entry string, first long, ids string")
    return joined.repartition("entry").sortWithinPartitions("entry", "first").mapInArrow(digest, "entry string, ends string")


def entries_of(rows: DataFrame) -> DataFrame:
    """Stretches that are the same after the same head are one entry of a container: with the number of its conversations, the least of them, and what ends there."""
    named = rows.withColumn("entry", F.sha2(F.concat("head", "digest"), 256))
    most = named.groupBy("entry").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("next_head").alias("next_head"))
    shown = named.select("entry", "conv_id", "s", "head", "ts", "ns").join(most, ["entry", "conv_id"])
    return shown.join(digests_of_ends(named.filter("ended").select("entry", "conv_id")), "entry", "left").withColumns({"root": F.col("head"), "depth": F.lit(0).cast("long")})


def burst(entries: DataFrame, limit: int, slots: int = 16) -> tuple[DataFrame, DataFrame]:
    """Entries in containers of at most `limit` suffixes, and the trie heads.

    A container with more suffixes bursts: its next turn ids become heads below its own, each with a container of what follows; an entry whose
    suffix is empty stays. Counts of containers meet entries by slots, so a container that holds all entries is no single task's.
    """
    entries = entries.withColumn("chain", F.array("head")).withColumn("slot", F.pmod(F.xxhash64("entry"), F.lit(slots)))
    heads = entries.select("head", F.lit(None).cast("string").alias("parent"), "chain", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("n")).distinct()
    done, still = [], entries
    while True:
        large = still.filter("size(ts) > 0").groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        large = save(large.select("head", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(True).alias("large")), "trie-large")
        if large.isEmpty():
            done.append(still)
            break
        still = still.join(large, ["head", "slot"], "left")
        still = save(still.withColumn("large", F.coalesce("large", F.lit(False)) & (F.size("ts") > 0)), "trie-burst")
        done.append(still.filter("not large").drop("large"))
        child = F.sha2(F.concat(F.col("head"), F.col("ts")[0]), 256)
        still = still.filter("large").drop("large").withColumn("parent", F.col("head")).withColumn("head", child).withColumn("depth", F.col("depth") + 1)
        still = still.withColumn("chain", F.concat("chain", F.array("head"))).withColumn("n", F.col("ns")[0])
        still = still.withColumn("ts", F.slice("ts", F.lit(2), F.size("ts") - 1)).withColumn("ns", F.slice("ns", F.lit(2), F.size("ns") - 1))
        still = save(still, "trie-burst")
        heads = heads.unionByName(still.select("head", "parent", "chain", F.col("depth").alias("below"), "n").distinct())
        still = still.drop("parent", "n")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, save(heads, "trie-heads")


def sweep(entries: DataFrame) -> DataFrame:
    """Nodes below the heads: the entries of each container are sorted and swept, a node opening where an entry leaves the one before."""

    def close(rows: list[tuple]) -> list[tuple]:
        """The nodes of a container: entries in order (head, depth, ts, ns, n_convs, conv_id, ends, below children, leaves, saved)."""
        nodes: list[list] = []  # depth, parent's place, conv_id, n_convs, children, leaves, saved, tokens, ends
        path: list[int] = []
        before: list[str] = []
        for _, depth, ts, ns, n_convs, conv_id, ends, children, leaves, saved in rows:
            same = 0
            while same < min(len(before), len(ts)) and before[same] == ts[same]:
                same += 1
            del path[same:]
            for k in range(same, len(ts)):
                nodes.append([depth + k + 1, path[-1] if path else -1, conv_id, 0, 0, 0, 0, ns[k], None])
                path.append(len(nodes) - 1)
            node = nodes[path[-1]]
            node[2], node[3], node[4], node[5], node[6] = min(node[2], conv_id), node[3] + n_convs, node[4] + children, node[5] + leaves, node[6] + saved
            node[8] = ends or node[8]
            before = ts
        for node in reversed(nodes):
            node[5] += node[4] == 0
            node[6] += (node[3] - 1) * node[7]
            if node[1] >= 0:
                up = nodes[node[1]]
                up[2], up[3], up[4], up[5], up[6] = min(up[2], node[2]), up[3] + node[3], up[4] + 1, up[5] + node[5], up[6] + node[6]
        return [(rows[0][0], d, c, nodes[up][2] if up >= 0 else None, n, children, leaves, saved, ends) for d, up, c, n, children, leaves, saved, _, ends in nodes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        send = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
        names = [c.split()[0] for c in NODE.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in NODE.split(", ")]
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += close(held)
                    held = []
                held.append(row)
            if len(out) > 4096:
                yield send()
                out = []
        if held:
            out += close(held)
        if out:
            yield send()

    rows = entries.filter("size(ts) > 0").select("head", "depth", "ts", "ns", "n_convs", "conv_id", "ends", "below_children", "below_leaves", "below_saved")
    return rows.repartition("head").sortWithinPartitions("head", "ts").mapInArrow(run, NODE)


def head_sums(heads: DataFrame, entries: DataFrame, swept: DataFrame) -> DataFrame:
    """Heads with what they stand for: members, children, and their own leaves and saved tokens with those of their containers."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    members = entries.select(F.explode("chain").alias("head"), "n_convs", "conv_id").groupBy("head").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    stop = entries.filter("size(ts) = 0").groupBy("head").agg(F.max("ends").alias("ends"), *(F.sum(f"below_{c}").alias(f"below_{c}") for c in ("children", "leaves", "saved")))
    tops = swept.filter("parent is null").groupBy("head").agg(F.count(F.lit(1)).alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    lower = heads.filter("parent is not null").groupBy(F.col("parent").alias("head")).agg(F.count(F.lit(1)).alias("lower"))
    rows = heads.join(members, "head").join(stop, "head", "left").join(tops, "head", "left").join(lower, "head", "left")
    children = zero(F.col("lower")) + zero(F.col("tops")) + zero(F.col("below_children"))
    rows = rows.withColumn("n_children", children).withColumn("own_leaves", zero(F.col("leaves")) + zero(F.col("below_leaves")) + (children == 0).cast("long"))
    rows = rows.withColumn("own_saved", zero(F.col("saved")) + zero(F.col("below_saved")) + (F.col("n_convs") - 1) * F.col("n"))
    return rows.select("head", "parent", "chain", "below", "conv_id", "n_convs", "n_children", "own_leaves", "own_saved", "ends")


def below(rows: DataFrame, entries: DataFrame, heads: DataFrame) -> DataFrame:
    """next_head, below_children, below_leaves, below_saved: what lies under the end of a stretch, in all later ones.

    Sums of a later head's stretch are credited to its least conversation, added up along each conversation from its end, and summed over
    the members of a head; so there is no step for each stretch of the longest conversation.
    """
    plain = entries.filter("s > 0").withColumns({f"below_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
    # What an entry that goes on adds is counted in its own stretch; here its end is a node with a child to come.
    plain = plain.withColumn("below_children", F.col("next_head").isNotNull().cast("long"))
    own = save(head_sums(heads.filter(F.col("chain")[0] != ROOT), plain, save(sweep(plain), "trie-swept")), "trie-sums")
    first = own.filter("parent is null").select("head", F.col("conv_id").alias("least"), "n_children")
    sums = own.groupBy(F.col("chain")[0].alias("head")).agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    credit = F.col("conv_id") == F.col("least")
    mine = rows.filter("s > 0").select("conv_id", "s", "head").join(first, "head").join(sums, "head").select("conv_id", "s", "head", "n_children", *(F.when(credit, F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")))
    on = Window.partitionBy("conv_id").orderBy(F.desc("s"))
    mine = mine.select("head", "n_children", F.sum("leaves").over(on).alias("leaves"), F.sum("saved").over(on).alias("saved"))
    return mine.groupBy(F.col("head").alias("next_head")).agg(F.max("n_children").alias("below_children"), F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))


def prefix_trie(turns: DataFrame, sizes: DataFrame, limit: int = 64, length: int = 256) -> DataFrame:
    """Every distinct sequence of first turns as a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, at (gapless from 0), t (an id of the turn), n (its tokens); `sizes` every conversation (conv_id, size), those without turns,
    too. Conversations are cut into stretches of `length` turns; equal stretches under one head are one entry. Entries lie in the containers of
    a burst trie (limit: suffixes in a container), which shards hold by head. Containers are sorted and swept.
    """
    rows = save(stretches(turns, sizes, length), "trie-rows")
    entries, heads = burst(save(entries_of(rows), "trie-entries"), limit)
    nothing = {f"below_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    if rows.filter("not ended").isEmpty():
        entries = save(entries.withColumns(nothing), "trie-burst")
    else:
        under = below(rows, entries, heads)
        tall = entries.filter("next_head is not null").join(under, "next_head")
        entries = save(entries.filter("next_head is null").withColumns(nothing).unionByName(tall), "trie-burst")
    starts = entries.groupBy("root").agg(F.min("s").alias("s"))
    entries = entries.withColumn("depth", F.col("depth") + F.col("s") * length)
    swept = save(sweep(entries), "trie-swept")
    sums = save(head_sums(heads, entries, swept), "trie-sums")
    total = sums.select(F.explode("chain").alias("head"), "own_leaves", "own_saved").groupBy("head").agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved"))
    # The least conversation of a later stretch's head may end there, so it comes from the entry that the head continues.
    least = sums.filter((F.col("head") == ROOT) | F.col("parent").isNotNull()).select("head", F.col("conv_id").alias("above"))
    least = least.unionByName(entries.filter("next_head is not null").select(F.col("next_head").alias("head"), F.col("conv_id").alias("above")))
    ends = F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    # The head of a later stretch is the node at the end of an earlier one, and already there.
    tops = sums.filter((F.col("head") == ROOT) | F.col("parent").isNotNull()).withColumn("root", F.col("chain")[0])
    tops = tops.join(total, "head").join(starts, "root").join(least.withColumnRenamed("head", "parent"), "parent", "left")
    tops = tops.select("conv_id", (F.col("below") + F.col("s") * length).alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends)
    inner = swept.join(least, "head").select("conv_id", "depth", F.coalesce("parent", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends)
    return tops.unionByName(inner)


def rebuilt_trie(conversations: DataFrame, period: int = 100, most: int = 6, limit: int = 64, length: int = 256) -> DataFrame:
    """The prefix trie of rebuilt conversations (see rebuild and prefix_trie): one row for each node.

    Edge cases: null role and text count as empty; rows without a conv_id take no part; turns of equal number are in the order of a digest of role and text, and rows that are
    the same in all are turns each; a conversation that loses all its turns is a member of the root, where it ends; an empty table gives no rows, not even
    a root; other columns are not read.
    """
    turns, sizes = rebuild(turn_rows(conversations), period, most)
    return prefix_trie(turns, sizes, limit, length)
