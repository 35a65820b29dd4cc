"""Exact similarity join on word n-grams with a token-group matrix.

1. Each text gives a set of 64-bit shingle hashes; equal sets form a class, and only classes are compared.
2. Groups: a class joins the group of the most frequent of its four min-hashes, so similar documents, linked or not, share a
   group. A large group has several blocks, each with a bounded number of shingles.
3. Tokens are put in order, frequent ones last. Two sets of which the larger has m shingles can only be similar enough if they
   share `_depth(t * m)` tokens or more among the first n - ceil(t * n) + _depth(n) of each (their prefixes).
4. Token-group matrix: for each token, the groups that have it in a prefix (a group's row is the union of its members' prefixes),
   with bounds over these members. A query, that is, a class, meets the groups of at least its own group's size. How many
   tokens of its prefix lie in a group's union, and what follows the first of them, bound its overlap with any member;
   only groups whose bounds allow enough are opened.
5. A task gets a block: its members, its group's leader, and the queries that open it, with their texts. It compares members with
   the leader, then those that it isn't linked with to all others, then queries with members, by sizes and
   counts of tokens in 256 buckets, then by the whole sets. Whatever is linked already isn't compared again, so a block gives at
   most one link for each of its rows, and pairs are never rows.
6. In groups of several blocks, members that aren't linked with the leader are queries to the group's other blocks.

A pair of the same block, of one group, or of two groups is compared in step 5, 6 or 5, unless bounds rule it out or it is
connected by other links; so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling as R
from .common import discard, save
from .graph import components
from .repeats import Units, chunks, column_bytes

U = np.uint64
#: A token is frequent from this count on, or from the least doubling of it that leaves no more than MOST_FREQUENT tokens.
FREQUENT, MOST_FREQUENT = 8, 300_000
#: A set's sketch counts its tokens in so many buckets.
BUCKETS = 256
#: About so many shingles and rows of members make a block, and so many queries meet it in one task.
BLOCK_SHINGLES, BLOCK_ROWS, BLOCK_QUERIES = 1 << 20, 2048, 4096
#: Prefixes are longer by one token for each so many, and so are the overlaps of prefixes that similar sets need.
STEP = 32
SEEDS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=U)
#: What the words of a shingle, by their places, are multiplied with modulo the prime; fixed at random.
FACTORS = R.prime_powers(R.PRIME_BASES[1], 64)[1:]


def shingle_sets(data: np.ndarray, at: np.ndarray, i: int, j: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of rows i to j, and where each row's start and the last ends; sorted within a row.

    A shingle's hash is a sum of its words' codes times fixed factors modulo the prime 2**61 - 1, whatever its words are like.
    """
    u = Units(R.lower(data[at[i] : at[j]]), at[i : j + 1] - at[i], 0, j - i, True)
    codes, many = u.codes, np.diff(u.first)
    grams, row = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    if u.n >= n:
        own = np.flatnonzero(u.doc[n - 1 :] == u.doc[: u.n - n + 1])
        grams, row = np.zeros(len(own), dtype=U), u.doc[own]
        for k in range(n):
            grams = R.fold(grams + R.times(codes[own + k], FACTORS[k]))
    few = np.flatnonzero((many > 0) & (many < n))
    whole = many[few].astype(U)  # so sequences of other lengths have other hashes
    for k in range(n - 1):
        word = codes[np.minimum(u.first[few] + k, max(0, u.n - 1))] if u.n else whole
        whole = np.where(k < many[few], R.fold(whole + R.times(word, FACTORS[n + k])), whole)
    grams, row = R.mix(np.concatenate([grams, whole])), np.concatenate([row, few])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(j - i + 1))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _least_common(n, share: tuple[int, int]):
    """How many tokens a set of n must have in common with any that is similar enough: share * n, rounded up."""
    return (share[0] * n + share[1] - 1) // share[1]


def _depth(n):
    return 1 + n // STEP


def _prefix_size(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return np.where(n > 0, np.minimum(n, n - _least_common(n, share) + _depth(n)), 0)


def _digests(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, of its size and its members under two mixings."""
    out = []
    for seed in SEEDS[1:3]:
        sums = np.concatenate([np.zeros(1, U), np.cumsum(R.mix(grams * seed + U(1)), dtype=U)])
        out.append((R.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U))).view(np.int64))
    return out[0], out[1]


def _needed(share: tuple[int, int], overlap, n1, n2):
    """Whether so much overlap is enough for sets of these sizes."""
    return overlap * (share[0] + share[1]) >= (n1 + n2) * share[0]


class Block:
    """The members of a block and the links that are found, of which none joins what is joined already."""

    def __init__(self, share: tuple[int, int]):
        self.share, self.cid, self.sets, self.links, self.of = share, [], [], [], []
        self.leader, self.ready, self.sketches, self.tokens = None, False, None, None

    def add(self, cid: int, grams: np.ndarray) -> int:
        self.cid.append(cid)
        self.sets.append(grams)
        self.of.append(len(self.of))
        return len(self.of) - 1

    def top(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = i = self.of[self.of[i]]
        return i

    def link(self, i: int, j: int) -> None:
        self.of[self.top(j)] = self.top(i)
        self.links.append((self.cid[i], self.cid[j]))

    def similar(self, i: int, j: int) -> bool:
        a, b = sorted((self.sets[i], self.sets[j]), key=len)
        if len(a) * self.share[1] < len(b) * self.share[0]:
            return False
        both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
        return _needed(self.share, both, len(a), len(b))

    def prepare(self, inside: bool) -> None:
        """All members are here; compare them with each other if `inside`."""
        self.ready, self.m = True, len(self.cid)
        self.sizes = np.array([len(x) for x in self.sets])
        if inside:
            lead = self.leader
            apart = [i for i in range(self.m) if i != lead]
            if lead is not None:
                linked = [i for i in apart if self.similar(lead, i)]
                for i in linked:
                    self.link(lead, i)
                apart = sorted({*apart} - {*linked})
            for i in apart:
                self.join(i)

    def _sketch(self, grams: np.ndarray) -> np.ndarray:
        return np.minimum(np.bincount((grams >> U(56)).astype(np.int64), minlength=BUCKETS), 65535).astype(np.uint16)

    def join(self, i: int) -> None:
        """Link set i with members that it is similar enough to and isn't connected with."""
        if self.sketches is None:
            self.sketches = np.array([self._sketch(x) for x in self.sets[: self.m]])
        n = len(self.sets[i])
        may = np.flatnonzero((self.sizes * self.share[1] >= n * self.share[0]) & (n * self.share[1] >= self.sizes * self.share[0]))
        own = self._sketch(self.sets[i])
        most = np.minimum(self.sketches[may], own).sum(axis=1, dtype=np.int64)
        # A count that is cut at the top bounds nothing.
        may = may[_needed(self.share, most, n, self.sizes[may]) | (own.max(initial=0) == 65535)]
        may = [j for j in may.tolist() if j != i and self.top(j) != self.top(i)]
        if len(may) > 12:
            both = self._overlaps(self.sets[i])
            may = [j for j in may if _needed(self.share, both[j], n, self.sizes[j])]
            for j in may:
                if self.top(j) != self.top(i):
                    self.link(i, j)
        else:
            for j in may:
                if self.top(j) != self.top(i) and self.similar(i, j):
                    self.link(i, j)

    def _overlaps(self, grams: np.ndarray) -> np.ndarray:
        """How many tokens a set has in common with each member."""
        if self.tokens is None:
            flat, owner = np.concatenate(self.sets[: self.m]), np.repeat(np.arange(self.m), self.sizes)
            order = np.argsort(flat, kind="stable")
            self.owner, flat = owner[order], flat[order]
            self.tokens, first = np.unique(flat, return_index=True)
            self.ends = np.append(first, len(flat))
        at = np.minimum(np.searchsorted(self.tokens, grams), len(self.tokens) - 1)
        at = at[self.tokens[at] == grams]
        many = self.ends[at + 1] - self.ends[at]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.ends[at], many)
        return np.bincount(self.owner[place], minlength=self.m)

    def ask(self, cid: int, grams: np.ndarray) -> None:
        """A query: link it, then forget its set."""
        i = self.add(cid, grams)
        self.join(i)
        self.sets[i] = None


LEADER, MEMBER, QUERY = 0, 1, 2
WANTED = ("did", "lacks", "cid", "d1", "d2", "g", "b", "s", "role")


def _compare(wanted: DataFrame, docs: DataFrame, n: int, share: tuple[int, int], inside: bool) -> DataFrame:
    """Links (a, b: class ids) within the blocks (g, b, s) that `wanted` deals classes to, among members only if `inside`."""
    key = ["g", "b", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at_key = Block(share), None

        def links() -> pa.RecordBatch:
            if not block.ready:
                block.prepare(inside and at_key[2] == 0)
            found = np.array(block.links, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            cids, roles = batch.column("cid").to_pylist(), batch.column("role").to_pylist()
            for i, j in chunks(at):
                grams, first = shingle_sets(data, at, i, j, n)
                # Of rows that share a doc_id, those of the class.
                same = np.logical_and(*(d == batch.column(c).to_numpy()[i:j] for c, d in zip(("d1", "d2"), _digests(grams, first), strict=True)))
                for r in np.flatnonzero(same).tolist():
                    if keys[i + r] != at_key:
                        if at_key is not None:
                            yield links()
                        block, at_key = Block(share), keys[i + r]
                    own = grams[first[r] : first[r + 1]]
                    if block.cid and block.cid[-1] == cids[i + r]:  # a row that is repeated whole
                        continue
                    if roles[i + r] == QUERY:
                        if not block.ready:
                            block.prepare(inside and at_key[2] == 0)
                        block.ask(cids[i + r], own)
                    elif roles[i + r] == LEADER:
                        block.leader = block.add(cids[i + r], own)
                    elif block.leader is None or block.cid[block.leader] != cids[i + r]:
                        block.add(cids[i + r], own)
        if at_key is not None:
            yield links()

    rows = docs.join(wanted, ["did", "lacks"]).select(*key, "role", "cid", "d1", "d2", "text")
    return save(rows.repartition(*key).sortWithinPartitions(*key, "role", "cid").mapInArrow(run, "a long, b long"), "jaccard-links")


def _deal(members: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """Which blocks a class's text goes to: its own as a member, and those of the groups that it queries.

    `members`: cid, g; `sizes`: g, blocks, leader; `queries`: cid, to (a group), and skip (a block that is no target, or null). Where many
    queries ask for a group, its blocks are there once for each `BLOCK_QUERIES` of them.
    """
    block = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    asked = queries.groupBy(F.col("to").alias("g")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("slices"))
    sizes = save(sizes.join(asked, "g", "left").select("g", "blocks", "leader", F.coalesce("slices", F.lit(1)).alias("slices")), "jaccard-dealt")
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s")
    own = members.join(sizes, "g").select("cid", "g", block("blocks").alias("b"), slices, F.lit(MEMBER).alias("role"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")
    leaders = sizes.filter("leader is not null").select(F.col("leader").alias("cid"), "g", each, F.lit(0).alias("s"), F.lit(LEADER).alias("role"))
    asking = queries.join(sizes, F.col("to") == F.col("g")).select("cid", "g", each, F.pmod(F.xxhash64("cid", "g"), F.col("slices")).cast("int").alias("s"), F.lit(QUERY).alias("role"), "skip")
    return own.union(leaders).union(asking.filter("skip is null or b <> skip").drop("skip"))


def jaccard_components(docs: DataFrame, n: int = 4, share: tuple[int, int] = (85, 100)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    A-Z count as a-z; words are runs of other than ASCII white space; a set holds the distinct shingles of n words, or the
    whole sequence of a text with fewer words. Two documents link when intersection / union is share[0] / share[1] or
    more, counted over whole texts. Shingles stand as hashes modulo the prime 2**61 - 1: that two of a pair of documents collide, whatever
    their words, has a probability of about 1e-12 for sets of a thousand.

    Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; a null doc_id is larger than any
    other, and a component of null ids alone has a null id; rows repeated whole link with each other; of rows that share
    a doc_id each has its own links; an empty table gives no rows; other columns are not read. A set lies whole in the memory of a
    task, 8 bytes a shingle.
    """
    spark = docs.sparkSession
    # A hash of the text stands in for a null id; `lacks` tells it from an id, as any long may be one.
    own = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(own, F.xxhash64("text")).alias("did"), own.isNull().alias("lacks"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = F.when(~F.col("lacks"), F.col("did"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for i, j in chunks(at):
                grams, first = shingle_sets(data, at, i, j, n)
                size = np.diff(first)
                place = np.arange(len(grams)) - np.repeat(first[:-1], size)
                # a quarter more than a prefix: what moves up where frequent tokens move last
                yield pa.RecordBatch.from_arrays([pa.array(grams[place < np.repeat(_prefix_size(size, share) * 5 // 4 + 8, size)].view(np.int64))], names=["token"])

    counts = save(docs.select("text").mapInArrow(least, "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT), "jaccard-counts")
    bound = FREQUENT
    while counts.filter(F.col("count") >= bound).count() > MOST_FREQUENT:
        bound *= 2
    hot = np.sort(np.array([r.token for r in counts.filter(F.col("count") >= bound).select("token").collect()], dtype=np.int64))
    frequent = spark.sparkContext.broadcast(hot)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for i, j in chunks(at):
                grams, first = shingle_sets(data, at, i, j, n)
                size = np.diff(first)
                d1, d2 = _digests(grams, first)
                row = np.repeat(np.arange(j - i), size)
                signed = grams.view(np.int64)
                late = hot[np.minimum(np.searchsorted(hot, signed), len(hot) - 1)] == signed if len(hot) else np.zeros(len(grams), dtype=bool)
                order = np.lexsort((grams, late, row))
                p = _prefix_size(size, share)
                head = grams[order][np.arange(len(grams)) - np.repeat(first[:-1], size) < np.repeat(p, size)]
                some = np.flatnonzero(size)
                keys = np.zeros((j - i, len(SEEDS)), dtype=U)
                for k, seed in enumerate(SEEDS):
                    if len(some):
                        keys[some, k] = np.minimum.reduceat(R.mix(grams * seed), first[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(i, j - i), batch.column("lacks").slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(d1), pa.array(d2), _lists(keys.ravel(), np.full(j - i, len(SEEDS))), _lists(head, p)],
                    names=["did", "lacks", "n", "d1", "d2", "keys", "prefix"],
                )

    rows = save(docs.mapInArrow(rows_of, "did long, lacks boolean, n long, d1 long, d2 long, keys array<long>, prefix array<long>"), "jaccard-rows")
    discard(counts)
    classes = rows.filter("n > 0").groupBy("d1", "d2", "n").agg(F.coalesce(F.min(known), F.min("did")).alias("did"), F.min("lacks").alias("lacks"), F.any_value("keys").alias("keys"), F.any_value("prefix").alias("prefix"))
    # Of classes whose smallest doc_id is the same, as ids repeat, all but one take another id.
    again = F.row_number().over(Window.partitionBy("did").orderBy("d1", "d2"))
    classes = save(classes.withColumn("cid", F.when(again == 1, F.col("did")).otherwise(F.xxhash64("d1", "d2"))), "jaccard-classes")
    texts = ["did", "lacks", "cid", "d1", "d2"]

    # Groups, by the most frequent min-hash of a class; the least class that has it leads.
    keys = classes.select("cid", F.posexplode("keys").alias("j", "key"))
    crowds = save(keys.groupBy("j", "key").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("leader")).filter("m > 1"), "jaccard-crowds")
    crowd = keys.join(crowds, ["j", "key"]).groupBy("cid").agg(F.max(F.struct("m", "leader")).alias("top")).select("cid", "top.leader")
    members = classes.select("cid", "n").join(crowd, "cid", "left").select("cid", "n", F.coalesce("leader", "cid").alias("g"))
    members = save(members, "jaccard-members")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_ROWS)).cast("int")
    groups = save(members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), blocks.alias("blocks")), "jaccard-groups")
    discard(crowds)

    # The matrix: tokens of prefixes by groups, and the queries whose bounds allow enough overlap.
    entries = classes.select("cid", "prefix").join(members.join(groups, "g").select("cid", "n", "g", "m"), "cid")
    entries = entries.select("cid", "n", "g", "m", F.posexplode("prefix").alias("pos", "token")).withColumn("rest", F.col("n") - F.col("pos")).drop("pos")
    shared = save(entries.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).filter("g1 < g2").select("token"), "jaccard-tokens")
    entries = save(entries.join(shared, "token", "left_semi"), "jaccard-entries")
    matrix = entries.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("top"), F.first("m").alias("size"))
    matrix = save(matrix.withColumnsRenamed({"g": "to"}), "jaccard-matrix")
    larger = (F.col("m") < F.col("size")) | ((F.col("m") == F.col("size")) & (F.col("g") < F.col("to")))
    fits = (F.col("most") * share[1] >= F.col("n") * share[0]) & (F.col("n") * share[1] >= F.col("least") * share[0])
    hits = entries.join(matrix, "token").filter(larger & fits)
    hits = hits.groupBy("cid", "n", "to").agg(F.count(F.lit(1)).alias("hits"), F.max(F.least("rest", "top")).alias("follow"), F.min("least").alias("least"))
    smaller = F.greatest("least", F.floor((F.col("n") * share[0] + share[1] - 1) / share[1]))  # the least size of a member that may be similar
    opened = hits.filter((F.col("hits") >= 1 + F.floor(F.least("n", smaller) / STEP)) & _needed(share, F.col("follow"), F.col("n"), smaller))
    opened = save(opened.select("cid", "to", F.lit(None).cast("int").alias("skip")), "jaccard-opened")
    for done in (shared, entries, matrix):
        discard(done)

    # Blocks of groups that have several members or are asked for.
    live = groups.join(opened.select(F.col("to").alias("g")).distinct().withColumn("asked", F.lit(True)), "g", "left").filter("m > 1 or asked")
    sizes = save(live.select("g", "blocks", F.when(F.col("m") > 1, F.col("g")).alias("leader")), "jaccard-sizes")
    inside = members.join(sizes.select("g"), "g", "left_semi").select("cid", "g")
    wanted = save(_deal(inside, sizes, opened).join(classes.select(*texts), "cid").select(*WANTED), "jaccard-wanted")
    links = _compare(wanted, docs, n, share, True)

    # Groups of several blocks: what the leader isn't linked with asks for the other blocks.
    parted = sizes.filter("blocks > 1")
    several = members.join(parted, "g").filter("cid <> g").select("cid", "g", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("skip"))
    led = links.select(F.col("a").alias("g"), F.col("b").alias("cid"))
    apart = save(several.join(led, ["g", "cid"], "left_anti").select("cid", F.col("g").alias("to"), "skip"), "jaccard-apart")
    if not apart.isEmpty():
        sizes = sizes.join(apart.select(F.col("to").alias("g")).distinct(), "g", "left_semi").select("g", "blocks", F.lit(None).cast("long").alias("leader"))
        inside = members.join(sizes.select("g"), "g", "left_semi").select("cid", "g")
        again_ = save(_deal(inside, sizes, apart).join(classes.select(*texts), "cid").select(*WANTED), "jaccard-wanted")
        links = links.union(_compare(again_, docs, n, share, False))
        discard(again_)
    group = components(links)

    named = classes.join(group, classes.cid == group.node, "left").select("d1", "d2", "n", "did", "lacks", F.coalesce(F.col("comp"), F.col("cid")).alias("comp"))
    named = save(named, "jaccard-named")
    top = named.groupBy("comp").agg(F.min(known).alias("top"))
    named = save(named.join(top, "comp").select("d1", "d2", "n", "top"), "jaccard-tops")
    out = rows.select(known.alias("doc_id"), "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    out = save(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", "doc_id").alias("component_id")), "jaccard-found")
    for done in (rows, classes, members, groups, opened, sizes, wanted, apart, named):
        discard(done)
    return out
