"""Byte-level BPE encoding and decoding with a two-tier lookup."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash of distinct keys: n keys take the slots 0 to n - 1.

    Keys fall into buckets; from the largest bucket down, each gets the first displacement that puts its keys into free slots, and
    buckets of one key, at last, get one of the slots that are left (written as a negative number). A displacement is mixed with
    both halves of a key's hash, so each is an independent try; if a bucket finds none within `tries`, all starts again
    with the next seed.
    """

    def __init__(self, keys: Sequence[bytes], tries: int | None = None):
        self.n, self.buckets, self.seed = len(keys), max(1, len(keys) // 2), 0
        while not self._build(keys, tries or 1000 * (1 + self.n)):
            self.seed += 1

    def _build(self, keys: Sequence[bytes], tries: int) -> bool:
        self.shift, self.at = np.zeros(self.buckets, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            bucket, a, b = self._hash(key)
            groups.setdefault(bucket, []).append((a, b, i))
        free = np.ones(self.n, dtype=bool).tolist()
        ordered = sorted(groups.items(), key=lambda g: -len(g[1]))
        for bucket, members in ordered:
            if len(members) == 1:
                break
            for d in range(tries):
                slots = [self._slot(a, b, d) for a, b, _ in members]
                if all(map(free.__getitem__, slots)) and len(set(slots)) == len(members):
                    break
            else:
                return False
            self.shift[bucket] = d
            for slot, (_, _, i) in zip(slots, members, strict=True):
                free[slot], self.at[slot] = False, i
        rest = (slot for slot, is_free in enumerate(free) if is_free)
        for bucket, members in ordered:
            if len(members) == 1:
                slot = next(rest)
                self.shift[bucket], self.at[slot] = -slot - 1, members[0][2]
        return True

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        return (h >> 64) % self.buckets, h & MASK, (h >> 64) | 1

    def _slot(self, a: int, b: int, d: int) -> int:
        x = (a + d * b) & MASK
        x = ((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) & MASK
        return (x >> 32) % self.n

    def index(self, key: bytes) -> int:
        """Of the key that alone can be at the slot of this key; the caller compares."""
        bucket, a, b = self._hash(key)
        d = int(self.shift[bucket])
        return int(self.at[-d - 1 if d < 0 else self._slot(a, b, d)])


class Codec:
    """Encodes and decodes by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 300_000):
        self.ranks, self.tokens = ranks, list(ranks)
        self.ids = np.array(list(ranks.values()), dtype=np.int64)
        self.hash = PerfectHash(self.tokens)
        size = max(ranks.values(), default=-1) + 1
        self.of_id: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.of_id[rank] = token
        self.names = [str(i) for i in range(size)]
        # White space as Unicode has it, as the merges were made with; without this, \s also takes U+001C to U+001F.
        self.pattern, self.cached = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), cached

    def rank(self, piece: bytes) -> int:
        """The rank of a token, or -1."""
        if not self.tokens:
            return -1
        i = self.hash.index(piece)
        return int(self.ids[i]) if self.tokens[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token itself: the pair of least rank, the leftmost of equals, merges first.

        Parts are linked by where the next and the one before start; the heap holds rank * n + start of each pair.
        """
        n, get = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # the rank of each part with the next
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                pair[i] = r = get(piece[i : after[k]], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            p = before[i]
            if p >= 0:
                pair[p] = r = get(piece[p:k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        r = self.rank(data)
        return (r,) if r >= 0 else tuple(self.merge(data))

    def encoder(self):
        """A function from a text to its ids; it keeps pieces it has met, up to a bound."""
        find, met, most = regex.compile(self.pattern).findall, {}, self.cached

        def add(piece: str) -> tuple[int, ...]:
            ids = self.encode_piece(piece)
            if len(piece) <= 64:
                if len(met) >= most:
                    met.clear()
                met[piece] = ids
            return ids

        def encode(text: str) -> list[int]:
            get = met.get
            return list(chain.from_iterable([get(p) or add(p) for p in find(text)]))

        return encode

    def decimal(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.of_id.__getitem__, ids))


OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
TYPES = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, pattern: str, outputs: Sequence[str] = ("ids", "n_tokens"), keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encode every whole text by the ranks in the file at `path`; `keep` names columns to carry along.

    `outputs`: any of ids, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded (the bytes of the
    ids), decoded_sha256. Pre-tokens are the matches of `pattern`. One that is a token is resolved by a minimal perfect
    hash and a comparison; the others are merged with a heap over linked bytes. The vocabulary is read by the driver and
    broadcast; its size is that of the file, whatever the input. No row is shuffled.

    Edge cases: a null text is empty and has no ids; strings of special tokens are ordinary text; a text of any
    length is encoded whole, its memory growing with it; rows and ids repeat as they do in the input; an empty table
    gives no rows; other columns are not read.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        to_ids = c.encoder()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: dict[str, list] = {k: [] for k in outputs}
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    ids = to_ids(text)
                    for k in outputs:
                        if k == "n_tokens":
                            out[k].append(len(ids))
                        elif k == "ids":
                            out[k].append(ids)
                        elif k == "ids_sha256":
                            out[k].append(hashlib.sha256(c.decimal(ids).encode()).hexdigest())
                        else:
                            data = c.decode(ids)
                            out[k].append(data if k == "decoded" else hashlib.sha256(data).hexdigest())
                kept = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[k], OUTPUTS[k]) for k in outputs)], names=[*keep, *outputs])

    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} {TYPES[k]}" for k in outputs)])
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The bytes of each list of ids, as column `decoded`; null ids give null, an id outside the vocabulary is an error."""
    codec = rows.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if ids is None else codec.value.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(data, pa.binary())], names=[*keep, "decoded"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "decoded binary"])
    return rows.select(*keep, ids_col).mapInArrow(run, schema)
