"""Prefix polynomial hashes over sequences of codes (bytes or words), and what is made of them; NumPy only.

`Prefix` works modulo 2**64: it is fast, and equal stretches have equal hashes, but there are structured texts on which
different ones have, too. It serves as a filter alone; whatever it lets through is compared by content. `Prime`
works modulo the prime 2**61 - 1, where two different stretches of n codes collide with a probability of n / 2**61 at most.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
#: Two odd bases: their inverses modulo 2**64 exist, so the hash of any stretch is a difference times a power.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: The prime, two bases below it, and masks of 31 and 30 bits.
PRIME, M31, M30 = U((1 << 61) - 1), U((1 << 31) - 1), U((1 << 30) - 1)
PRIME_BASES = (1_640_531_527_198_710_399, 1_181_783_497_276_652_981)
_primes: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each code over all 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        have = _powers[base] = (both[0], both[1])
    return have


class Prefix:
    """Hashes of stretches of one sequence of codes."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(codes) + 1)
        self.p = np.zeros(len(codes) + 1, dtype=U)
        np.cumsum(codes * up[: len(codes)], out=self.p[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.p[end] - self.p[start]) * self.down[start]

    def every(self, k: int) -> np.ndarray:
        """The mixed hash of each stretch of k codes."""
        return mix((self.p[k:] - self.p[:-k]) * self.down[: len(self.p) - k])


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> U(31), a & M31, b >> U(31), b & M31
    mid = al * bh + ah * bl
    return fold(((ah * bh) << U(1)) + (mid >> U(30)) + ((mid & M30) << U(31)) + al * bl)


def prime_powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo the prime."""
    have = _primes.get(base)
    if have is None or len(have) < n:
        have, size = np.ones(1, dtype=U), max(n, 1 << 12)
        while len(have) < size:
            have = np.concatenate([have, times(have, U(pow(base, len(have), int(PRIME))))])
        _primes[base] = have
    return have


class Prime:
    """Hashes of stretches of one sequence of codes of up to 9 bits, modulo the prime.

    The two halves of the powers are summed apart, in spans that can't overflow, and reduced only where a hash is asked for.
    """

    SPAN = 1 << 22

    def __init__(self, codes: np.ndarray, base: int = PRIME_BASES[0]):
        n = len(codes)
        self.down, power = prime_powers(pow(base, -1, int(PRIME)), n + 1), prime_powers(base, n + 1)
        self.high, self.low = np.zeros(n + 1, dtype=U), np.zeros(n + 1, dtype=U)
        for i in range(0, n, self.SPAN):
            j = min(n, i + self.SPAN)
            np.cumsum(codes[i:j] * (power[i:j] >> U(31)), out=self.high[i + 1 : j + 1])
            np.cumsum(codes[i:j] * (power[i:j] & M31), out=self.low[i + 1 : j + 1])
            self.low[i + 1 : j + 1] += self._to(np.array([i]))

    def _to(self, end: np.ndarray) -> np.ndarray:
        high = fold(self.high[end])
        return fold(((high << U(31)) & PRIME) + (high >> U(30)) + fold(self.low[end]))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(fold(self._to(end) + PRIME - self._to(start)), self.down[start])


def contents(data: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit BLAKE2 digests of stretches of bytes as two integers, the first combined with a tag."""
    view = memoryview(np.ascontiguousarray(data))
    both = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), dtype=U).reshape(-1, 2)
    return both[:, 0] ^ tag, both[:, 1].copy()


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end."""
    space = np.ones(len(data) + 2, dtype=np.int8)
    space[1:-1] = SPACE[data]
    edge = np.diff(space)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def single_spaces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of white space as one space, and where the places `at` are then."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    return np.where(space, np.uint8(32), data)[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A code below the prime for each word, of its bytes (no code is 0, so words of zero bytes differ by length)."""
    return Prime(data.astype(U) + U(1)).raw(start, end)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def sliding(values: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each w neighbours, in log2(w) passes."""
    out, have = values, 1
    while have * 2 <= w:
        out = best(out[:-have], out[have:])
        have *= 2
    return out if have == w else best(out[: len(values) - w + 1], out[w - have : w - have + len(values) - w + 1])


def anchors(grams: np.ndarray, doc: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same least gram: its place, and the first and last window's start.

    grams: the hash of each k codes; doc: the number of the document of each code. A window has `length` codes of one
    document, so length - k + 1 grams, of which the least (the leftmost of equals) is its anchor. The choice depends on the
    window's content alone, so equal windows have their anchors at the same place.
    """
    w, n = length - k + 1, len(doc) - length + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none
    low = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    least = (sliding(low, w, np.minimum) & U(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(doc[:n] == doc[length - 1 :])
    at = least[start]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return at[first], start[first], start[np.append(first[1:], len(at)) - 1] if len(at) else none


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the stretches."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_sort(codes: np.ndarray, group: np.ndarray, start: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by their first `limit` codes within each group, by merge sort with hash-compared suffixes.

    Two suffixes compare by their longest common extension, found by binary search over prefix hashes, and by the code that
    follows it. Runs of 1, 2, 4 ... suffixes of a group are merged, all pairs of runs at once: a suffix's place is its place in
    its own run and the number of smaller suffixes in the other, found by binary search. Each suffix has `limit` codes at least.
    Returns the order, and for each place whether the suffix there equals the one before it in all `limit` codes, verified
    on the codes themselves. If hashes of different codes turn out to be equal, the suffixes are sorted by their codes instead.
    """
    prefix = Prime(codes)
    span, collided = np.arange(limit), False
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    size = np.diff(np.append(first, len(order)))
    base, count = np.repeat(first, size), np.repeat(size, size)  # of the group, by place

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), dtype=np.int64), np.full(len(x), limit - 1, dtype=np.int64)
        same = prefix.raw(x, x + limit) == prefix.raw(y, y + limit)
        lo[same] = limit
        live = np.flatnonzero(~same)
        while len(live):
            mid = (lo[live] + hi[live] + 1) >> 1
            a, b = x[live], y[live]
            eq = prefix.raw(a, a + mid) == prefix.raw(b, b + mid)
            lo[live[eq]] = mid[eq]
            hi[live[~eq]] = mid[~eq] - 1
            live = live[lo[live] < hi[live]]
        return lo

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nonlocal collided
        n = common(x, y)
        differ = n < limit
        at = np.minimum(n, limit - 1)
        # Where an extension ends, the codes differ, or hashes of different codes were equal.
        collided |= bool((differ & (codes[x + at] == codes[y + at])).any())
        return differ & (codes[x + at] < codes[y + at])

    width = 1
    while width < (size.max() if len(size) else 0):
        place = np.flatnonzero(count > width)
        local = place - base[place]
        run = local // (2 * width)
        left = local % (2 * width) < width
        lo = np.minimum((run * 2 + 1) * width, count[place]) + base[place]  # where the right run starts, and ends
        hi = np.minimum((run * 2 + 2) * width, count[place]) + base[place]
        mine, own = place[left], (local % (2 * width))[left]
        lo, hi, begin = lo[left], hi[left], base[mine] + (run * 2 * width)[left]
        a, l, h = start[order[mine]], lo.copy(), hi.copy()
        live = np.flatnonzero(l < h)
        while len(live):
            mid = (l[live] + h[live]) >> 1
            smaller = less(start[order[mid]], a[live])
            l[live[smaller]] = mid[smaller] + 1
            h[live[~smaller]] = mid[~smaller]
            live = live[l[live] < h[live]]
        to = np.full(len(order), -1, dtype=np.int64)
        target = begin + own + (l - lo)
        to[target] = order[mine]
        taken = np.zeros(len(order), dtype=bool)
        taken[target] = True
        # The right runs fill the places that are left, in their own order.
        free = place[~taken[place]]
        to[free] = order[place[~left]]
        order = np.where(to >= 0, to, order)
        width *= 2
    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffixes are equal in all codes, by the codes themselves."""
        parts = max(1, len(x) * limit >> 20)
        return np.concatenate([(codes[a[:, None] + span] == codes[b[:, None] + span]).all(axis=1) for a, b in zip(np.array_split(x, parts), np.array_split(y, parts), strict=True)])

    same = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        near = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        x, y = start[order[near]], start[order[near + 1]]
        full = prefix.raw(x, x + limit) == prefix.raw(y, y + limit)
        same[near[full] + 1] = alike(x[full], y[full])
        if collided or same.sum() < full.sum():  # sorted by the codes themselves
            keys = [(int(g), codes[a : a + limit].tobytes()) for g, a in zip(group, start, strict=True)]
            order = np.array(sorted(range(len(order)), key=keys.__getitem__))
            same = np.array([i > 0 and keys[order[i]] == keys[order[i - 1]] for i in range(len(order))])
    return order, same
