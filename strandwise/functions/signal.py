"""Column functions over arrays of signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import around

#: The 0.75 quantile of the normal distribution: what scales a median deviation to a standard deviation.
NORMAL_QUARTILE = 0.6744897501960817


def rescale(raw: Column, scaling: Column, offset: Column) -> Column:
    """Picoamperes of raw samples."""
    return F.transform(raw, lambda x: scaling * (x + offset))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once; inside a lambda, an expression is evaluated for each element otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def std(x: Column) -> Column:
    """Population standard deviation."""
    return let(mean(x), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x)))


def median(x: Column) -> Column:
    return let(F.array_sort(x), lambda s: (F.element_at(s, F.floor((F.size(s) - 1) / 2).cast("int") + 1) + F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)) / 2)


def normalize(x: Column, method: str = "mad", digits: int = 6) -> Column:
    """Signal less its centre over its scale, rounded; a scale of zero leaves the signal as it is."""
    if method == "mad":
        centre, spread = median, lambda v, shift: median(F.transform(v, lambda e: F.abs(e - shift))) / NORMAL_QUARTILE
    elif method == "zscore":
        centre, spread = mean, lambda v, shift: std(v)
    else:
        raise ValueError(f"unknown method: {method}")

    def scaled(v: Column, shift: Column, scale: Column) -> Column:
        return F.when(scale == 0, v).otherwise(F.transform(v, lambda e: around((e - shift) / scale, digits)))

    return let(x, lambda v: let(centre(v), lambda shift: let(spread(v, shift), lambda scale: scaled(v, shift, scale))))


def per_base(x: Column, events: Column) -> Column:
    """The samples of each event (start, length)."""
    return let(x, lambda v: F.transform(events, lambda e: F.slice(v, e["start"].cast("int") + 1, e["length"])))


def rectangle(x: Column, width: int, key: Column, seed: int = 0) -> Column:
    """Exactly `width` samples: zeros on both sides (the odd one right), or a seeded sample in its order.

    `key` tells apart arrays that are to be sampled independently.
    """
    gap, digest = F.lit(width) - F.size(x), lambda i: F.md5(F.concat_ws("|", F.lit(seed), key, i))
    left = F.floor(gap / 2).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), gap - left))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.struct(digest(i).alias("d"), i.alias("i"))))
    picked = F.array_sort(F.transform(F.slice(order, 1, width), lambda e: e["i"]))
    return F.when(gap >= 0, padded).otherwise(F.transform(picked, lambda i: F.element_at(x, i + 1)))
