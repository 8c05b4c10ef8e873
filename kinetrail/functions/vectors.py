"""Array and number functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def normalize(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + F.lit(EPS))


def unnormalize(x: Column, mean: Column, std: Column) -> Column:
    """Inverse of ``normalize`` without the epsilon, so not an exact inverse."""
    return x * std + mean


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + F.lit(EPS)) * 2 - 1


def un_min_max(x: Column, low: Column, high: Column) -> Column:
    return (x + 1) / 2 * (high - low) + low


def pad_right(v: Column, size: int, value: float = 0.0) -> Column:
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(size) - F.size(v))))


def pad_left(v: Column, size: Column, value) -> Column:
    return F.concat(F.array_repeat(value, F.greatest(F.lit(0), size - F.size(v))), v)


def last_subsequence(hay: Column, needle: Column) -> Column:
    """Zero-based start of the last occurrence of ``needle``, null if absent."""
    n, m = F.size(hay), F.size(needle)
    starts = F.when(n >= m, F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.filter(starts, lambda i: F.slice(hay, i, m) == needle)) - 1


def safe_asin(x: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def delta_index(seconds: Column, fps: float) -> Column:
    """Half-even rounding of seconds to frames."""
    return F.rint(seconds * F.lit(float(fps))).cast("int")


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def log_reward(loss: Column, switched: Column, weight: float) -> Column:
    return -F.log(F.greatest(loss, F.lit(1e-6))) - F.lit(weight) * switched.cast("double")


def sample_count(n: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    """max(min(least, n), min(int(n ** power), most))"""
    return F.greatest(F.least(F.lit(least), n), F.least(F.floor(F.pow(n.cast("double"), F.lit(power))), F.lit(most))).cast("long")


def systematic_indices(n: Column, k: Column) -> Column:
    """round(linspace(0, n - 1, k)), half-even; repeats possible."""
    step = F.when(k > 1, (n - 1).cast("double") / (k - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: F.rint(i * step).cast("long"))


def mask_prefix(hay: Column, needle: Column, value: int = -100) -> Column:
    """Ids with all up to the end of the last ``needle`` masked; without it all are masked."""
    at = last_subsequence(hay, needle)
    return F.transform(hay, lambda x, i: F.when(at.isNotNull() & (at >= 0) & (i >= at + F.size(needle)), x).otherwise(F.lit(value).cast("long")))
