"""Vector arithmetic on array columns, in doubles, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a) -> Column:
    return F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine; 0 where either is null or both norms multiply to at most 1e-9."""
    scale = norm(a) * norm(b)
    return F.coalesce(F.when(scale > 1e-9, dot(a, b) / scale), F.lit(0.0))


def cosine_or_mismatch(a, b) -> Column:
    """Cosine; -1 where sizes differ or either is null."""
    return F.when(F.size(doubles(a)) == F.size(doubles(b)), cosine(a, b)).otherwise(F.lit(-1.0))


def normalized(a) -> Column:
    """a over its norm; a itself where the norm is at most 1e-8."""
    n = norm(a)
    return F.when(n > 1e-8, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def pixel_similarity(a, b) -> Column:
    """1 - mean absolute difference / 255."""
    gap = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.try_divide(gap, F.size(doubles(a))) / 255


def angle_degrees(a, b) -> Column:
    """Angle between vectors; 0 where either norm is below 1e-9."""
    scale = norm(a) * norm(b)
    return F.when(scale < 1e-9, F.lit(0.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale)))))


def audio_level_dbfs(samples) -> Column:
    """20 log10 of the root mean square, at least that of one step of 16 bits; null for no samples or silence."""
    rms = F.sqrt(F.try_divide(F.aggregate(doubles(samples), F.lit(0.0), lambda s, x: s + x * x), F.size(doubles(samples))))
    return F.when(rms > 0, 20 * F.log10(F.greatest(rms, F.lit(1 / 32768))))


def clip_samples(samples, start_sec, end_sec, sample_rate) -> Column:
    """samples of [start, end), bounds rounded half to even and clamped; empty where inverted."""
    n = F.size(samples)
    lo = F.least(F.greatest(F.bround(F.col(start_sec) * F.col(sample_rate)).cast("int"), F.lit(0)), n)
    hi = F.least(F.greatest(F.bround(F.col(end_sec) * F.col(sample_rate)).cast("int"), F.lit(0)), n)
    return F.slice(samples, lo + 1, F.greatest(hi - lo, F.lit(0)))
