"""Intensity normalisation of array volumes: no rows are exploded and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelloom.functions.columns import EPS, dbl, let, total


def moments(a: Column) -> Column:
    """struct(mean, std), std of the population; null for an empty array."""
    mean = F.when(F.size(a) > 0, total(a) / F.size(a))
    return let(mean, lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(a, dbl(0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)).alias("std")))


def zscore(a: Column) -> Column:
    return let(moments(a), lambda s: F.transform(a, lambda v: (v - s["mean"]) / F.greatest(s["std"], dbl(EPS))))


def zscore_masked(a: Column, mask: Column) -> Column:
    """Statistics and update of masked voxels only; an empty mask means all of them."""
    inside = F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda p: p["m"]), lambda p: p["v"])
    some = F.exists(mask, lambda m: m)
    change = let(moments(inside), lambda s: F.zip_with(a, mask, lambda v, m: F.when(m, (v - s["mean"]) / F.greatest(s["std"], dbl(EPS))).otherwise(v)))
    return F.when(some, change).otherwise(zscore(a))


def clip(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(v, hi), lo)


def ct(a: Column, stats: Column) -> Column:
    """stats: struct(mean, std, lo, hi) of the data set."""
    return F.transform(a, lambda v: (clip(v, stats["lo"], stats["hi"]) - stats["mean"]) / F.greatest(stats["std"], dbl(EPS)))


def min_max(a: Column, lo: float, hi: float) -> Column:
    if not lo < hi:
        raise ValueError("min-max normalisation needs lo < hi")
    return F.transform(a, lambda v: (clip(v, dbl(lo), dbl(hi)) - dbl(lo)) / dbl(max(hi - lo, EPS)))


def rescale_01(a: Column) -> Column:
    return let(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), lambda s: F.transform(a, lambda v: (v - s["lo"]) / F.greatest(s["hi"] - s["lo"], dbl(EPS))))


def rgb_01(a: Column) -> Column:
    return F.transform(a, lambda v: v / dbl(255))


def unchanged(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("float").cast("double"))


def inverse_standard(a: Column, stats: Column) -> Column:
    return F.transform(a, lambda v: v * F.greatest(stats["std"], dbl(EPS)) + stats["mean"])


def inverse_min_max(a: Column, lo: float, hi: float) -> Column:
    return F.transform(a, lambda v: v * dbl(max(hi - lo, EPS)) + dbl(lo))


NORMALIZERS = {"zscorenormalization": zscore, "zscore": zscore, "z_score": zscore, "nonormalization": unchanged, "nonorm": unchanged, "none": unchanged, "rescaleto01normalization": rescale_01, "rescale_to_0_1": rescale_01, "rescale01": rescale_01, "rgbto01normalization": rgb_01, "rgb_to_0_1": rgb_01}


def normalizer(name: str):
    try:
        return NORMALIZERS[name.casefold()]
    except KeyError:
        raise ValueError(f"unknown normalisation {name!r}") from None
