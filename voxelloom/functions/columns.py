"""Column helpers: binding, names, arrays."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDINGS = r"(?i)\.(nii\.gz|nii|nrrd|mha|gipl|tiff|tif|png|bmp)$"
MULTI = r"^(.+_\d{4})_(\d{4})$"
EPS = 1e-8
SCHEMES = {"ct": "CTNormalization", "zscore": "ZScoreNormalization", "nonorm": "NoNormalization", "rescale_to_0_1": "RescaleTo01Normalization", "rgb_to_0_1": "RGBTo01Normalization"}


def endings(of: tuple[str, ...]) -> str:
    """A pattern like ENDINGS for other endings."""
    return rf"(?i)({'|'.join(map(re.escape, of))})$"


def dbl(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body: an inlined expression would run once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, dbl(0), lambda s, v: s + v)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + dbl(0)


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, ENDINGS, "")


def file_ending(name: Column) -> Column:
    return F.lower(F.concat(F.lit("."), F.regexp_extract(name, ENDINGS, 1)))


def case_of(name: Column) -> Column:
    return F.regexp_extract(strip_suffix(name), MULTI, 1)


def channel_of(name: Column) -> Column:
    """The channel number of a file name, null where the name has none."""
    return F.nullif(F.regexp_extract(strip_suffix(name), MULTI, 2), F.lit("")).cast("int")


def patch_key(shape: Column) -> Column:
    return F.concat_ws("x", F.transform(shape, lambda n: n.cast("string")))


def optional_float(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)).isin("none", "null"), F.lit(None)).otherwise(text).cast("double")


def scheme_of(channel: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SCHEMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(channel)), F.lit("ZScoreNormalization"))


def pad_shape(shape: Column, multiples: Column) -> Column:
    return F.zip_with(shape, multiples, lambda s, m: (F.ceil(s / m) * m).cast("int"))


def new_shape(shape: Column, old: Column, new: Column) -> Column:
    """round-half-even of old / new * n on each axis."""
    return F.zip_with(shape, F.zip_with(old, new, lambda a, b: a / b), lambda n, r: F.rint(r * n).cast("int"))


def anisotropic(spacing: Column, threshold: float = 3.0) -> Column:
    return F.array_max(spacing) / F.array_min(spacing) > dbl(threshold)


def lowres_axes(spacing: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(spacing) - 1), lambda i: F.element_at(spacing, i + 1) == F.array_max(spacing))


def separate_axis(current: Column, new: Column, force: bool | None = None, threshold: float = 3.0) -> Column:
    """The axis that is resampled apart, or null: the one coarse axis of the current, else of the new spacing."""
    if force is False:
        return F.lit(None).cast("int")
    one = lambda s: F.when(F.size(lowres_axes(s)) == 1, F.element_at(lowres_axes(s), 1))
    if force:
        return one(current)
    return F.when(anisotropic(current, threshold), one(current)).when(anisotropic(new, threshold), one(new))


def transpose_forward(spacing: Column) -> Column:
    """The coarsest axis first (the first of ties), the others in order."""
    worst = F.array_position(spacing, F.array_max(spacing)).cast("int") - 1
    axes = F.sequence(F.lit(0), F.size(spacing) - 1)
    return F.concat(F.array(worst), F.filter(axes, lambda i: i != worst))


def sliding_starts(size: Column, patch: Column, overlap: float) -> Column:
    step = F.greatest(F.lit(1), F.rint(patch * dbl(1 - overlap)).cast("int"))
    last = size - patch
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), step), F.array(last))))


def start_bounds(place: Column, size: Column, patch: Column) -> Column:
    """Least and greatest start of a patch that holds the place."""
    inside = F.struct(F.greatest(F.lit(0), place - patch + 1).alias("lo"), F.least(place, size - patch).alias("hi"))
    return F.when(size <= patch, F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))).otherwise(inside)
