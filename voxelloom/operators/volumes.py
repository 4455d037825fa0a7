"""Volumes (a row each, voxels in an array) and their voxel view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.columns import let


def voxels(volumes: DataFrame, data: str = "data", shape: tuple[int, int, int] = (4, 4, 4), value: str = "v", keep: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One row per voxel: keep, z, y, x, value."""
    _, ny, nx = shape
    rows = volumes.select(*keep, F.posexplode(data).alias("_p", value))
    return rows.select(*keep, F.expr(f"cast(_p div {ny * nx} as int)").alias("z"), F.expr(f"cast(_p div {nx} % {ny} as int)").alias("y"), F.expr(f"cast(_p % {nx} as int)").alias("x"), value)


def transposed(data: Column, shape: tuple[int, ...], forward: tuple[int, ...]) -> Column:
    """Permute the axes of a C-ordered array by index arithmetic."""
    out = [shape[f] for f in forward]
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]

    def source(o: Column) -> Column:
        index = F.lit(0)
        for k, f in enumerate(forward):
            index = index + F.floor(o / math.prod(out[k + 1 :])) % out[k] * strides[f]
        return (index + 1).cast("int")

    places = F.transform(F.sequence(F.lit(0), F.lit(math.prod(shape) - 1)), source)
    return let(data, lambda d: F.transform(places, lambda i: F.element_at(d, i)))


def ball(radius: int = 1) -> list[tuple[int, int, int]]:
    """Offsets of the cross-shaped neighbourhood, its centre included."""
    axes = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    return [(0, 0, 0), *[tuple(s * r * c for c in a) for a in axes for s in (-1, 1) for r in range(1, radius + 1)]]


def dilate(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """mask(case_id, z, y, x) of set voxels: they and their face neighbours in the grid."""
    steps = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("zyx", o, strict=True)]) for o in ball()])
    near = mask.withColumn("_o", F.explode(steps)).select("case_id", *[(F.col(n) + F.col(f"_o.{n}")).alias(n) for n in "zyx"])
    inside = F.lit(True)
    for n, size in zip("zyx", shape, strict=True):
        inside &= F.col(n).between(0, size - 1)
    return near.where(inside).distinct()


def erode(mask: DataFrame) -> DataFrame:
    """Voxels whose whole neighbourhood is set; outside the grid counts as unset."""
    steps = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("zyx", o, strict=True)]) for o in ball()])
    near = mask.withColumn("_o", F.explode(steps)).select("case_id", *[(F.col(n) - F.col(f"_o.{n}")).alias(n) for n in "zyx"])
    return near.groupBy("case_id", "z", "y", "x").count().where(F.col("count") == len(ball())).drop("count")


def close(mask: DataFrame, shape: tuple[int, int, int], times: int = 1) -> DataFrame:
    for _ in range(times):
        mask = dilate(mask, shape)
    for _ in range(times):
        mask = erode(mask)
    return mask
