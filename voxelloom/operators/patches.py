"""Patches of volumes: grids, crops with padding, sampled starts, overlap averages.

Volume rows are (case_id, shape, data): shape is (c, z, y, x), data the voxels in C order. A patch
is cut from its row's own array, so no join and no shuffle is needed until predictions meet. Where
a case gives many patches they are cut by a kernel and leave in frames of a few megabytes, so a
volume is never copied once a patch.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelloom.functions.columns import dbl, sliding_starts, start_bounds

FRAME_ROWS, FRAME_BYTES = 8192, 4 << 20


def spatial(shape: Column) -> Column:
    return F.slice(shape, -3, 3)


def patch_size(size: tuple[int, ...]) -> tuple[int, int, int]:
    """Two numbers mean one slice."""
    if len(size) not in (2, 3) or min(size) < 1:
        raise ValueError("a patch has two or three positive sides")
    return (1, *size) if len(size) == 2 else tuple(size)


def grid(volumes: DataFrame, size: tuple[int, ...], overlap: float = 0.5) -> DataFrame:
    """volumes with a row per patch (patch, starts) in row-major order."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    axes = [sliding_starts(F.element_at("shape", k - 3), F.lit(p), overlap) for k, p in enumerate(patch_size(size))]
    z, y, x = axes
    places = F.flatten(F.transform(z, lambda a: F.flatten(F.transform(y, lambda b: F.transform(x, lambda c: F.array(a, b, c))))))
    return volumes.select("*", F.posexplode(places).alias("patch", "starts"))


def cropped(data: Column, shape: Column, starts: Column, size: tuple[int, ...]) -> Column:
    """The patch's voxels, channels included; what lies outside the volume is 0.

    A volume smaller than the patch is padded with zeros, half of them (rounded down) before.
    """
    pz, py, px = patch_size(size)
    side = lambda k: F.element_at(shape, k - 3)
    before = [F.floor(F.greatest(F.lit(p) - side(k), F.lit(0)) / 2).cast("int") for k, p in enumerate((pz, py, px))]
    volume = pz * py * px

    def voxel(i: Column) -> Column:
        c, rest = F.floor(i / volume), i % volume
        place = (F.floor(rest / (py * px)), F.floor(rest / px) % py, rest % px)
        at = [F.element_at(starts, k + 1) + v - before[k] for k, v in enumerate(place)]
        inside = F.lit(True)
        for k, a in enumerate(at):
            inside &= (a >= 0) & (a < side(k))
        index = ((c * side(0) + at[0]) * side(1) + at[1]) * side(2) + at[2]
        return F.when(inside, F.get(data, index.cast("int"))).otherwise(F.lit(0).cast("float"))

    channels = F.element_at(shape, 1)
    return F.transform(F.sequence(F.lit(0), channels * volume - 1), voxel)


def crop(patches: DataFrame, size: tuple[int, ...]) -> DataFrame:
    """patches(case_id, shape, data, starts, ...) with data cut to the patch."""
    return patches.withColumn("data", cropped(F.col("data"), F.col("shape"), F.col("starts"), size))


def weight(value: object) -> int:
    """About the bytes that a value of a result row takes."""
    if isinstance(value, np.ndarray):
        return value.nbytes
    if isinstance(value, dict):
        return sum(map(weight, value.values()))
    return 64 * len(value) if isinstance(value, list) else 8


def frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Result rows in frames of up to FRAME_ROWS rows or about FRAME_BYTES: a frame for each small result costs far more than the result."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(weight, row))
        if size >= FRAME_BYTES or len(held) >= FRAME_ROWS:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def fields(schema: str) -> list[str]:
    return [part.split()[0] for part in re.sub(r"<[^>]*>", "", schema).split(", ")]


def over_rows(df: DataFrame, columns: list[str], kernel: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """One row in, rows out: kernel(*values) in NumPy, a frame of results in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (out for batch in batches for values in zip(*(batch[c] for c in columns), strict=True) for out in kernel(*values))
        yield from frames(rows, fields(schema))

    return df.select(*columns).mapInPandas(run, schema)


def before(side: int, patch: int) -> int:
    """Zeros before a volume that is smaller than the patch."""
    return max(patch - side, 0) // 2


def cut_out(volume: np.ndarray, starts: list[int], sides: tuple[int, int, int]) -> np.ndarray:
    """The patch of a (c, z, y, x) volume; what lies outside is 0."""
    at = [s - before(n, p) for s, n, p in zip(starts, volume.shape[1:], sides, strict=True)]
    if all(0 <= a <= n - p for a, p, n in zip(at, sides, volume.shape[1:], strict=True)):
        return volume[(slice(None), *(slice(a, a + p) for a, p in zip(at, sides, strict=True)))].copy()
    out = np.zeros((volume.shape[0], *sides), volume.dtype)
    inside = [(max(a, 0), min(a + p, n)) for a, p, n in zip(at, sides, volume.shape[1:], strict=True)]
    if all(hi > lo for lo, hi in inside):
        out[(slice(None), *(slice(lo - a, hi - a) for a, (lo, hi) in zip(at, inside, strict=True)))] = volume[(slice(None), *(slice(lo, hi) for lo, hi in inside))]
    return out


def axis_starts(side: int, patch: int, overlap: float) -> list[int]:
    """Starts along one axis: steps of the part that does not overlap, and the last place; the rule of `sliding_starts`."""
    step = max(1, round(patch * (1 - overlap)))
    last = max(side - patch, 0)
    return [*range(0, last, step), last]


def grid_patches(volumes: DataFrame, size: tuple[int, ...], overlap: float = 0.5, model: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(case_id, shape, patch, starts, data): the patches of `grid`, cut one at a time from their volume, and put through `model`."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    sides = patch_size(size)

    def cut(case_id, shape, data) -> Iterator[tuple]:
        volume = np.asarray(data, np.float32).reshape(*map(int, shape))
        axes = [axis_starts(n, p, overlap) for n, p in zip(volume.shape[1:], sides, strict=True)]
        for k, starts in enumerate(itertools.product(*axes)):
            patch = cut_out(volume, list(starts), sides)
            yield case_id, shape, k, list(starts), (patch if model is None else np.array(model(patch), np.float32)).ravel()

    kind = volumes.schema["case_id"].dataType.simpleString()
    return over_rows(volumes, ["case_id", "shape", "data"], cut, f"case_id {kind}, shape array<int>, patch int, starts array<int>, data array<float>")


def merge(predictions: DataFrame, size: tuple[int, ...]) -> DataFrame:
    """(case_id, shape, data) from predictions(case_id, shape, starts, data): the mean over each voxel's patches; 0 where there is none.

    A volume is summed in slabs as thick as a patch, each in a task of its own with the patches
    that reach into it, at most two slabs a patch; padding is left out. Work is in proportion to
    the patches' voxels.
    """
    pz, py, px = sides = patch_size(size)
    kind = predictions.schema["case_id"].dataType.simpleString()
    start = F.element_at("starts", 1) - F.floor(F.greatest(F.lit(pz) - F.element_at("shape", -3), F.lit(0)) / 2)
    lo, hi = F.greatest(start, F.lit(0)), F.least(start + pz, F.element_at("shape", -3)) - 1
    reach = F.when(hi >= lo, F.sequence(F.floor(lo / pz), F.floor(hi / pz)))
    rows = predictions.select("case_id", "shape", "starts", "data", F.explode(reach).alias("slab"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        each = (row for pdf in batches for row in zip(*(pdf[c] for c in ("case_id", "slab", "shape", "starts", "data")), strict=True))
        for (case_id, slab), parts in itertools.groupby(each, key=lambda row: row[:2]):
            total = None
            for _, _, shape, starts, data in parts:
                if total is None:
                    whole = [int(n) for n in shape]
                    low = int(slab) * pz
                    total = np.zeros((whole[0], min(low + pz, whole[1]) - low, *whole[2:]))
                    count = np.zeros(total.shape[1:])
                at = [int(s) - before(n, p) for s, n, p in zip(starts, whole[1:], sides, strict=True)]
                at[0] -= low
                inside = [(max(a, 0), min(a + p, n)) for a, p, n in zip(at, sides, total.shape[1:], strict=True)]
                if all(b > a for a, b in inside):
                    here = tuple(slice(a, b) for a, b in inside)
                    there = tuple(slice(a - o, b - o) for (a, b), o in zip(inside, at, strict=True))
                    total[(slice(None), *here)] += np.asarray(data).reshape(-1, *sides)[(slice(None), *there)]
                    count[here] += 1
            mean = (total / np.maximum(count, 1)).astype(np.float32)
            for c, channel in enumerate(mean):
                yield case_id, whole, c, slab, channel.ravel()

    # the rows of a slab follow one another, and slabs leave many to a frame: a group for each would cost far more than its sums
    schema = f"case_id {kind}, shape array<int>, c int, slab long, part array<float>"
    near = rows.repartition("case_id", "slab").sortWithinPartitions("case_id", "slab")
    slabs = near.mapInPandas(lambda batches: frames(add(batches), fields(schema)), schema)
    # a thin patch may leave slabs without any: they are zeros
    whole = slabs.groupBy("case_id").agg(F.first("shape").alias("shape"), F.collect_list(F.struct("c", "slab", "part")).alias("parts"))

    def join(case_id, shape, parts) -> Iterator[tuple]:
        shape = [int(n) for n in shape]
        out = np.zeros(shape, np.float32)
        for part in parts:
            low = int(part["slab"]) * pz
            out[int(part["c"]), low : low + pz] = np.asarray(part["part"], np.float32).reshape(-1, *shape[2:])
        yield case_id, shape, out.ravel()

    return over_rows(whole, ["case_id", "shape", "parts"], join, f"case_id {kind}, shape array<int>, data array<float>")


def uniform(seed: int, *of: str | Column) -> Column:
    """In [0, 1), a function of the seed and columns alone, so that reruns and lost executors agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / dbl(1 << 53)


def between(lo: Column, hi: Column, u: Column) -> Column:
    return (lo + F.floor(u * (hi - lo + 1))).cast("int")


def starts_at_locations(draws: DataFrame, size: tuple[int, ...], seed: int) -> DataFrame:
    """draws(case_id, draw, shape, locations) with starts: a place is picked, then a patch around it that holds it."""
    place = F.element_at("locations", between(F.lit(1), F.size("locations"), uniform(seed, F.lit("place"), "case_id", "draw")))
    picked = draws.withColumn("_at", F.slice(place, -3, 3))
    starts = []
    for k, p in enumerate(patch_size(size)):
        b = start_bounds(F.element_at("_at", k + 1), F.element_at("shape", k - 3), F.lit(p))
        starts.append(between(b["lo"], b["hi"], uniform(seed, F.lit(k), "case_id", "draw")))
    return picked.withColumn("starts", F.array(*starts)).drop("_at")


def random_starts(draws: DataFrame, size: tuple[int, ...], seed: int) -> DataFrame:
    """draws(case_id, draw, shape) with starts, uniform over the volume."""
    starts = [between(F.lit(0), F.greatest(F.element_at("shape", k - 3) - p, F.lit(0)), uniform(seed, F.lit(k), "case_id", "draw")) for k, p in enumerate(patch_size(size))]
    return draws.withColumn("starts", F.array(*starts))


def best_of(draws: DataFrame, size: tuple[int, ...], seed: int, level: float, least: float, tries: int = 10) -> DataFrame:
    """draws(case_id, draw, shape, data): the first of `tries` random patches with a share of voxels above `level` of at least `least`, else the best."""
    tried = draws.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumnRenamed("draw", "_draw").withColumn("draw", F.col("_draw") * tries + F.col("_try"))
    n = 1
    for p in patch_size(size):
        n *= p
    box = cropped(F.col("data"), F.col("shape"), F.col("starts"), size)
    some = F.size(F.array_distinct(F.transform(F.filter(F.transform(box, lambda v, i: F.struct(v.alias("v"), (i % n).alias("i"))), lambda s: s["v"] > level), lambda s: s["i"])))
    scored = random_starts(tried, size, seed).withColumn("fraction", some / dbl(n)).drop("data", "draw")
    enough = F.col("fraction") >= dbl(least)
    order = W.partitionBy("case_id", "_draw").orderBy(F.desc(enough), F.when(enough, F.lit(0.0)).otherwise(-F.col("fraction")), "_try")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_try").withColumnRenamed("_draw", "draw")


def box_counts(mask: np.ndarray, starts: list[list[int]], sides: tuple[int, int, int]) -> np.ndarray:
    """Set voxels in the box at each combination of starts, clipped at the end, from the 8 corners of an integral image."""
    table = np.zeros([n + 1 for n in mask.shape], np.int64)
    table[1:, 1:, 1:] = mask
    for axis in range(3):
        table = table.cumsum(axis=axis)
    ends = [[np.minimum(np.array(s) + p, n), np.array(s)] for s, p, n in zip(starts, sides, mask.shape, strict=True)]
    return sum((-1) ** sum(corner) * table[np.ix_(*(e[c] for e, c in zip(ends, corner, strict=True)))] for corner in itertools.product((0, 1), repeat=3))


def valid_starts(masks: DataFrame, size: tuple[int, ...], least: float, most: int) -> DataFrame:
    """masks(case_id, shape, data): the first `most` grid starts, steps of a quarter patch, whose patch holds the share `least` of set voxels."""
    sides = patch_size(size)

    def scan(case_id, shape, data) -> Iterator[tuple]:
        mask = (np.asarray(data, float).reshape(-1, *(int(n) for n in shape[-3:])) > 0)[0]
        axes = []
        for n, p in zip(mask.shape, sides, strict=True):
            last = max(n - p, 0)
            axes.append(sorted({*range(0, last + 1, max(1, p // 4)), last}))
        counts = box_counts(mask, axes, sides)
        need = least * np.prod([min(n, p) for n, p in zip(mask.shape, sides, strict=True)])
        for k in np.flatnonzero(counts.ravel() >= need)[:most].tolist():
            yield case_id, k, [axes[d][i] for d, i in enumerate(np.unravel_index(k, counts.shape))]

    kind = masks.schema["case_id"].dataType.simpleString()
    return over_rows(masks, ["case_id", "shape", "data"], scan, f"case_id {kind}, patch int, starts array<int>")
