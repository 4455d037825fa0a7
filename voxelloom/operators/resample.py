"""Resampling of array volumes by half-pixel interpolation.

Orders 0 and 1 are literal index and weight tables per axis, applied in Catalyst without a
shuffle; order 3 is a dense matrix per axis in an Arrow function. A table depends on two
lengths only, so it is tiny beside the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.columns import dbl


def taps(n_in: int, n_out: int, order: int) -> list[list[tuple[int, float]]]:
    """(input index, weight) of each output index."""
    out = []
    for o in range(n_out):
        src = (o + 0.5) * n_in / n_out - 0.5
        if order == 0:
            out.append([(min(max(math.floor(src + 0.5), 0), n_in - 1), 1.0)])
        else:
            lo = math.floor(src)
            w = src - lo
            out.append([(min(max(lo, 0), n_in - 1), 1.0 - w), (min(max(lo + 1, 0), n_in - 1), w)])
    return out


def resample(data: Column, shape: tuple[int, ...], target: tuple[int, ...], order: int = 1) -> Column:
    """Separable, one axis after the other, each a transform over a literal table."""
    if tuple(shape) == tuple(target):
        return data
    size = list(shape)
    for axis, n_out in enumerate(target):
        if size[axis] == n_out:
            continue
        table = taps(size[axis], n_out, order)
        n_in, inner, outer = size[axis], math.prod(size[axis + 1 :]), math.prod(size[:axis])
        first = F.array(*[F.lit(c[0][0]) for c in table])
        last = F.array(*[F.lit(c[-1][0]) for c in table])
        weight = F.array(*[dbl(c[-1][1]) for c in table])
        cells = F.sequence(F.lit(0), F.lit(outer * n_out * inner - 1))

        data = F.element_at(F.transform(F.array(data), _axis_pass(n_in, n_out, inner, cells, first, last, weight, order)), 1)
        size[axis] = n_out
    return data


def _axis_pass(n_in: int, n_out: int, inner: int, cells: Column, first: Column, last: Column, weight: Column, order: int):
    """The pass over one axis as a function of the bound array, so that it is evaluated once and not per voxel."""

    def body(d: Column) -> Column:
        def value(o: Column, i: Column) -> Column:
            return F.element_at(d, ((F.floor(o / (n_out * inner)) * n_in + i) * inner + o % inner + 1).cast("int"))

        def cell(o: Column) -> Column:
            k = (F.floor(o / inner) % n_out + 1).cast("int")
            if order == 0:
                return value(o, F.element_at(first, k))
            w = F.element_at(weight, k)
            return value(o, F.element_at(first, k)) * (dbl(1) - w) + value(o, F.element_at(last, k)) * w

        return F.transform(cells, cell)

    return body


def resample_labels(data: Column, shape, target, labels: list[int], order: int = 1) -> Column:
    """Each label's mask is interpolated; where it reaches a half it is set, later labels winning."""
    if order == 0:
        return resample(data, shape, target, 0)
    out = None
    for label in sorted(labels):
        share = resample(F.transform(data, lambda v: (v == label).cast("double")), shape, target, 1)
        one = F.transform(share, lambda w: F.when(w >= dbl(0.5), F.lit(label)))
        out = one if out is None else F.zip_with(out, one, lambda a, b: F.coalesce(b, a))
    return F.transform(out, lambda v: F.coalesce(v, F.lit(0)))


@lru_cache
def cubic_matrix(n_in: int, n_out: int) -> np.ndarray:
    """Cubic B-spline interpolation with edge padding, as an n_out x n_in matrix."""
    pad = 12
    n = n_in + 2 * pad
    a = np.diag(np.full(n, 4 / 6)) + np.diag(np.full(n - 1, 1 / 6), 1) + np.diag(np.full(n - 1, 1 / 6), -1)
    a[0, 1] += 1 / 6
    a[-1, -2] += 1 / 6
    edge = np.zeros((n, n_in))
    edge[np.arange(n), np.clip(np.arange(n) - pad, 0, n_in - 1)] = 1
    coefficients = np.linalg.solve(a, edge)
    out = np.zeros((n_out, n_in))
    for o in range(n_out):
        src = (o + 0.5) * n_in / n_out - 0.5 + pad
        for k in range(math.floor(src) - 1, math.floor(src) + 3):
            t = abs(src - k)
            w = (2 / 3 - t * t + t**3 / 2) if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0
            out[o] += w * coefficients[min(max(k, 0), n - 1)]
    return out


def resample_cubic(volumes: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], separate: int | None = None, order_z: int = 0) -> DataFrame:
    """(case_id, data) with cubic interpolation, clipped to the input's range; `separate`: an axis done in order_z."""

    def matrix(axis: int) -> np.ndarray:
        if axis != separate:
            return cubic_matrix(shape[axis], target[axis]) if shape[axis] != target[axis] else np.eye(shape[axis])
        out = np.zeros((target[axis], shape[axis]))
        for o, cells in enumerate(taps(shape[axis], target[axis], order_z)):
            for i, w in cells:
                out[o, i] += w
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mz, my, mx = map(matrix, range(3))
        for pdf in batches:
            cubes = np.stack(pdf["data"].to_numpy()).reshape(-1, *shape) if len(pdf) else np.zeros((0, *shape))
            made = np.einsum("az,by,cx,nzyx->nabc", mz, my, mx, cubes, optimize=True)
            low, high = (f(cubes, axis=(1, 2, 3), keepdims=True) if len(pdf) else 0 for f in (np.min, np.max))
            yield pd.DataFrame({"case_id": pdf["case_id"], "data": list(np.clip(made, low, high).reshape(len(pdf), -1))})

    return volumes.select("case_id", "data").mapInPandas(run, "case_id long, data array<double>")
