"""Mask kernels that relational operators cannot express well, as Arrow functions over volumes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def shifts(ndim: int) -> Iterator[tuple[int, int]]:
    for axis in range(ndim):
        yield axis, 1
        yield axis, -1


def shifted(a: np.ndarray, axis: int, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    src, dst = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    src[axis], dst[axis] = (slice(None, -1), slice(1, None)) if by > 0 else (slice(1, None), slice(None, -1))
    out[tuple(dst)] = a[tuple(src)]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 by face connectivity, numbered by first voxel; 0 outside.

    Runs along the last axis are the nodes and touching runs the edges of a union-find whose roots
    hook onto smaller roots, so the passes grow with the logarithm of the number of runs.
    """
    if not mask.any():
        return np.zeros(mask.shape, np.int64)
    opens = mask.copy()
    opens[..., 1:] &= ~mask[..., :-1]
    run = np.cumsum(opens.ravel()).reshape(mask.shape) - 1  # of the set voxels
    parent = np.arange(int(run.max()) + 1)
    pairs = []
    for axis in range(mask.ndim - 1):
        a, b = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
        a[axis], b[axis] = slice(None, -1), slice(1, None)
        both = mask[tuple(a)] & mask[tuple(b)]
        pairs.append(np.stack([run[tuple(a)][both], run[tuple(b)][both]]))
    edges = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    while edges.shape[1]:
        roots = parent[edges]
        edges = edges[:, roots[0] != roots[1]]
        roots = roots[:, roots[0] != roots[1]]
        np.minimum.at(parent, roots.max(axis=0), roots.min(axis=0))
        while (parent != parent[parent]).any():
            parent = parent[parent]
    label = np.searchsorted(np.unique(parent), parent) + 1  # a root is its component's first run
    return np.where(mask, label[np.maximum(run, 0)], 0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that no path of faces leads to the border becomes set."""
    open_ = np.pad(~mask, 1, constant_values=True)
    lab = components(open_)
    return ~(lab == lab.flat[0])[tuple([slice(1, -1)] * mask.ndim)]


def largest(mask: np.ndarray) -> np.ndarray:
    if not mask.any():
        return mask
    lab = components(mask)
    return lab == np.bincount(lab[mask]).argmax()


def closing(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for grow in (True, False):
        for _ in range(times):
            parts = [mask, *(shifted(mask, axis, by, False) for axis, by in shifts(mask.ndim))]
            mask = np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)
    return mask


def postprocess(mask: np.ndarray, fill: bool = True, times: int = 1, keep_largest: bool = True) -> np.ndarray:
    if fill:
        mask = fill_holes(mask)
    if times:
        mask = closing(mask, times)
    if keep_largest:
        mask = largest(mask)
    return fill_holes(mask) if fill else mask


def over_volumes(volumes: DataFrame, shape: tuple[int, int, int], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(case_id, mask) with the kernel applied to each row's mask array<boolean>, volume by volume; an Arrow batch of them is in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"case_id": pdf["case_id"], "mask": [kernel(np.asarray(m, bool).reshape(shape)).ravel() for m in pdf["mask"]]})

    return volumes.select("case_id", "mask").mapInPandas(run, "case_id long, mask array<boolean>")
