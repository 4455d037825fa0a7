"""Axes of volumes in the world.

An affine is 3 x 4, row by row: it takes (x, y, z) indices to millimetres towards right, anterior
and superior. Files that count towards left and posterior are turned into that when they are read.
Arrays are (z, y, x), with channels before them or without.
"""

from __future__ import annotations

import numpy as np


def axes_of(affine: np.ndarray) -> list[tuple[int, int]]:
    """For right, anterior and superior: the data axis (x, y, z as 0, 1, 2) that runs along it, and its sign.

    The rotation nearest to the affine decides, its largest cosines first, so oblique volumes have an answer too.
    """
    cols = affine[:, :3] / np.maximum(np.linalg.norm(affine[:, :3], axis=0), 1e-12)
    u, _, vt = np.linalg.svd(cols)
    cosines = u @ vt
    left, found = np.abs(cosines), {}
    for _ in range(3):
        world, axis = np.unravel_index(int(left.argmax()), left.shape)
        found[int(world)] = (int(axis), 1 if cosines[world, axis] >= 0 else -1)
        left[world, :] = left[:, axis] = -1.0
    return [found[w] for w in range(3)]


def _reversed(data: np.ndarray) -> np.ndarray:
    """The last three axes the other way round."""
    lead = data.ndim - 3
    return data.transpose([*range(lead), lead + 2, lead + 1, lead])


def to_ras(data: np.ndarray, spacing: list[float], affine: list[float]) -> tuple[np.ndarray, list[float], list[float]]:
    """The volume with its axes towards right, anterior and superior; the voxels stay where they are in the world."""
    old = np.array(affine, float).reshape(3, 4)
    places, lead = axes_of(old), data.ndim - 3
    order = [axis for axis, _ in places]
    out = _reversed(data).transpose([*range(lead), *(lead + axis for axis in order)])
    new = np.concatenate([old[:, order], old[:, 3:]], axis=1)
    for k, (_, sign) in enumerate(places):
        if sign < 0:
            out = np.flip(out, lead + k)
            new[:, 3] += new[:, k] * (out.shape[lead + k] - 1)
            new[:, k] *= -1
    turned = [spacing[::-1][axis] for axis in order]
    return np.ascontiguousarray(_reversed(out)), turned[::-1], new.ravel().tolist()


def from_ras(data: np.ndarray, spacing: list[float], original: list[float]) -> tuple[np.ndarray, list[float]]:
    """What `to_ras` turned, back on the axes of the original affine."""
    places, lead = axes_of(np.array(original, float).reshape(3, 4)), data.ndim - 3
    out = _reversed(data)
    for k, (_, sign) in enumerate(places):
        out = np.flip(out, lead + k) if sign < 0 else out
    back = np.argsort([axis for axis, _ in places]).tolist()
    out = out.transpose([*range(lead), *(lead + k for k in back)])
    return np.ascontiguousarray(_reversed(out)), [spacing[::-1][k] for k in back][::-1]


def from_lps(spacing: list[float], directions: np.ndarray | None = None, origin: list[float] | None = None) -> list[float]:
    """The affine of x, y, z spacings, unit vectors of the axes as columns and an origin, counted towards left and posterior.

    Two dimensions lie in the first two axes of the world.
    """
    n = len(spacing)
    cols, place = np.eye(3), np.zeros(3)
    cols[:n, :n] = np.eye(n) if directions is None else directions
    place[:n] = 0.0 if origin is None else origin[:n]
    out = np.concatenate([cols * np.array([*spacing, *[1.0] * (3 - n)]), place[:, None]], axis=1)
    out[:2] *= -1
    return (out + 0.0).ravel().tolist()


def to_lps(affine: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the axes as columns, origin), counted towards left and posterior."""
    a = np.array(affine, float).reshape(3, 4)
    a[:2] *= -1
    return a[:, :3] / np.maximum(np.linalg.norm(a[:, :3], axis=0), 1e-12) + 0.0, a[:, 3] + 0.0
