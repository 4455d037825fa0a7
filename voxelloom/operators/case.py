"""One case in NumPy: what a task does with a volume whose shape only the row knows.

Arrays are (channel, z, y, x). Resampling applies one matrix per axis: nearest, linear or cubic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from voxelloom.functions.columns import EPS
from voxelloom.operators.masks import fill_holes, postprocess
from voxelloom.operators.resample import cubic_matrix, taps
from voxelloom.plans.planner import Config, Resampling, check_request

LABEL_CAP, MASK_CAP, SEED = 10_000, 8_192, 1234


def axis_matrix(n_in: int, n_out: int, order: int) -> np.ndarray:
    if n_in == n_out:
        return np.eye(n_in)
    if order > 1:
        return cubic_matrix(n_in, n_out)
    out = np.zeros((n_out, n_in))
    for o, cells in enumerate(taps(n_in, n_out, order)):
        for i, w in cells:
            out[o, i] += w
    return out


def along(volume: np.ndarray, axis: int, matrix: np.ndarray) -> np.ndarray:
    return np.moveaxis(np.tensordot(matrix, volume, axes=(1, axis)), 0, axis)


def resize(volume: np.ndarray, target: list[int], order: int, skip: int | None = None) -> np.ndarray:
    """One channel, clipped to its own range; along the axis `skip` each slice is apart."""
    out = volume
    for axis, n in enumerate(target):
        if axis != skip and volume.shape[axis] != n:
            out = along(out, axis, axis_matrix(volume.shape[axis], n, order))
    if order < 2:
        return out
    axes = tuple(a for a in range(volume.ndim) if a != skip)
    return np.clip(out, volume.min(axis=axes, keepdims=True), volume.max(axis=axes, keepdims=True))


def resize_labels(labels: np.ndarray, target: list[int], order: int, skip: int | None = None, strict: bool = False) -> np.ndarray:
    """Labels whose share reaches a half (strict: passes it) are set, later ones winning."""
    if order == 0:
        return resize(labels, target, 0, skip)
    out = None
    for label in np.unique(labels):
        share = resize((labels == label).astype(float), target, order, skip)
        out = np.zeros(share.shape, labels.dtype) if out is None else out
        out[share > 0.5 if strict else share >= 0.5] = label
    return out


def lone_coarse_axis(spacing: list[float]) -> int | None:
    axes = [k for k, s in enumerate(spacing) if s == max(spacing)]
    return axes[0] if len(axes) == 1 else None


def separate_axis(current: list[float], new: list[float], r: Resampling) -> int | None:
    if r.force_separate_z is not None:
        return lone_coarse_axis(current) if r.force_separate_z else None
    for spacing in (current, new):
        if max(spacing) / min(spacing) > r.anisotropy_threshold:
            return lone_coarse_axis(spacing)
    return None


def resample_array(data: np.ndarray, target: list[int], current: list[float], new: list[float], r: Resampling, labels: bool = False) -> np.ndarray:
    """All channels of data on the grid `target`; the input itself if its shape is that already."""
    if list(data.shape[1:]) == list(target):
        return data
    order, order_z = (r.label_order, r.label_order_z) if labels else (r.image_order, r.image_order_z)
    axis = separate_axis(current, new, r)
    flat = [n if a != axis else data.shape[1 + a] for a, n in enumerate(target)]
    out = []
    for channel in data.astype(np.float64):
        if labels:
            made = resize_labels(channel, flat, order, axis)
            made = resize_labels(made, list(target), order_z, strict=True) if axis is not None else made
        else:
            made = resize(channel, flat, order, axis)
            made = resize(made, list(target), order_z) if axis is not None else made
        out.append(made)
    return np.stack(out).astype(data.dtype)


def new_shape(shape, old, new) -> list[int]:
    return [round(a / b * n) for n, a, b in zip(shape, old, new, strict=True)]


def normalize(channel: np.ndarray, scheme: str, stats: dict | None, mask: np.ndarray | None) -> np.ndarray:
    v, need = channel.astype(np.float64), lambda k: (stats or {}).get(k)
    if scheme == "ZScoreNormalization":
        inside = mask if mask is not None and mask.any() else np.ones(v.shape, bool)
        out = v.copy()
        out[inside] = (v[inside] - v[inside].mean()) / max(v[inside].std(), EPS)
        return out
    if scheme == "RescaleTo01Normalization":
        return (v - v.min()) / max(v.max() - v.min(), EPS)
    if scheme == "RGBTo01Normalization":
        return v / 255.0
    if scheme == "NoNormalization":
        return v
    lo = need("clip_min") if need("clip_min") is not None else need("percentile_00_5")
    hi = need("clip_max") if need("clip_max") is not None else need("percentile_99_5")
    if scheme == "CTNormalization":
        if stats is None or any(need(k) is None for k in ("mean", "std")) or lo is None or hi is None:
            raise ValueError("CT normalisation needs the data set's statistics")
        return (np.clip(v, lo, hi) - need("mean")) / max(need("std"), EPS)
    if scheme == "MinMaxClipNormalization":
        lo, hi = need("clip_min"), need("clip_max")
        if lo is None or hi is None or lo >= hi:
            raise ValueError("min-max normalisation needs lo < hi")
        return (np.clip(v, lo, hi) - lo) / max(hi - lo, EPS)
    raise ValueError(f"unknown normalisation {scheme!r}")


def inverse_normalize(channel: np.ndarray, scheme: str, stats: dict | None) -> np.ndarray:
    """Back to intensities; z-scores go back with the data set's statistics."""
    v = channel.astype(np.float64)
    if scheme == "NoNormalization":
        return v
    if scheme in ("CTNormalization", "ZScoreNormalization"):
        return v * max(stats["std"], EPS) + stats["mean"]
    if scheme == "MinMaxClipNormalization":
        return v * max(stats["clip_max"] - stats["clip_min"], EPS) + stats["clip_min"]
    raise ValueError(f"{scheme} has no inverse")


def nonzero_mask(image: np.ndarray) -> np.ndarray:
    """Voxels that are not 0 in some channel, holes filled."""
    return fill_holes(image.astype(bool).any(axis=0))


def intensity_properties(image: np.ndarray, nonzero: bool = True, lo: float | None = None, hi: float | None = None) -> list[dict[str, float]]:
    """Statistics of each channel over the nonzero mask, or over all voxels where that is empty; bounds clip first."""
    mask = nonzero_mask(image) if nonzero else np.ones(image.shape[1:], bool)
    if not mask.any():
        mask[:] = True
    out = []
    for channel in image:
        v = channel[mask].astype(np.float64)
        v = v if lo is None and hi is None else np.clip(v, lo, hi)
        low, median, high = np.percentile(v, [0.5, 50, 99.5])
        out.append({"mean": v.mean(), "std": v.std(), "min": v.min(), "max": v.max(), "median": median, "percentile_00_5": low, "percentile_99_5": high})
    return out


@dataclass
class MaskRules:
    """Where patches may lie: external masks and thresholds are united, then cleaned."""

    image_threshold: float | None = None
    target_threshold: float | None = None
    fill: bool = True
    keep_largest: bool = True
    closing: int = 1


@dataclass
class Settings:
    transpose: bool = True
    normalize: bool = True
    resample: bool = True
    keep_target: bool = True
    locations: bool = True

    @classmethod
    def of(cls, task: str) -> Settings:
        return cls() if task == "segmentation" else cls(keep_target=task == "paired_generative", locations=False)


def thresholds(common: float | None, own: dict[str, float | None]) -> dict[str, float | None]:
    """A side's own threshold, even none, goes before the common one."""
    return {side: own.get(side, common) for side in ("image", "target")}


def check_case(image: np.ndarray, spacing: list[float], config: Config) -> None:
    if image.ndim != 4 or 0 in image.shape:
        raise ValueError("an image needs channels and three axes, none of them empty")
    if not np.isfinite(image).all():
        raise ValueError("an image must be finite")
    if len(spacing) != 3 or not all(np.isfinite(s) and s > 0 for s in spacing):
        raise ValueError("spacing must be three finite and positive numbers")
    if len(config.schemes) != len(image):
        raise ValueError(f"{len(config.schemes)} schemes for {len(image)} channels")


def sampling_mask(image, reference, masks, rules: MaskRules, task: str) -> np.ndarray | None:
    """Boolean (z, y, x), or none: everywhere."""
    found = [m != 0 for m in masks if m is not None]
    for array, level in ((image, rules.image_threshold), (reference, rules.target_threshold)):
        if array is not None and level is not None:
            found.append((array > level).any(axis=0))
    if not found and task == "segmentation" and reference is not None:
        found.append((reference != 0).any(axis=0))
    if not found:
        return None
    return postprocess(np.logical_or.reduce(found), rules.fill, rules.closing, rules.keep_largest)


def pick(places: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    return places if len(places) <= cap else places[np.sort(rng.choice(len(places), cap, replace=False))]


def run_case(image: np.ndarray, spacing: list[float], config: Config, *, task: str = "segmentation", stage: str = "train", reference: np.ndarray | None = None, masks: tuple = (), rules: MaskRules | None = None, settings: Settings | None = None) -> dict:
    """The preprocessed case: image, target, evaluation_reference, mask, places and what undo() needs."""
    settings, rules = settings or Settings.of(task), rules or MaskRules()
    check_case(image, spacing, config)
    check_request(task, stage, reference is not None)
    if reference is not None:
        if reference.shape[1:] != image.shape[1:]:
            raise ValueError("image and reference differ in shape")
        if task == "segmentation" and len(reference) != 1:
            raise ValueError("a segmentation has one channel")
    kept_raw = stage == "predict_and_evaluate"
    target = None if kept_raw else reference
    mask = sampling_mask(image, reference, masks, rules, task)
    forward = config.transpose_forward if settings.transpose else [0, 1, 2]

    def turned(a):
        return None if a is None else np.transpose(a, [0, *(1 + f for f in forward)])

    image, target = turned(image.astype(np.float32)), turned(target)
    mask = None if mask is None else np.transpose(mask, forward)
    spacing = [spacing[f] for f in forward]
    before = list(image.shape[1:])
    paired = task == "paired_generative" and target is not None
    out = image
    if settings.normalize:
        inside = None
        if any(config.use_mask):
            inside = nonzero_mask(np.concatenate([image, target]) if paired else image)
        norm = lambda a: np.stack([normalize(c, s, config.stats.get(str(k)), inside if u else None) for k, (c, s, u) in enumerate(zip(a, config.schemes, config.use_mask, strict=True))]).astype(np.float32)
        out, target = norm(image), norm(target) if paired else target
    after = list(spacing)
    if settings.resample:
        after = [float(s) for s in config.spacing]
        grid = new_shape(before, spacing, after)
        r = config.resampling
        if mask is not None:
            mask = resample_array(mask[None].astype(np.float32), grid, spacing, after, r, labels=True)[0] > 0
        out = resample_array(out, grid, spacing, after, r)
        target = None if target is None else resample_array(target.astype(np.float32), grid, spacing, after, r, labels=not paired)
    rng, places = np.random.default_rng(SEED), {}
    if settings.locations and target is not None and not paired:
        for label in np.unique(target):
            if label > 0:
                places[int(label)] = np.pad(pick(np.argwhere(target[0] == label), LABEL_CAP, rng), ((0, 0), (1, 0)))
    if target is not None and not paired:
        target = target.astype(np.int16 if target.max() > 127 or target.min() < -128 else np.int8)
    everywhere = np.ones(out.shape[1:], bool) if mask is None else mask
    return {
        "image": out, "target": target if settings.keep_target else None, "evaluation_reference": reference if kept_raw else None, "mask": mask,
        "class_locations": places, "mask_locations": pick(np.argwhere(everywhere), MASK_CAP, rng),
        "shape_before": before, "spacing_before": spacing, "spacing": after,
    }


def undo(prediction: np.ndarray, config: Config, shape_before: list[int], spacing_before: list[float], settings: Settings) -> np.ndarray:
    """A prediction on the preprocessed grid, back in intensities, grid and axes of the raw image."""
    out = prediction
    if settings.normalize:
        out = np.stack([inverse_normalize(c, s, config.stats.get(str(k))) for k, (c, s) in enumerate(zip(out, config.schemes, strict=False))])
    if settings.resample:
        out = resample_array(out, shape_before, [float(s) for s in config.spacing], spacing_before, config.resampling)
    if settings.transpose:
        out = np.transpose(out, [0, *(1 + k for k in np.argsort(config.transpose_forward))])
    return out.astype(np.float32)
