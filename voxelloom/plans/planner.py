"""Planning arithmetic on the driver: a handful of numbers per data set, not per voxel."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

MIN_EDGE, MIN_BATCH, COVERED, ANISOTROPY = 4, 2, 0.05, 3.0
#: By dimensions: the voxels of a reference patch, its batch, and the most voxels of a patch.
REFERENCE = {2: (2048**2, 12, 2048**2), 3: (256**3, 2, 256**3 // 4)}


@dataclass
class Resampling:
    image_order: int = 3
    image_order_z: int = 0
    label_order: int = 0
    label_order_z: int = 0
    force_separate_z: bool | None = None
    anisotropy_threshold: float = ANISOTROPY

    def __post_init__(self):
        if min(self.image_order, self.image_order_z, self.label_order, self.label_order_z) < 0 or self.anisotropy_threshold <= 0:
            raise ValueError("orders must not be negative and the threshold must be positive")


@dataclass
class Config:
    spacing: list[float]
    transpose_forward: list[int]
    schemes: list[str]
    use_mask: list[bool]
    stats: dict[str, dict] = field(default_factory=dict)
    resampling: Resampling = field(default_factory=Resampling)

    def __post_init__(self):
        if not all(math.isfinite(s) and s > 0 for s in self.spacing):
            raise ValueError("spacing must be finite and positive")
        if sorted(self.transpose_forward) != list(range(len(self.spacing))):
            raise ValueError("transpose_forward must be a permutation of the axes")
        if len(self.schemes) != len(self.use_mask):
            raise ValueError("one scheme and one mask flag are needed for each channel")


def inherit(configurations: dict[str, dict], name: str, seen: tuple[str, ...] = ()) -> dict:
    """A configuration with its ancestors' entries, its own winning."""
    if name in seen:
        raise ValueError(f"configurations inherit in a circle: {name}")
    own = configurations[name]
    parent = own.get("inherits_from")
    return {**(inherit(configurations, parent, (*seen, name)) if parent else {}), **own}


def target_spacing(medians: list[float], shape_medians: list[float], p10: list[float], override: list[float] | None = None) -> list[float]:
    """Per-axis medians; a very coarse and short worst axis takes its 10th percentile, kept above the others."""
    if override is not None:
        return list(override)
    out = list(medians)
    if len(out) == 3:
        worst = int(np.argmax(out))
        rest = [k for k in range(3) if k != worst]
        if out[worst] > ANISOTROPY * max(out[k] for k in rest) and shape_medians[worst] * ANISOTROPY < min(shape_medians[k] for k in rest):
            out[worst] = p10[worst]
            if out[worst] < (most := max(out[k] for k in rest)):
                out[worst] = most + 1e-5
    return out


def pools(spacing, patch, most: int = 999) -> tuple[list[int], list[list[int]], list[int], list[int]]:
    """Pool counts per axis, kernels per stage, the padded patch and its divisors."""
    spacing, size = [float(s) for s in spacing], [int(n) for n in patch]
    counts, kernels, kernel = [0] * len(size), [], [1] * len(size)
    while True:
        for k in range(len(size)):
            if spacing[k] / min(spacing) < 2:
                kernel[k] = 3
        kernels.append(list(kernel))
        long_ = [k for k in range(len(size)) if size[k] >= 2 * MIN_EDGE]
        if not long_:
            break
        finest = min(spacing[k] for k in long_)
        chosen = [k for k in long_ if spacing[k] / finest < 2 and counts[k] < most]
        if not chosen or (len(chosen) == 1 and size[chosen[0]] < 3 * MIN_EDGE):
            break
        for k in chosen:
            counts[k] += 1
            size[k] = math.ceil(size[k] / 2)
            spacing[k] *= 2
    divisors = [2**c for c in counts]
    return counts, kernels, [math.ceil(n / d) * d for n, d in zip(patch, divisors, strict=True)], divisors


def patch_and_batch(spacing, median_shape, cases: int) -> tuple[list[int], int]:
    """A patch of equal extent in millimetres, shrunk until it fits, and a batch size.

    The axis that covers most of the median shape shrinks, the last of equals, by its divisor
    before and after pooling is settled anew; none goes below twice the least edge.
    """
    dims = len(spacing)
    volume, base_batch, fits = REFERENCE[dims]
    inverse = [1 / s for s in spacing]
    edge = (volume / math.prod(inverse)) ** (1 / dims)
    patch = [min(round(v * edge), int(m)) for v, m in zip(inverse, median_shape, strict=True)]
    patch, divisors = pools(spacing, patch)[2:]
    while math.prod(patch) > fits:
        axis = max(range(dims), key=lambda k: (patch[k] / median_shape[k], k))
        less, by = list(patch), divisors
        for _ in range(2):
            less[axis] -= by[axis]
            if less[axis] < 2 * MIN_EDGE:
                break
            by = pools(spacing, less)[3]
        if less[axis] < 2 * MIN_EDGE:
            break
        patch, divisors = pools(spacing, less)[2:]
    voxels = max(1, math.prod(patch))
    batch = min(round(volume / voxels * base_batch), round(cases * math.prod(median_shape) * COVERED / voxels))
    return patch, max(batch, MIN_BATCH)


def split_counts(n: int, ratio: float) -> int:
    """Validation cases among n."""
    if ratio <= 0:
        return 0
    if n < 2 or ratio >= 1:
        raise ValueError("a split needs two cases and a ratio below 1")
    return min(max(1, round(n * ratio)), n - 1)


STAGES = {"train", "predict", "predict_and_evaluate"}
REFERENCE_RULE = {
    ("segmentation", "train"): "required", ("segmentation", "predict"): "forbidden", ("segmentation", "predict_and_evaluate"): "required",
    ("paired_generative", "train"): "required", ("paired_generative", "predict"): "forbidden", ("paired_generative", "predict_and_evaluate"): "required",
    ("unpaired_generative", "train"): "forbidden", ("unpaired_generative", "predict"): "forbidden", ("self_supervised", "train"): "forbidden",
}


def check_request(task: str, stage: str, has_reference: bool) -> None:
    rule = REFERENCE_RULE.get((task, stage))
    if rule is None:
        raise ValueError(f"{task} does not support {stage}")
    if (rule == "required") != has_reference:
        raise ValueError(f"a reference is {rule} for {task} in {stage}")


def transpose_axes(spacing: list[float]) -> tuple[list[int], list[int]]:
    """Coarsest axis first, and the permutation that undoes it."""
    worst = int(np.argmax(spacing)) if len(spacing) == 3 else 0
    forward = [worst, *(k for k in range(len(spacing)) if k != worst)]
    return forward, [int(k) for k in np.argsort(forward)]


SCHEME_NAMES = {"ct": "CTNormalization", "zscore": "ZScoreNormalization", "nonorm": "NoNormalization", "rescale_to_0_1": "RescaleTo01Normalization", "rgb_to_0_1": "RGBTo01Normalization"}


def channel_names(dataset: dict | None, n: int) -> list[str]:
    """The names that the data set description gives its channels, in numeric order; z-score without any."""
    listed = (dataset or {}).get("channel_names") or (dataset or {}).get("modality")
    if not listed:
        return ["zscore"] * n
    if len(listed) != n:
        raise ValueError(f"{len(listed)} channel names for {n} channels")
    return [listed[k] for k in sorted(listed, key=int)]


def schemes(names: list[str]) -> list[str]:
    return [SCHEME_NAMES.get(n.lower(), "ZScoreNormalization") for n in names]


def configurations(spacing: list[float], median_shape: list[float], cases: int) -> dict[str, dict]:
    """3d, and 2d over the last two axes: spacing, median shape, patch and batch."""
    out = {}
    for name, last in (("3d", len(spacing)), ("2d", 2)):
        s, m = [float(v) for v in spacing[-last:]], [int(round(v)) for v in median_shape[-last:]]
        patch, batch = patch_and_batch(s, m, cases)
        out[name] = {"spacing": s, "median_shape": m, "patch_size": patch, "batch_size": batch}
    return out


def default_configuration(found: dict[str, dict]) -> str | None:
    return next((n for n in ("3d", "2d", *found) if n in found), None)


def merge_configurations(a: dict[str, dict], b: dict[str, dict]) -> dict[str, dict]:
    """Those of both domains, with the smaller patch on each axis and the smaller batch."""
    return {n: {**a[n], "patch_size": [min(p, q) for p, q in zip(a[n]["patch_size"], b[n]["patch_size"], strict=True)], "batch_size": min(a[n]["batch_size"], b[n]["batch_size"])} for n in a if n in b}


def override_schemes(config: Config, method: str, lo: float | None = None, hi: float | None = None) -> Config:
    """One scheme for every channel; only z-scores keep the mask, min-max needs both bounds."""
    from dataclasses import replace

    if (lo is not None or hi is not None) and method.lower() not in ("minmax", "min_max", "minmaxclipnormalization"):
        raise ValueError("bounds of normalisation go with the min-max scheme alone")
    if method == "auto":
        return config
    scheme = {"minmax": "MinMaxClipNormalization", "min_max": "MinMaxClipNormalization", **SCHEME_NAMES}.get(method.lower())
    if scheme is None:
        raise ValueError(f"unknown normalisation {method!r}")
    n, stats = len(config.schemes), config.stats
    if scheme == "MinMaxClipNormalization":
        if lo is None or hi is None or lo >= hi:
            raise ValueError("min-max normalisation needs lo < hi")
        stats = {str(k): {**stats.get(str(k), {}), "clip_min": lo, "clip_max": hi} for k in range(n)}
    return replace(config, schemes=[scheme] * n, use_mask=config.use_mask if scheme == "ZScoreNormalization" else [False] * n, stats=stats)


def config_from_json(text: str | dict, name: str | None = None) -> Config:
    """A configuration, or one of a plans file: there `name` is required and parents are merged in."""
    import json

    raw = json.loads(text) if isinstance(text, str) else text
    if ("configurations" in raw) != (name is not None):
        raise ValueError("a configuration name goes with a plans file, and only with one")
    if name is None:
        return Config(raw["spacing"], raw["transpose_forward"], raw["normalization_schemes"], raw["use_mask_for_norm"], raw.get("foreground_intensity_properties_per_channel") or {}, Resampling(**raw.get("resampling", {})))
    own = inherit(raw["configurations"], name)
    data, seg = own.get("resampling_fn_data_kwargs", {}), own.get("resampling_fn_seg_kwargs", {})
    r = Resampling(data.get("order", 3), data.get("order_z", 0), seg.get("order", 0), seg.get("order_z", 0), data.get("force_separate_z"))
    return Config(own["spacing"], raw["transpose_forward"], own["normalization_schemes"], own["use_mask_for_norm"], raw.get("foreground_intensity_properties_per_channel") or {}, r)


def config_to_json(config: Config) -> str:
    import json
    from dataclasses import asdict

    c = config
    return json.dumps({"spacing": c.spacing, "transpose_forward": c.transpose_forward, "normalization_schemes": c.schemes, "use_mask_for_norm": c.use_mask, "foreground_intensity_properties_per_channel": c.stats, "resampling": asdict(c.resampling)}, sort_keys=True)
