"""Data flow of a data set: fingerprint, plan, preprocess, predict, restore.

Case rows: case_id, shape (c, z, y, x), spacing (z, y, x), image, and where there are any
reference, ref_channels and mask, all arrays in C order. The fingerprint is a few aggregates,
planning is arithmetic on the driver, and each case is then one row of a map: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.functions import columns as C
from voxelloom.functions.columns import dbl
from voxelloom.operators import case as kernels
from voxelloom.operators import patches
from voxelloom.plans import planner
from voxelloom.plans.quantiles import exact_quantiles

PLACES = "array<array<int>>"
DONE = f"case_id string, shape array<int>, spacing array<double>, image array<float>, target_shape array<int>, target array<float>, evaluation_reference array<float>, mask array<boolean>, class_locations map<int,{PLACES}>, mask_locations {PLACES}, shape_before array<int>, spacing_before array<double>"
PROBS = [0.5, 0.005, 0.995]


def channel_values(cases: DataFrame, inside: str = "all") -> DataFrame:
    """(case_id, channel, v) of all voxels, of the foreground (reference > 0), or of the mask (all voxels where it is empty)."""
    n = F.expr("aggregate(slice(shape, 2, 3), 1, (s, k) -> s * k)")
    keep = {"all": None, "foreground": F.transform("reference", lambda v: v > 0), "mask": F.col("mask")}[inside]
    values = lambda c: F.slice("image", c * n + 1, n)
    if keep is None:
        own = values
    else:
        chosen = lambda c: F.filter(F.zip_with(values(c), F.slice(keep, 1, n), lambda v, m: F.when(m, v)), lambda v: v.isNotNull())
        own = chosen if inside == "foreground" else lambda c: F.when(F.exists(F.coalesce(keep, F.array()), lambda m: m), chosen(c)).otherwise(values(c))
    parts = F.transform(F.sequence(F.lit(0), F.element_at("shape", 1) - 1), lambda c: F.struct(c.alias("channel"), own(c).alias("v")))
    return cases.select("case_id", F.explode(parts).alias("p")).select("case_id", "p.channel", F.explode("p.v").alias("v")).withColumn("v", F.col("v").cast("double"))


def fingerprint(cases: DataFrame, *, inside: str = "all", names: list[str] | None = None, clip: tuple[float | None, float | None] = (None, None)) -> dict[str, dict]:
    """Pooled statistics per channel over all voxels; bounds clip channels named ct before anything is computed."""
    values = channel_values(cases, inside)
    if clip != (None, None):
        ct = F.col("channel").isin(*[k for k, n in enumerate(names or []) if n.lower() == "ct"])
        bound = F.greatest(F.least("v", dbl(clip[1] if clip[1] is not None else float("inf"))), dbl(clip[0] if clip[0] is not None else float("-inf")))
        values = values.withColumn("v", F.when(ct, bound).otherwise(F.col("v")))
    moments = values.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).collect()
    q = exact_quantiles(values, "channel", "v", PROBS)
    return {str(r.channel): {"mean": r["mean"], "std": r["std"], "min": r["min"], "max": r["max"], "median": q[r.channel][0], "percentile_00_5": q[r.channel][1], "percentile_99_5": q[r.channel][2], "clip_min": clip[0], "clip_max": clip[1]} for r in moments}


def with_nonzero_mask(cases: DataFrame) -> DataFrame:
    """The cases with a mask: voxels that are not 0 in some channel, holes filled."""
    names = [c for c in cases.columns if c != "mask"]
    out = T.StructType([*cases.select(names).schema, T.StructField("mask", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(mask=[kernels.nonzero_mask(_array(image, list(map(int, shape)), np.float32)).ravel() for image, shape in zip(pdf["image"], pdf["shape"], strict=True)])

    return cases.select(names).mapInPandas(run, out)


def pooled_statistics(cases: DataFrame, *, nonzero: bool = True, clip: tuple[float | None, float | None] = (None, None)) -> dict[str, dict]:
    """`fingerprint` of the voxels in the nonzero mask (all of a case where it is empty), every channel clipped."""
    cases = with_nonzero_mask(cases) if nonzero else cases
    lo, hi = (dbl(float(k) if k is not None else sign * float("inf")) for k, sign in zip(clip, (-1, 1), strict=True))
    if clip != (None, None):
        cases = cases.withColumn("image", F.transform("image", lambda v: F.greatest(F.least(v.cast("double"), hi), lo)))
    found = fingerprint(cases, inside="mask" if nonzero else "all")
    if not found:
        raise ValueError("there are no cases to describe")
    return {k: {**v, "clip_min": clip[0], "clip_max": clip[1]} for k, v in found.items()}


def case_statistics(cases: DataFrame, *, nonzero: bool = True, clip: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """(case_id, channel, mean, std, min, max, median, percentile_00_5, percentile_99_5): each image for itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rows = kernels.intensity_properties(_array(r.image, list(map(int, r.shape)), np.float32), nonzero, *clip)
                yield pd.DataFrame([{"case_id": r.case_id, "channel": c, **stats} for c, stats in enumerate(rows)])

    return cases.select(F.col("case_id").cast("string"), "shape", "image").mapInPandas(run, "case_id string, channel int, mean double, std double, min double, max double, median double, percentile_00_5 double, percentile_99_5 double")


def file_statistics(spark: SparkSession, folder: str, *, nonzero: bool = True, clip: tuple[float | None, float | None] = (None, None), **reading) -> dict[str, dict]:
    """`pooled_statistics` of the image files in a folder; `reading` goes to `scan.load_cases`, a reader of one's own included."""
    from voxelloom.sources import scan

    return pooled_statistics(scan.load_cases(spark, folder, **reading), nonzero=nonzero, clip=clip)


def plan(cases: DataFrame, *, dataset: dict | None = None, clip: tuple[float | None, float | None] = (None, None), target_spacing: list[float] | None = None, inside: str | None = None) -> tuple[planner.Config, dict[str, dict]]:
    """A configuration and its patch plans from the cases alone."""
    inside = inside or ("foreground" if "reference" in cases.columns else "all")
    axis = cases.select(F.posexplode(F.arrays_zip("spacing", F.slice("shape", 2, 3).alias("size"))).alias("axis", "p")).select("axis", "p.spacing", F.col("p.size").cast("double").alias("size"))
    s, n = exact_quantiles(axis, "axis", "spacing", [0.5, 0.1]), exact_quantiles(axis, "axis", "size", [0.5])
    if not s:
        raise ValueError("there are no cases to plan from")
    spacing = planner.target_spacing([s[k][0] for k in range(3)], [n[k][0] for k in range(3)], [s[k][1] for k in range(3)], target_spacing)
    forward, _ = planner.transpose_axes(spacing)
    channels, count = cases.agg(F.max(F.element_at("shape", 1)), F.count("*")).first()
    names = planner.channel_names(dataset, channels)
    stats = fingerprint(cases, inside=inside, names=names, clip=clip)
    config = planner.Config([spacing[f] for f in forward], forward, planner.schemes(names), [False] * channels, stats, planner.Resampling(3, 0, 1, 0))
    new = C.new_shape(F.slice("shape", 2, 3), F.col("spacing"), F.array(*[dbl(v) for v in spacing]))
    shapes = cases.select(F.posexplode(new).alias("axis", "size")).select("axis", F.col("size").cast("double").alias("size"))
    m = exact_quantiles(shapes, "axis", "size", [0.5])
    return config, planner.configurations(config.spacing, [m[f][0] for f in forward], count)


def infer_config(cases: DataFrame) -> planner.Config:
    """Median spacing, axes as they are, z-scores without masks."""
    axis = cases.select(F.posexplode("spacing").alias("axis", "spacing"))
    s = exact_quantiles(axis, "axis", "spacing", [0.5])
    n = cases.agg(F.max(F.element_at("shape", 1))).first()[0]
    return planner.Config([s[k][0] for k in range(3)], [0, 1, 2], ["ZScoreNormalization"] * n, [False] * n)


def _array(value, shape, kind) -> np.ndarray | None:
    return None if value is None else np.asarray(value, kind).reshape(shape)


def preprocess(cases: DataFrame, config: planner.Config, *, task: str = "segmentation", stage: str = "train", rules: kernels.MaskRules | None = None, settings: kernels.Settings | None = None) -> DataFrame:
    """DONE rows of case rows; a frame of cases is in memory at a time."""
    planner.check_request(task, stage, "reference" in cases.columns)
    has = {c: c in cases.columns for c in ("reference", "ref_channels", "mask")}
    wanted = ["case_id", "shape", "spacing", "image", *[c for c, there in has.items() if there]]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for r in pdf.itertuples():
                shape = list(map(int, r.shape))
                channels = int(r.ref_channels) if has["ref_channels"] else 1
                reference = _array(r.reference, [channels, *shape[1:]], np.float32) if has["reference"] else None
                mask = _array(r.mask, shape[1:], bool) if has["mask"] else None
                out = kernels.run_case(_array(r.image, shape, np.float32), list(map(float, r.spacing)), config, task=task, stage=stage, reference=reference, masks=(mask,), rules=rules, settings=settings)
                flat = lambda a: None if a is None else a.astype(np.float32).ravel()
                yield (
                    r.case_id, list(out["image"].shape), out["spacing"], flat(out["image"]),
                    None if out["target"] is None else list(out["target"].shape), flat(out["target"]), flat(out["evaluation_reference"]),
                    None if out["mask"] is None else out["mask"].ravel(), {k: v.tolist() for k, v in out["class_locations"].items()},
                    out["mask_locations"].tolist(), out["shape_before"], out["spacing_before"],
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from patches.frames(made(batches), patches.fields(DONE))

    return cases.select(F.col("case_id").cast("string").alias("case_id"), *wanted[1:]).mapInPandas(run, DONE)


def preprocess_unpaired(a: DataFrame, b: DataFrame, config_a: planner.Config, config_b: planner.Config, **options) -> DataFrame:
    """Both domains' cases with their domain; their files stay apart by partition."""
    run = lambda cases, config, name: preprocess(cases, config, task="unpaired_generative", stage="train", **options).withColumn("domain", F.lit(name))
    return run(a, config_a, "a").unionByName(run(b, config_b, "b"))


def predict(done: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: tuple[int, ...], overlap: float = 0.5) -> DataFrame:
    """(case_id, shape, data): the mean prediction of overlapping patches; model maps (c, z, y, x) to the same shape."""
    volumes = done.select("case_id", "shape", F.col("image").alias("data"))
    return patches.merge(patches.grid_patches(volumes, size, overlap, model), size)


def restore(predictions: DataFrame, done: DataFrame, config: planner.Config, settings: kernels.Settings | None = None) -> DataFrame:
    """(case_id, shape, data) on the raw grid: intensities, spacing and axes undone in that order."""
    settings = settings or kernels.Settings()
    rows = predictions.select("case_id", "shape", "data").join(done.select("case_id", "shape_before", "spacing_before"), "case_id")

    def undone(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for r in pdf.itertuples():
                out = kernels.undo(_array(r.data, list(r.shape), np.float32), config, list(map(int, r.shape_before)), list(map(float, r.spacing_before)), settings)
                yield r.case_id, list(out.shape), out.ravel()

    schema = "case_id string, shape array<int>, data array<float>"
    return rows.mapInPandas(lambda batches: patches.frames(undone(batches), patches.fields(schema)), schema)
