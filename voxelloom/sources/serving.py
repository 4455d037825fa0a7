"""Stored cases served to a trainer, as the manifest of their folder says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from voxelloom.sources import manifest, store


def serving_size(m: Row, patch: tuple[int, ...] | None = None, configuration: str | None = None, use_manifest: bool = True) -> tuple[int, ...] | None:
    """The patch to cut: the one asked for, else the configuration's, else the manifest's; None serves whole cases."""
    name = configuration or m.default_configuration
    if configuration and configuration not in (m.configurations or {}):
        raise ValueError(f"the manifest has no configuration {configuration!r}")
    if patch or not use_manifest:
        return tuple(patch) if patch else None
    planned = (m.configurations or {}).get(name)
    if planned and planned.patch_size:
        return tuple(planned.patch_size)
    return tuple(map(int, m.default_patch_size.split("x"))) if m.default_patch_size else None


def in_split(cases: DataFrame, row: DataFrame, split: str | None) -> DataFrame:
    """The cases that the manifest lists, or those of one of its splits."""
    if split is None:
        return cases.join(row.select(F.explode("identifiers").alias("case_id")), "case_id", "left_semi")
    if split not in ("train", "val"):
        raise ValueError("a split is train or val")
    if row.where("splits is not null").isEmpty():
        raise ValueError("the manifest has no splits")
    return manifest.split_cases(cases, row, split)


def with_targets(cases: DataFrame) -> DataFrame:
    """The cases; one without a target is an error when it is read."""
    missing = F.raise_error(F.concat(F.lit("no target in case "), "case_id")).cast("array<float>")
    return cases.withColumn("target", F.when(F.col("target").isNotNull(), F.col("target")).otherwise(missing))


def load_preprocessed_dataset(
    spark: SparkSession,
    folder: str,
    *,
    side: dict[str, DataFrame] | None = None,
    patch: tuple[int, ...] | None = None,
    use_manifest_patch: bool = True,
    configuration: str | None = None,
    split: str | None = None,
    draws: int = 1,
    seed: int = 1234,
    random_pairing: bool | None = None,
    view: Callable[[Column, int], Column] | None = None,
) -> DataFrame:
    """One row a case and draw (two domains: a row a pair), cut to the patch size of `serving_size`.

    Segmentation and paired training need targets; self-supervision gets `view1` and `view2`, the
    image under `view(image, number)`, or copies of it.
    """
    row = manifest.load_any(spark, f"{folder}/manifest")
    if "domains" in row.columns:
        return two_domains(spark, folder, row, patch, use_manifest_patch, configuration, split, seed, random_pairing)
    m = row.drop("identifiers", "splits").first()
    cases = in_split(store.load_cases(spark, f"{folder}/{m.folder or 'cases'}", side), row, split)
    if m.run_stage == "train" and m.task_mode in ("segmentation", "paired_generative"):
        cases = with_targets(cases)
    out = store.training_patches(cases, serving_size(m, patch, configuration, use_manifest_patch), draws=draws, seed=seed, also=tuple(side or ()))
    if m.task_mode == "self_supervised":
        view = view or (lambda image, number: image)
        out = out.withColumns({f"view{k}": view(F.col("image"), k) for k in (1, 2)})
    return out


def two_domains(spark: SparkSession, folder: str, row: DataFrame, patch, use_manifest_patch, configuration, split, seed, random_pairing) -> DataFrame:
    """(i, and id, image, mask and starts of a and b): pairs of the domains, each side cut for itself."""
    own = {k: row.select(f"domains.{k}.*") for k in "ab"}
    first = {k: own[k].drop("identifiers", "splits").first() for k in "ab"}
    cases = {k: in_split(store.load_cases(spark, f"{folder}/{first[k].folder}"), own[k], split) for k in "ab"}
    if random_pairing is None:
        random_pairing = row.select("random_pairing").first()[0]
    pairs = store.pair_domains(cases["a"], cases["b"], random=random_pairing, seed=seed)
    size = serving_size(first["a"], patch, configuration, use_manifest_patch)

    def side(k: str, number: int) -> DataFrame:
        rows = pairs.select(F.col("i").cast("int").alias("draw"), F.col(f"id_{k}").alias("case_id")).join(cases[k], "case_id")
        cut = store.cut_patches(rows, size, seed=seed + number)
        return cut.select(F.col("draw").cast("long").alias("i"), F.col("case_id").alias(f"id_{k}"), F.col("image").alias(f"image_{k}"), F.col("mask").alias(f"mask_{k}"), F.col("starts").alias(f"starts_{k}"))

    return side("a", 0).join(side("b", 1), "i")
