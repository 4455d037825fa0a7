"""The data set manifest, version 1, as a typed row; one JSON file on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.plans.planner import REFERENCE_RULE, split_counts
from voxelloom.sources.store import STORAGE

SPLIT = T.StructType([T.StructField("train", T.ArrayType(T.StringType())), T.StructField("val", T.ArrayType(T.StringType())), T.StructField("val_ratio", T.DoubleType()), T.StructField("split_seed", T.IntegerType())])
PLANNED = T.MapType(T.StringType(), T.StructType([T.StructField("spacing", T.ArrayType(T.DoubleType())), T.StructField("median_shape", T.ArrayType(T.DoubleType())), T.StructField("patch_size", T.ArrayType(T.IntegerType())), T.StructField("batch_size", T.IntegerType())]))
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("task_mode", "run_stage", "dataset_kind", "storage_format", "default_patch_size", "default_configuration", "preprocessing_config", "folder")]
    + [T.StructField("format_version", T.IntegerType()), T.StructField("identifiers", T.ArrayType(T.StringType())), T.StructField("splits", SPLIT), T.StructField("configurations", PLANNED)]
)


def manifest(ids: DataFrame, task: str, stage: str, *, storage: str = "parquet", patch: str | None = None, configuration: str | None = None, config_json: str | None = None, configurations: dict | None = None, folder: str | None = None, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """One row for ids(identifier). The file lists its identifiers, so they are one array by design."""
    if (task, stage) not in REFERENCE_RULE:
        raise ValueError(f"{task} does not support {stage}")
    ranked = ids.select("identifier", F.xxhash64(F.lit(seed), "identifier").alias("h"))
    every = ranked.agg(F.array_sort(F.collect_list("identifier")).alias("identifiers"), F.transform(F.array_sort(F.collect_list(F.struct("h", "identifier"))), lambda s: s["identifier"]).alias("_o"))
    splits = F.lit(None).cast(SPLIT)
    if stage == "train" and val_ratio > 0:
        n = split_counts(ids.count(), val_ratio)
        splits = F.struct(F.array_sort(F.slice("_o", n + 1, F.greatest(F.size("_o") - n, F.lit(0)))).alias("train"), F.array_sort(F.slice("_o", 1, n)).alias("val"), F.lit(float(val_ratio)).alias("val_ratio"), F.lit(seed).alias("split_seed"))
    text = lambda v: F.lit(v).cast("string")
    fixed = {"task_mode": task, "run_stage": stage, "dataset_kind": "single_folder", "storage_format": storage, "default_patch_size": patch, "default_configuration": configuration, "preprocessing_config": config_json, "folder": folder}
    return every.select(*[text(v).alias(k) for k, v in fixed.items()], F.lit(1).alias("format_version"), "identifiers", splits.alias("splits"), F.from_json(text(json.dumps(configurations) if configurations else None), PLANNED).alias("configurations"))


def unpaired_manifest(a: DataFrame, b: DataFrame, *, random_pairing: bool = True, folders: tuple[str, str] = ("domain_a", "domain_b"), **options) -> DataFrame:
    """One row with the two domains' manifests."""
    one = lambda ids, name, folder: manifest(ids, "unpaired_generative", "train", folder=folder, **options).select(F.struct("*").alias(name))
    key = F.lit(1).alias("_k")
    joined = one(a, "a", folders[0]).select("a", key).join(one(b, "b", folders[1]).select("b", key), "_k")
    return joined.select(F.lit("unpaired_domains").alias("dataset_kind"), F.lit(random_pairing).alias("random_pairing"), F.struct("a", "b").alias("domains"))


def save_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.json(path)


def checked(m: DataFrame, kind: str = "single_folder") -> DataFrame:
    """The row, if its fields agree; fields of other types than MANIFEST's came out as nulls and fail likewise."""
    first = m.drop("identifiers", "splits").first()
    if first is None or first.format_version != 1:
        raise ValueError("not a manifest of version 1")
    if (first.task_mode, first.run_stage) not in REFERENCE_RULE:
        raise ValueError("unknown task or stage")
    if first.dataset_kind != "single_folder" or (kind == "unpaired_domains" and (first.task_mode != "unpaired_generative" or not first.folder)):
        raise ValueError(f"a manifest of {first.task_mode} has another dataset_kind, or a domain without a folder")
    if first.storage_format not in STORAGE:
        raise ValueError(f"storage is one of {STORAGE}")
    size = first.default_patch_size
    if size is not None and not all(n.isdigit() and int(n) > 0 for n in size.split("x")):
        raise ValueError("the patch size must be whole positive numbers")
    if first.default_configuration is not None and first.default_configuration not in (first.configurations or {}):
        raise ValueError("the default configuration is not among the configurations")
    for name, planned in (first.configurations or {}).items():
        if planned is None or planned.patch_size is None or any(n is None or n < 1 for n in planned.patch_size) or (planned.batch_size or 1) < 1:
            raise ValueError(f"configuration {name} has no usable patch or batch size")
    part = F.col("splits").isNotNull()
    rules = {
        "again": F.size(F.array_distinct("identifiers")) != F.size("identifiers"),
        "unsplit": part & (F.col("splits.train").isNull() | F.col("splits.val").isNull()),
        "uncovered": part & (F.array_sort(F.concat("splits.train", "splits.val")) != F.array_sort("identifiers")),
    }
    bad = m.select(F.col("identifiers").isNull().alias("none"), *[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()]).first()
    if any(bad):
        raise ValueError("identifiers repeat or are missing, or the split does not cover them")
    return m


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of one folder, checked."""
    return checked(spark.read.schema(MANIFEST).json(path))


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of one folder, or that of two domains (dataset_kind, random_pairing, domains), checked."""
    kind = spark.read.schema("dataset_kind string").json(path).first()
    if kind is None or kind.dataset_kind != "unpaired_domains":
        return load_manifest(spark, path)
    both = spark.read.schema(f"dataset_kind string, random_pairing boolean, domains struct<a:{MANIFEST.simpleString()},b:{MANIFEST.simpleString()}>").json(path)
    for name in "ab":
        checked(both.select(f"domains.{name}.*"), "unpaired_domains")
    return both


def split_cases(cases: DataFrame, m: DataFrame, split: str) -> DataFrame:
    """The cases of one split, by semi-join."""
    return cases.join(m.select(F.explode(f"splits.{split}").alias("case_id")), "case_id", "left_semi")
