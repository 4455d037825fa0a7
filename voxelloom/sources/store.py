"""Preprocessed cases on disk: Parquet, one row a case, side tables by case id.

Arrays are columns, so a reader that wants targets only never touches images.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.ranks import ranked
from voxelloom.operators import patches

STORAGE = ("parquet",)


def should_save_mask(task: str, stage: str, flag: bool | None = None) -> bool:
    """An explicit flag wins; else all but the training of segmentations keep their masks."""
    return flag if flag is not None else (task, stage) != ("segmentation", "train")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(path).select("case_id") if there else None


def save_cases(done: DataFrame, path: str, *, storage: str = "parquet", save_mask: bool = True, partition: tuple[str, ...] = ()) -> None:
    """Append cases; one that is stored already is an error, found by a semi-join before anything is written."""
    if storage not in STORAGE:
        raise ValueError(f"storage is one of {STORAGE}")
    old = existing(done.sparkSession, path)
    if old is not None and (again := done.join(old, "case_id", "left_semi").select("case_id").first()):
        raise ValueError(f"case {again.case_id} is stored already")
    out = done if save_mask else done.withColumn("mask", F.lit(None).cast("array<boolean>"))
    out.write.mode("append").partitionBy(*partition).option("compression", "zstd").option("maxRecordsPerFile", 256).parquet(path)


def load_cases(spark: SparkSession, path: str, side: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cases, with side tables (case_id, data) left-joined under their names; sizes must agree."""
    cases = spark.read.parquet(path)
    for name, table in (side or {}).items():
        cases = cases.join(table.select("case_id", F.col("data").alias(name)), "case_id", "left")
        voxels = F.expr("aggregate(shape, 1, (s, k) -> s * k)")
        plane = F.expr("aggregate(slice(shape, 2, 3), 1, (s, k) -> s * k)")
        fits = F.col(name).isNull() | (F.size(name) == voxels) | (F.size(name) == plane)
        cases = cases.withColumn(name, F.when(fits, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name} has another size in case "), "case_id"))))
    return cases


def quantized(side: DataFrame) -> DataFrame:
    """A conflict map in [0, 1] as 0 to 255, halves to even."""
    return side.withColumn("data", F.transform("data", lambda v: F.rint(F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(0.0)) * 255).cast("short")))


def dequantized(side: DataFrame) -> DataFrame:
    return side.withColumn("data", F.transform("data", lambda v: (v / F.lit(255.0)).cast("float")))


def artifacts(table: DataFrame) -> DataFrame:
    """(case_id, data) of predicted artifacts, under either of their two names."""
    name = next((c for c in ("artifact_prediction", "artifact_pred") if c in table.columns), None)
    if name is None:
        raise ValueError("artifacts are a column artifact_prediction or artifact_pred")
    return table.select("case_id", F.col(name).alias("data"))


def save_side(cases: DataFrame, side: DataFrame, path: str, *, quantize: bool = False) -> None:
    """Write side(case_id, data), each as large as the image of its case; `quantize` is for conflict maps."""
    known = cases.select("case_id", F.expr("aggregate(shape, 1, (s, k) -> s * k)").alias("_voxels"))
    fits = side.join(known, "case_id", "left")
    wrong = F.raise_error(F.concat(F.lit("no image of this size in case "), "case_id")).cast("array<float>")
    fits = fits.select("case_id", F.when(F.size("data") == F.col("_voxels"), F.col("data").cast("array<float>")).otherwise(wrong).alias("data"))
    (quantized(fits) if quantize else fits).write.option("compression", "zstd").parquet(path)


def identifiers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("case_id").distinct().orderBy("case_id")


def brick_shape(patch: list[int], itemsize: int = 4, small: int = 32_768, large: int = 1_441_792, share: float = 0.8) -> tuple[list[int], list[int]]:
    """(block, chunk) sides for tiled storage: a block that fits a small cache, doubled into a chunk that fits a large one and stays near the patch."""
    block = [1 << max(0, math.ceil(math.log2(p))) for p in patch]
    while math.prod(block) * itemsize > small * share and max(block) > 1:
        k = max(range(len(block)), key=lambda a: block[a] / patch[a])
        block[k] = max(1, block[k] // 2)
    block = [min(b, p) for b, p in zip(block, patch, strict=True)]
    chunk = list(block)
    while math.prod(chunk) * itemsize < large * share:
        k = min(range(len(chunk)), key=lambda a: chunk[a] / block[a])
        wider = [c + (block[a] if a == k else 0) for a, c in enumerate(chunk)]
        if math.prod(wider) * itemsize > large * share or sum(c / p for c, p in zip(wider, patch, strict=True)) / len(patch) > 1.5:
            break
        chunk = wider
    return block, chunk


def training_patches(cases: DataFrame, size: tuple[int, ...] | None, *, draws: int = 1, seed: int = 42, from_locations: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Patches for a trainer: a row per case and draw with image, target, mask and the side tables `also` cut alike.

    Starts come from class locations, else mask locations, else anywhere; they are functions of
    seed, case and draw. Two-dimensional patches are single slices, whose patch_shape has no axis
    for them; no size gives whole cases.
    """
    rows = cases.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return cut_patches(rows, size, seed=seed, from_locations=from_locations, also=also)


def usable_locations(places: Column) -> Column:
    """Locations without those that are null, hold nulls or negative numbers, or have fewer than three axes."""
    return F.filter(places, lambda p: F.coalesce((F.size(p) >= 3) & F.forall(p, lambda k: F.coalesce(k >= 0, F.lit(False))), F.lit(False)))


def cut_patches(rows: DataFrame, size: tuple[int, ...] | None, *, seed: int, from_locations: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """`training_patches` of cases that have their `draw` already."""
    if size is None:
        return rows.select("case_id", "draw", F.array(*[F.lit(0)] * 3).alias("starts"), F.col("shape").alias("patch_shape"), "image", "target", "mask", *also)
    by_class = usable_locations(F.flatten(F.map_values("class_locations")))
    rows = rows.withColumn("locations", F.coalesce(F.nullif(by_class, F.array().cast("array<array<int>>")), usable_locations(F.col("mask_locations"))))
    usable = F.coalesce(F.size("locations") > 0, F.lit(False)) & F.lit(from_locations)
    placed = patches.starts_at_locations(rows.where(usable), size, seed).unionByName(patches.random_starts(rows.where(~usable), size, seed))
    plane = F.concat(F.array(F.lit(1)), F.slice("shape", 2, 3))
    cut = lambda c, shape: F.when(F.col(c).isNotNull(), patches.cropped(F.col(c), shape, F.col("starts"), size))
    mask = F.transform("mask", lambda m: m.cast("float"))
    side = [cut(c, F.when(F.size(c) == F.size("image"), F.col("shape")).otherwise(plane)).alias(c) for c in also]
    patch_shape = F.concat(F.slice("shape", 1, 1), F.array(*[F.lit(n) for n in size])).alias("patch_shape")
    return placed.select("case_id", "draw", "starts", patch_shape, cut("image", F.col("shape")).alias("image"), cut("target", F.coalesce("target_shape", plane)).alias("target"), F.when(F.col("mask").isNotNull(), F.transform(patches.cropped(mask, plane, F.col("starts"), size), lambda m: m > 0)).alias("mask"), *side)


def pair_domains(a: DataFrame, b: DataFrame, *, random: bool = True, seed: int = 42) -> DataFrame:
    """(i, id_a, id_b) for i up to the longer domain: A by modulo, B by modulo or hash."""
    rank = lambda df, name: ranked(df.select(F.col("case_id").alias(f"id_{name}")), [f"id_{name}"], name)
    na, nb = a.count(), b.count()
    if not na or not nb:
        raise ValueError("both domains need cases")
    index = a.sparkSession.range(max(na, nb)).select("id", (F.col("id") % na).alias("a"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(nb)) if random else F.col("id") % nb).alias("b"))
    return index.join(rank(a, "a"), "a").join(rank(b, "b"), "b").select(F.col("id").alias("i"), "id_a", "id_b")
