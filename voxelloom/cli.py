"""Command line: preprocess a data set, describe a folder of preprocessed cases, show a manifest."""

from __future__ import annotations

import argparse
import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.case import MaskRules, thresholds
from voxelloom.plans import pipeline, planner
from voxelloom.session import ship
from voxelloom.sources import manifest, readers, scan, store

TASKS = ("segmentation", "paired_generative", "unpaired_generative", "self_supervised")


def number_or_none(text: str) -> float | None:
    return None if text.strip().lower() in ("none", "null") else float(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("voxelloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("preprocess-dataset", help="raw folders to preprocessed cases and a manifest")
    save = commands.add_parser("save-dataset", help="write the manifest of cases that are stored already")
    show = commands.add_parser("show-manifest", help="check and print a manifest")
    for p in (run, save):
        p.add_argument("--task-mode", choices=TASKS, required=True)
        p.add_argument("--run-stage", choices=sorted(planner.STAGES), default="train")
        p.add_argument("--default-patch-size", type=int, nargs="+")
        p.add_argument("--storage-format", choices=store.STORAGE, default="parquet")
        p.add_argument("--val-ratio", type=float, default=0.2)
        p.add_argument("--split-seed", type=int, default=42)
        p.add_argument("--folder-a-name", default="a")
        p.add_argument("--folder-b-name", default="b")
        p.add_argument("--disable-random-pairing", action="store_true")
        for side in ("", "-a", "-b"):
            p.add_argument(f"--config{side}-json", f"--config-json{side}", dest=f"config_json{side.replace('-', '_')}")
            p.add_argument(f"--plans{side}-file", f"--plans-json{side}", dest=f"plans_json{side.replace('-', '_')}")
            p.add_argument(f"--configuration{side}-name", f"--configuration{side}", dest=f"configuration{side.replace('-', '_')}")
    for p in (save, show):
        p.add_argument("--folder", required=True)
    run.add_argument("--output-folder", required=True)
    run.add_argument("--images-dir", "--source-dir", "--folder-a", dest="images_dir", required=True, help="images, sources, or domain A")
    run.add_argument("--target-dir", "--label-dir", "--folder-b", dest="target_dir", help="labels, targets, or domain B")
    run.add_argument("--image-reader", "--source-reader", "--domain-a-reader", dest="image_reader", choices=("auto", *readers.READERS), default="auto")
    run.add_argument("--target-reader", "--reference-reader", "--domain-b-reader", dest="target_reader", choices=("auto", *readers.READERS), default="auto")
    run.add_argument("--mask-reader", choices=("auto", *readers.READERS), default="auto")
    run.add_argument("--num-processes", type=int, help="taken for compatibility: the session's cores do the work")
    run.add_argument("--masking-mode", choices=("threshold",), help="taken for compatibility: masks come from thresholds where no folder is given")
    run.add_argument("--multi-image", action="store_true")
    run.add_argument("--reorient", action="store_true", help="to right, anterior, superior")
    run.add_argument("--dataset-json")
    run.add_argument("--images-mask-dir")
    run.add_argument("--target-mask-dir", help="masks aligned with --target-dir; set voxels of either folder may be sampled")
    run.add_argument("--mask-threshold", type=number_or_none, default=None)
    run.add_argument("--images-mask-threshold", type=number_or_none, default=argparse.SUPPRESS)
    run.add_argument("--target-mask-threshold", type=number_or_none, default=argparse.SUPPRESS)
    run.add_argument("--mask-fill-holes", action=argparse.BooleanOptionalAction, default=True)
    run.add_argument("--mask-keep-largest-component", action=argparse.BooleanOptionalAction, default=True)
    run.add_argument("--mask-closing-iters", type=int, default=1)
    run.add_argument("--ct-clip-min", type=float)
    run.add_argument("--ct-clip-max", type=float)
    run.add_argument("--normalization-method", default="auto")
    run.add_argument("--normalization-min", type=float)
    run.add_argument("--normalization-max", type=float)
    run.add_argument("--label-order", type=int)
    run.add_argument("--label-order-z", type=int)
    run.add_argument("--save-mask", action=argparse.BooleanOptionalAction, default=None)
    return top


def given_config(args: argparse.Namespace, side: str = "") -> planner.Config | None:
    """From a configuration file or a plans file, which exclude each other."""
    plain, plans, name = (getattr(args, f"{k}{side}") for k in ("config_json", "plans_json", "configuration"))
    if plain and plans:
        raise ValueError("give a configuration or a plans file, not both")
    if not (plain or plans):
        if name:
            raise ValueError("a configuration name needs a plans file")
        return None
    with open(plain or plans) as f:
        return planner.config_from_json(f.read(), name)


def description(spark: SparkSession, args: argparse.Namespace, *folders: str | None) -> dict | None:
    """The data set's description: the file given, else one in or above the folders."""
    if not args.dataset_json:
        return scan.dataset_description(spark, *folders)
    with open(args.dataset_json) as f:
        return json.load(f)


def configured(args: argparse.Namespace, cases: DataFrame, side: str = "", dataset: dict | None = None) -> tuple[planner.Config, dict[str, dict]]:
    clip = (args.ct_clip_min, args.ct_clip_max)
    if (clip[0] is None) != (clip[1] is None) or (None not in clip and clip[0] >= clip[1]):
        raise ValueError("CT clipping needs both bounds, the lower one first")
    config, found = given_config(args, side) or given_config(args), {}
    if config is None:
        config, found = pipeline.plan(cases, dataset=dataset, clip=clip)
    config = planner.override_schemes(config, args.normalization_method, args.normalization_min, args.normalization_max)
    orders = {k: getattr(args, k) for k in ("label_order", "label_order_z") if getattr(args, k) is not None}
    return replace(config, resampling=replace(config.resampling, **orders)), found


def preprocess_dataset(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Scan, match, plan, preprocess, store; the manifest's row."""
    decoded = f"{args.output_folder.rstrip('/')}/_decoded"

    unpaired = args.task_mode == "unpaired_generative" and args.target_dir
    dataset = description(spark, args, args.images_dir, None if unpaired else args.target_dir)
    other_set = description(spark, args, args.target_dir) if unpaired else dataset

    def load(folder: str, reader: str, multi: bool = args.multi_image, dataset: dict | None = dataset) -> DataFrame:
        """Cases of a folder, decoded once: planning and preprocessing read them from Parquet."""
        path = f"{decoded}/{uuid.uuid4().hex}"
        scan.load_cases(spark, folder, multi=multi, to_ras=args.reorient, reader=reader, dataset=dataset).write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    own = {side: getattr(args, f"{name}_mask_threshold") for side, name in (("image", "images"), ("target", "target")) if hasattr(args, f"{name}_mask_threshold")}
    level = thresholds(args.mask_threshold, own)
    rules = MaskRules(level["image"], level["target"], args.mask_fill_holes, args.mask_keep_largest_component, args.mask_closing_iters)
    keep = store.should_save_mask(args.task_mode, args.run_stage, args.save_mask)
    images, folder = load(args.images_dir, args.image_reader), args.output_folder.rstrip("/")
    if unpaired:
        other = load(args.target_dir, args.target_reader, dataset=other_set)
        (config_a, a), (config_b, b) = configured(args, images, "_a", dataset), configured(args, other, "_b", other_set)
        for cases, config, name in ((images, config_a, args.folder_a_name), (other, config_b, args.folder_b_name)):
            store.save_cases(pipeline.preprocess(cases, config, task=args.task_mode, stage=args.run_stage, rules=rules), f"{folder}/{name}", save_mask=keep)
        found, config = planner.merge_configurations(a, b), config_a
    else:
        given = [scan.matched(images, load(m, args.mask_reader, False), "mask", same_spacing=True).select("case_id", F.transform("mask", lambda v: v != 0).alias("mask")) for m in (args.images_mask_dir, args.target_mask_dir) if m]
        if args.target_mask_dir and not args.target_dir:
            raise ValueError("--target-mask-dir needs --target-dir")
        if len(given) == 2:
            second = given[1].withColumnRenamed("mask", "_m")
            given = [given[0].join(second, "case_id").select("case_id", F.zip_with("mask", "_m", lambda a, b: a | b).alias("mask"))]
        for masks in given:
            images = images.join(masks, "case_id")
        if args.target_dir:
            images = scan.matched(images, load(args.target_dir, args.target_reader), same_spacing=args.task_mode == "paired_generative")
        config, found = configured(args, images, dataset=dataset)
        store.save_cases(pipeline.preprocess(images, config, task=args.task_mode, stage=args.run_stage, rules=rules), f"{folder}/cases", save_mask=keep)
    row = save_dataset(spark, folder, args, config, found)
    drop = spark._jvm.org.apache.hadoop.fs.Path(decoded)
    drop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(drop, True)
    return row


def save_dataset(spark: SparkSession, folder: str, args: argparse.Namespace, config: planner.Config | None = None, found: dict[str, dict] | None = None) -> DataFrame:
    name = planner.default_configuration(found or {})
    size = args.default_patch_size or (found[name]["patch_size"] if name else None)
    options = {"patch": "x".join(map(str, size)) if size else None, "configuration": name, "config_json": planner.config_to_json(config) if config else None, "val_ratio": args.val_ratio, "seed": args.split_seed, "storage": args.storage_format, "configurations": found}
    ids = lambda part: store.identifiers(spark, f"{folder}/{part}").select(F.col("case_id").alias("identifier"))
    if args.task_mode == "unpaired_generative" and args.run_stage == "train":
        row = manifest.unpaired_manifest(ids(args.folder_a_name), ids(args.folder_b_name), random_pairing=not args.disable_random_pairing, folders=(args.folder_a_name, args.folder_b_name), **options)
    else:
        row = manifest.manifest(ids("cases"), args.task_mode, args.run_stage, **options)
    manifest.save_manifest(row, f"{folder}/manifest")
    return row


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = ship(spark or SparkSession.builder.appName("voxelloom").getOrCreate())
    if args.command == "preprocess-dataset":
        preprocess_dataset(spark, args)
    elif args.command == "save-dataset":
        save_dataset(spark, args.folder.rstrip("/"), args, given_config(args))
    row = spark.read.json(f"{(args.output_folder if args.command == 'preprocess-dataset' else args.folder).rstrip('/')}/manifest")
    if "domains" not in row.columns:
        row = manifest.load_manifest(spark, f"{(args.output_folder if args.command == 'preprocess-dataset' else args.folder).rstrip('/')}/manifest")
    for line in row.toJSON().take(1):
        print(json.dumps(json.loads(line), indent=2, sort_keys=True))
    return 0
