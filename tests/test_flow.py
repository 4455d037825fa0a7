import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions.ranks import ranked
from voxelloom.operators import patches
from voxelloom.plans import pipeline, planner
from voxelloom.plans.quantiles import exact_quantiles
from voxelloom.sources import images, manifest, scan, serving, store

rng = np.random.default_rng(7)


def raw_cases(n=6):
    out = []
    for k in range(n):
        shape = (2, 5 + k % 2, 6, 7)
        image = rng.normal(size=shape).astype(np.float32)
        label = (rng.random(shape[1:]) > 0.6).astype(np.float32) * (1 + k % 2)
        out.append((f"case_{k:04d}", list(shape), [2.0, 1.0, 1.0], image.ravel().tolist(), label.ravel().tolist(), 1))
    return out


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(raw_cases(), "case_id string, shape array<int>, spacing array<double>, image array<float>, reference array<float>, ref_channels int")


@pytest.mark.parametrize(("few", "bins"), [(10**6, 64), (50, 16), (1, 4)])
def test_exact_quantiles(spark, few, bins):
    groups = {0: rng.normal(size=3000), 1: np.repeat([1.0, 2.0, 2.5], 700), 2: np.array([4.25]), 3: np.concatenate([np.zeros(500), rng.exponential(size=77) * 1e6])}
    df = spark.createDataFrame([(k, float(v)) for k, own in groups.items() for v in own] + [(0, None), (0, float("nan"))], "k int, v double")
    probs = [0.005, 0.1, 0.5, 0.995, 1.0]
    got = exact_quantiles(df, "k", "v", probs, few, bins)
    for k, own in groups.items():
        assert np.allclose(got[k], np.quantile(own, probs), rtol=1e-12)
    assert exact_quantiles(df.where("false"), "k", "v", probs) == {}


def test_global_ranks(spark):
    ids = spark.createDataFrame([(f"c{k % 97}", k) for k in range(500)], "name string, k long").repartition(7)
    got = ranked(ids, ["name", "k"]).collect()
    want = sorted((r.name, r.k) for r in got)
    assert [(r.name, r.k) for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(500))
    assert ranked(ids.where("false"), ["name"]).count() == 0


def test_fingerprint(cases):
    got = pipeline.fingerprint(cases, inside="foreground")
    rows = cases.collect()
    for c in range(2):
        v = np.concatenate([np.array(r.image).reshape(r.shape)[c][np.array(r.reference).reshape(r.shape[1:]) > 0] for r in rows])
        assert np.allclose([got[str(c)][k] for k in ("mean", "std", "median", "percentile_00_5", "percentile_99_5")], [v.mean(), v.std(), *np.percentile(v, [50, 0.5, 99.5])])
    clipped = pipeline.fingerprint(cases, names=["ct", "mr"], clip=(-0.5, 0.5))
    assert clipped["0"]["max"] == 0.5 and clipped["1"]["max"] > 1
    masked = cases.withColumn("mask", F.transform("reference", lambda v: v > 5))  # empty: all voxels
    assert pipeline.fingerprint(masked, inside="mask")["0"] == pipeline.fingerprint(cases)["0"]


def test_plan_preprocess_store_and_serve(spark, cases, tmp_path):
    config, found = pipeline.plan(cases, dataset={"channel_names": {"0": "CT", "1": "T1"}})
    assert config.spacing == [2.0, 1.0, 1.0] and config.schemes == ["CTNormalization", "ZScoreNormalization"] and set(found) == {"3d", "2d"}
    assert pipeline.infer_config(cases).spacing == [2.0, 1.0, 1.0]
    done = pipeline.preprocess(cases, config)
    path = str(tmp_path / "cases")
    store.save_cases(done, path, save_mask=store.should_save_mask("segmentation", "train", True))
    with pytest.raises(ValueError):
        store.save_cases(done.limit(1), path)
    stored = store.load_cases(spark, path)
    assert stored.count() == 6 and [r.case_id for r in store.identifiers(spark, path).collect()] == [f"case_{k:04d}" for k in range(6)]
    for r in stored.collect():
        ch = np.array(r.image).reshape(r.shape)
        assert abs(ch[1].mean()) < 1e-5 and abs(ch[1].std() - 1) < 1e-4 and sum(map(len, r.class_locations.values())) == sum(v > 0 for v in r.target)
    cut = store.training_patches(stored, (3, 4, 4), draws=3).collect()
    by_case = {r.case_id: r for r in stored.collect()}
    assert len(cut) == 18
    for p in cut:
        r = by_case[p.case_id]
        z, y, x = p.starts
        assert (np.array(p.image).reshape(2, 3, 4, 4) == np.array(r.image).reshape(r.shape)[:, z : z + 3, y : y + 4, x : x + 4]).all()
        assert any(v > 0 for v in p.target) and len(p.mask) == 48
    assert cut == store.training_patches(stored, (3, 4, 4), draws=3).collect()
    flat = store.training_patches(stored, (4, 4), from_locations=False).first()
    assert len(flat.image) == 32 and flat.patch_shape == [2, 4, 4] and cut[0].patch_shape == [2, 3, 4, 4]
    side = stored.select("case_id", F.transform("target", lambda v: v / 3).alias("data")).limit(2)
    joined = store.load_cases(spark, path, {"conflict": store.dequantized(store.quantized(side))})
    assert joined.where("conflict is not null").count() == 2


def test_predict_merge_restore(spark, cases):
    config = planner.Config([1.0, 2.0, 1.0], [1, 0, 2], ["NoNormalization"] * 2, [False] * 2)
    done = pipeline.preprocess(cases.drop("reference", "ref_channels"), config, task="segmentation", stage="predict")
    merged = pipeline.predict(done, lambda a: a * 1.0, (4, 4, 4))
    restored = {r.case_id: np.array(r.data).reshape(r.shape) for r in pipeline.restore(merged, done, config).collect()}
    for r in cases.collect():
        assert np.allclose(restored[r.case_id], np.array(r.image).reshape(r.shape), atol=1e-5)
    large = pipeline.predict(done, lambda a: a, (16, 16, 16))  # larger than the volumes: padded, and cut back
    for r in large.join(done.select("case_id", "image"), "case_id").collect():
        assert np.allclose(r.data, r.image)


def test_starts(spark):
    rows = spark.createDataFrame([("a", k, [1, 9, 4, 5], [[0, 8, 1, 2], [0, 0, 3, 4]]) for k in range(200)], "case_id string, draw int, shape array<int>, locations array<array<int>>")
    for r in patches.starts_at_locations(rows, (4, 6, 2), 3).collect():
        assert any(all(s <= c < s + p for s, c, p in zip(r.starts, place[1:], (4, 6, 2), strict=True)) for place in r.locations) and 0 <= r.starts[0] <= 5 and r.starts[1] == 0
    drawn = {tuple(r.starts) for r in patches.random_starts(rows, (4, 4, 4), 3).collect()}
    assert drawn <= {(a, 0, c) for a in range(6) for c in range(2)} and len(drawn) > 8
    data = [1.0 if k < 36 else 0.0 for k in range(180)]
    one = spark.createDataFrame([("a", 0, [1, 9, 4, 5], data)], "case_id string, draw int, shape array<int>, data array<float>")
    best = patches.best_of(one, (2, 4, 5), 1, 0.5, 0.9, tries=40).collect()
    assert len(best) == 1 and best[0].fraction == 0.9 and best[0].starts == [0, 0, 0]
    valid = patches.valid_starts(one, (2, 4, 5), 0.4, 100).collect()
    assert [r.starts[0] for r in valid] == [0, 1]
    assert patches.valid_starts(one, (2, 4, 5), 0.4, 1).count() == 1


def test_folders_manifest_and_command_line(spark, tmp_path, capsys):
    from voxelloom.cli import main

    for kind in ("images", "labels"):
        (tmp_path / kind).mkdir()
    for k in range(5):
        volume = rng.normal(size=(5, 6, 7)).astype(np.float32)
        for c in range(2):
            (tmp_path / "images" / f"case_{k:04d}_{c:04d}.nii.gz").write_bytes(images.write_nifti(volume + c, [2.0, 1.0, 1.0]))
        (tmp_path / "labels" / f"case_{k:04d}_0000.nii.gz").write_bytes(images.write_nifti((volume > 0).astype(np.uint8), [2.0, 1.0, 1.0]))
    loaded = scan.load_cases(spark, str(tmp_path / "images"))
    assert {tuple(r.shape) for r in loaded.collect()} == {(2, 5, 6, 7)}
    args = ["preprocess-dataset", "--task-mode", "segmentation", "--images-dir", str(tmp_path / "images"), "--label-dir", str(tmp_path / "labels"), "--multi-image", "--output-folder", str(tmp_path / "out")]
    assert main(args, spark) == 0 and '"val_ratio": 0.2' in capsys.readouterr().out
    m = manifest.load_manifest(spark, str(tmp_path / "out" / "manifest"))
    stored = store.load_cases(spark, str(tmp_path / "out" / "cases"))
    assert manifest.split_cases(stored, m, "train").count() == 4 and manifest.split_cases(stored, m, "val").count() == 1
    assert main(["show-manifest", "--folder", str(tmp_path / "out")], spark) == 0
    (tmp_path / "images" / "case_0002_0000.nii.gz").unlink()  # channel 1 alone
    with pytest.raises(ValueError):
        main(args[:-1] + [str(tmp_path / "again")], spark)
    (tmp_path / "images" / "case_0002_0001.nii.gz").unlink()  # a label without an image
    with pytest.raises(ValueError):
        main(args[:-1] + [str(tmp_path / "again")], spark)


def test_unpaired(spark, cases, tmp_path):
    a, b = cases.drop("reference", "ref_channels").limit(4), cases.drop("reference", "ref_channels").where("case_id > 'case_0003'")
    config = planner.Config([2.0, 1.0, 1.0], [0, 1, 2], ["ZScoreNormalization"] * 2, [False] * 2)
    assert pipeline.preprocess_unpaired(a, b, config, config).groupBy("domain").count().count() == 2
    pairs = store.pair_domains(a, b, random=False).orderBy("i").collect()
    assert [p.id_b for p in pairs] == ["case_0004", "case_0005"] * 2 and len({p.id_a for p in pairs}) == 4
    assert {p.id_b for p in store.pair_domains(a, b).collect()} <= {"case_0004", "case_0005"}
    ids = lambda df: df.select(F.col("case_id").alias("identifier"))
    row = manifest.unpaired_manifest(ids(a), ids(b)).first()
    assert len(row.domains.a.identifiers) == 4 and len(row.domains.b.splits.val) == 1


def test_served_by_manifest(spark, cases, tmp_path):
    config = planner.Config([2.0, 1.0, 1.0], [0, 1, 2], ["NoNormalization"] * 2, [False] * 2)
    folder, found = str(tmp_path / "set"), {"3d": {"spacing": [2.0, 1.0, 1.0], "median_shape": [5.0, 6.0, 7.0], "patch_size": [3, 4, 4], "batch_size": 2}}
    store.save_cases(pipeline.preprocess(cases, config), f"{folder}/cases")
    stored = store.load_cases(spark, f"{folder}/cases")
    ids = stored.select(F.col("case_id").alias("identifier"))
    manifest.save_manifest(manifest.manifest(ids, "segmentation", "train", patch="2x2x2", configuration="3d", configurations=found), f"{folder}/manifest")
    whole = {r.case_id: r for r in stored.collect()}
    serve = lambda **options: serving.load_preprocessed_dataset(spark, folder, **options)
    for r in serve(draws=2).collect():  # the configuration's patch
        z, y, x = r.starts
        own = whole[r.case_id]
        assert (np.array(r.image).reshape(2, 3, 4, 4) == np.array(own.image).reshape(own.shape)[:, z : z + 3, y : y + 4, x : x + 4]).all() and any(v > 0 for v in r.target)
    assert {len(r.image) for r in serve(patch=(2, 3, 3)).collect()} == {36}
    assert {r.case_id: r.image for r in serve(use_manifest_patch=False).collect()} == {k: r.image for k, r in whole.items()}
    assert serve(split="train").count() == 5 and serve(split="val").count() == 1
    for wrong in ({"split": "test"}, {"configuration": "2d"}):
        with pytest.raises(ValueError):
            serve(**wrong)
    m = manifest.load_manifest(spark, f"{folder}/manifest").first()
    assert serving.serving_size(m) == (3, 4, 4) and serving.serving_size(m, (1, 2, 3)) == (1, 2, 3) and serving.serving_size(m, use_manifest=False) is None
    # side tables as large as the image, of known cases only
    side = stored.select("case_id", F.transform("image", lambda v: F.abs(v) / 9).alias("data"))
    store.save_side(stored, side, f"{folder}/conflict", quantize=True)
    conflict = store.dequantized(spark.read.parquet(f"{folder}/conflict"))
    assert {len(r.conflict) for r in serve(side={"conflict": conflict}).collect()} == {96}
    for n, wrong in enumerate((side.withColumn("data", F.array(F.lit(0.5))), side.withColumn("case_id", F.lit("case_9")))):
        with pytest.raises(Exception, match="no image of this size"):
            store.save_side(stored, wrong, str(tmp_path / f"wrong{n}"))
    assert store.artifacts(side.withColumnRenamed("data", "artifact_pred")).columns == ["case_id", "data"]
    with pytest.raises(ValueError):
        store.artifacts(side)
    with pytest.raises(Exception, match="no target in case"):
        serving.with_targets(stored.withColumn("target", F.lit(None).cast("array<float>"))).select("target").collect()


def test_views_and_domains_served(spark, cases, tmp_path):
    config, ids = planner.Config([2.0, 1.0, 1.0], [0, 1, 2], ["NoNormalization"] * 2, [False] * 2), lambda df: df.select(F.col("case_id").alias("identifier"))
    plain, folder = cases.drop("reference", "ref_channels"), str(tmp_path / "set")
    done = pipeline.preprocess(plain, config, task="self_supervised", stage="train")
    store.save_cases(done, f"{folder}/cases")
    manifest.save_manifest(manifest.manifest(ids(plain), "self_supervised", "train", patch="2x3x3"), f"{folder}/manifest")
    for r in serving.load_preprocessed_dataset(spark, folder, view=lambda image, k: F.transform(image, lambda v: v * k)).collect():
        assert r.view1 == r.image and np.allclose(r.view2, 2 * np.array(r.image)) and len(r.image) == 36
    pair = str(tmp_path / "pair")
    a, b = plain.where("case_id <= 'case_0003'"), plain.where("case_id > 'case_0003'")
    for name, rows in (("left", a), ("right", b)):
        store.save_cases(done.join(rows.select("case_id"), "case_id", "left_semi"), f"{pair}/{name}")
    manifest.save_manifest(manifest.unpaired_manifest(ids(a), ids(b), folders=("left", "right"), random_pairing=False, patch="2x3x3"), f"{pair}/manifest")
    rows = serving.load_preprocessed_dataset(spark, pair).orderBy("i").collect()
    assert [(r.id_a, r.id_b) for r in rows] == [(f"case_000{k}", f"case_000{4 + k % 2}") for k in range(4)]
    assert all(len(r.image_a) == len(r.image_b) == 36 for r in rows)
    assert serving.load_preprocessed_dataset(spark, pair, split="train").count() == 3


def test_malformed_locations_are_left_out(spark):
    rows = spark.createDataFrame([([[1, 2, 3], None, [1, 2], [0, -1, 2], [0, 1, None], [0, 4, 5, 6]],)], "places array<array<int>>")
    assert rows.select(store.usable_locations(F.col("places"))).first()[0] == [[1, 2, 3], [0, 4, 5, 6]]


def test_side_files_and_encoders(spark, tmp_path):
    from voxelloom.sources import rasters

    v = spark.createDataFrame([("case_0001", [1, 3, 4, 5], [3.0, 2.0, 1.0], [float(k % 7) for k in range(60)])], "case_id string, shape array<int>, spacing array<double>, data array<float>")
    for ending in rasters.ENCODERS:
        for r in rasters.encode_files(v, ending).collect():
            (tmp_path / r.name).write_bytes(r.content)
    got = rasters.with_side_spacing(spark, images.read_volumes(spark, str(tmp_path), "*.tif"), str(tmp_path)).first()
    assert got.spacing == [3.0, 2.0, 1.0] and got.shape == [3, 4, 5] and got.data[:7] == list(range(7))
    labels = images.encode_labels(v.withColumn("shape", F.slice("shape", 2, 3)).withColumn("affine", F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 3, 0)]))).first()
    assert images.read_nifti(labels.content)[1] == [3.0, 2.0, 1.0]


def test_new_files_arrive_once(spark, tmp_path):
    from voxelloom.streaming.arrivals import arriving_files, store_new

    src, out, mark = (tmp_path / n for n in ("src", "out", "mark"))
    src.mkdir()
    for k in range(3):
        (src / f"f{k}.nii").write_bytes(b"x" * (k + 1))
    for want in (3, 4):
        store_new(arriving_files(spark, str(src)), str(out), str(mark)).awaitTermination()
        assert spark.read.parquet(str(out)).count() == want
        (src / "f9.nii").write_bytes(b"new")


def test_published_flag_names():
    from voxelloom.cli import parser

    base = ["preprocess-dataset", "--task-mode", "unpaired_generative", "--output-folder", "o"]
    args = parser().parse_args([*base, "--folder-a", "a", "--folder-b", "b", "--domain-a-reader", "tiff3d", "--plans-a-file", "p", "--configuration-a-name", "n", "--config-b-json", "c", "--num-processes", "4"])
    assert (args.images_dir, args.target_dir, args.image_reader) == ("a", "b", "tiff3d")
    assert (args.plans_json_a, args.configuration_a, args.config_json_b, args.config_json) == ("p", "n", "c", None)
    args = parser().parse_args([*base, "--source-dir", "s", "--plans-file", "p", "--configuration-name", "n", "--masking-mode", "threshold", "--mask-reader", "auto"])
    assert (args.images_dir, args.plans_json, args.configuration) == ("s", "p", "n")


def test_named_readers(spark):
    from voxelloom.sources import scan

    files = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert scan.checked_reader(files("a.png"), "auto") is None and not scan.checked_reader(files("a.mha", "b.nii.gz"), "simpleitk").turns
    assert scan.checked_reader(files("a.nii"), "nibabel_reorient").turns and scan.checked_reader(files("a.mha"), "simpleitk_reorient").turns
    for names, reader in ((("a.nii", "b.png"), "nibabel"), (("a.nii",), "simpleitk_reorient"), (("a.png",), "tiff")):
        with pytest.raises(ValueError):
            scan.checked_reader(files(*names), reader)
    asked = {"overwrite_image_reader_writer": "NibabelIOWithReorient", "file_ending": ".nii.gz"}
    assert scan.checked_reader(files("a.nii"), "auto", asked).name == "nibabel_reorient"
    assert scan.checked_reader(files("a.nii"), "nibabel", asked).name == "nibabel"


def test_readers_by_ending_example_and_description():
    from voxelloom.sources import rasters, readers

    volume = rng.integers(0, 9, (3, 4, 5)).astype(np.uint8)
    assert [readers.by_ending(e).name for e in (".nii.gz", ".nii", ".TIF", ".tiff", ".png")] == ["simpleitk", "nibabel", "natural_2d", "tiff3d", "natural_2d"]
    assert readers.by_ending(".tif", ("a.tif", rasters.write_tiff(volume))).name == "tiff3d"
    assert readers.by_ending(".tif", ("a.tif", rasters.write_tiff(volume[:1]))).name == "natural_2d"
    assert readers.by_ending(".xyz", ("a.mha", rasters.write_meta(volume, [1.0, 1.0, 1.0])), nonmatching=True).name == "simpleitk"
    for wrong in ((".xyz",), (".tif", ("a.tif", b"nothing"))):
        with pytest.raises(ValueError):
            readers.by_ending(*wrong)
    assert readers.by_description({"overwrite_image_reader_writer": "Tiff3DIO", "file_ending": ".png"}).name == "tiff3d"
    assert readers.by_description({"overwrite_image_reader_writer": "None", "file_ending": ".nii"}).name == "nibabel"
    assert readers.by_description({"overwrite_image_reader_writer": "OtherIO", "file_ending": ".png"}).name == "natural_2d"


def test_own_reader_and_statistics_of_files(spark, tmp_path):
    from voxelloom.sources import readers

    values = {}
    for k in range(3):
        values[f"case_{k:04d}"] = v = rng.normal(size=(3, 4, 5)).astype(np.float32)
        v[0] = 0
        (tmp_path / f"case_{k:04d}_0000.raw32").write_bytes(v.tobytes())
    (tmp_path / "dataset.json").write_text('{"channel_names": {"0": "CT"}}')
    own = readers.Reader("raw32", (".raw32",), lambda name, raw: (np.frombuffer(raw, "<f4").reshape(3, 4, 5), [3.0, 1.0, 1.0], [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 3, 0]))
    cases = scan.load_cases(spark, str(tmp_path), reader=own)
    assert {r.case_id: r.image for r in cases.collect()} == {k: v.ravel().tolist() for k, v in values.items()}
    inside = np.concatenate([v[1:].ravel() for v in values.values()]).astype(float)
    got = pipeline.file_statistics(spark, str(tmp_path), reader=own, clip=(-1.0, None))["0"]
    want = np.clip(inside, -1, None)
    assert np.allclose([got[k] for k in ("mean", "std", "min", "median", "percentile_99_5")], [want.mean(), want.std(), -1, *np.percentile(want, [50, 99.5])]) and got["clip_min"] == -1
    for r in pipeline.case_statistics(cases).collect():
        v = values[r.case_id][1:].astype(float)
        assert np.allclose([r["mean"], r["std"], r["max"], r["median"]], [v.mean(), v.std(), v.max(), np.median(v)])
    with pytest.raises(ValueError):
        readers.register(readers.Reader("nibabel", (".x",), own.read))
    assert scan.dataset_description(spark, None, str(tmp_path / "below")) == {"channel_names": {"0": "CT"}}
    (tmp_path / "sub").mkdir()
    assert scan.dataset_description(spark, str(tmp_path / "sub" / "deep")) is None


def test_spacing_of_masks_must_agree(spark, cases):
    masks = cases.select("case_id", F.concat(F.array(F.lit(1)), F.slice("shape", 2, 3)).alias("shape"), "spacing", F.col("reference").alias("image"))
    plain = cases.drop("reference", "ref_channels")
    assert scan.matched(plain, masks, "mask", same_spacing=True).select("mask").count() == 6
    other = masks.withColumn("spacing", F.array(*[F.lit(v) for v in (2.0, 1.0, 1.5)]))
    assert len(scan.matched(plain, other, "mask").select("mask").collect()) == 6
    with pytest.raises(Exception, match="spacings differ"):
        scan.matched(plain, other, "mask", same_spacing=True).select("mask").collect()


def test_manifests_that_do_not_agree_are_refused(spark, tmp_path):
    ids = spark.createDataFrame([(f"c{k}",) for k in range(5)], "identifier string")
    row = manifest.manifest(ids, "segmentation", "train", patch="2x3x3")
    wrong = {
        "version": ("format_version", F.lit(2)), "task": ("task_mode", F.lit("other")), "kind": ("dataset_kind", F.lit("unpaired_domains")), "storage": ("storage_format", F.lit("tape")),
        "patch": ("default_patch_size", F.lit("2x-3")), "configuration": ("default_configuration", F.lit("3d")), "again": ("identifiers", F.array(F.lit("c0"), F.lit("c0"))), "none": ("identifiers", F.lit(None).cast("array<string>")),
    }
    manifest.save_manifest(row, str(tmp_path / "right"))
    assert manifest.load_any(spark, str(tmp_path / "right")).count() == 1
    for name, (field, value) in wrong.items():
        manifest.save_manifest(row.withColumn(field, value), str(tmp_path / name))
        with pytest.raises(ValueError):
            manifest.load_manifest(spark, str(tmp_path / name))


def test_grids_by_kernel_and_by_expression_agree(spark):
    rows = [(1, [1, 5, 4, 3], [float(v) for v in range(60)]), (2, [2, 2, 7, 3], [float(v) for v in range(84)])]
    df = spark.createDataFrame(rows, "case_id long, shape array<int>, data array<float>")
    for size in ((2, 3, 2), (4, 4), (6, 6, 6)):
        want = patches.crop(patches.grid(df, size), size).select("case_id", "patch", "starts", "data")
        got = patches.grid_patches(df, size).select("case_id", "patch", "starts", "data")
        key = lambda r: (r.case_id, r.patch)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect())), key
        back = patches.merge(patches.grid_patches(df, size), size).collect()
        assert {r.case_id: list(r.data) for r in back} == {r[0]: r[2] for r in rows}
