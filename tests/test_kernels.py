import gzip
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelloom.operators import case, masks, resample
from voxelloom.plans.planner import Config, Resampling
from voxelloom.sources import images, orientation, rasters

rng = np.random.default_rng(0)


def flood_components(mask):
    lab, n = np.zeros(mask.shape, int), 0
    for start in np.argwhere(mask):
        if lab[tuple(start)]:
            continue
        n += 1
        todo = [tuple(start)]
        while todo:
            p = todo.pop()
            if min(p) < 0 or any(a >= b for a, b in zip(p, mask.shape, strict=True)) or not mask[p] or lab[p]:
                continue
            lab[p] = n
            todo += [tuple(np.add(p, s)) for s in np.vstack([np.eye(3, dtype=int), -np.eye(3, dtype=int)])]
    return lab


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_components_and_holes(share):
    mask = rng.random((6, 7, 5)) < share
    assert (masks.components(mask) == flood_components(mask)).all()
    outside = flood_components(np.pad(~mask, 1, constant_values=True))
    holes = ~mask & (outside != 1)[1:-1, 1:-1, 1:-1]
    assert (masks.fill_holes(mask) == mask | holes).all()
    sizes = np.bincount(flood_components(mask)[mask])
    assert masks.largest(mask).sum() == sizes.max()
    assert not masks.largest(np.zeros((2, 2, 2), bool)).any()


def test_closing_loses_the_layer_at_the_border():
    full = np.ones((5, 5, 5), bool)
    assert masks.closing(full).sum() == 27
    gap = np.zeros((7, 7, 7), bool)
    gap[2:5, 2:5, 2:5] = True
    gap[3, 3, 3] = False
    assert masks.closing(gap)[3, 3, 3]


@given(st.integers(2, 12), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_matrices(n_in, n_out):
    for order in (0, 1, 3):
        m = case.axis_matrix(n_in, n_out, order)
        assert np.allclose(m.sum(axis=1), 1.0)
    assert np.allclose(case.axis_matrix(n_in, n_in, 3), np.eye(n_in))
    assert np.allclose(resample.cubic_matrix(n_in, n_in), np.eye(n_in), atol=1e-9)


def test_cubic_follows_a_ramp_away_from_edges():
    x = np.arange(40.0)
    out = resample.cubic_matrix(40, 80) @ x
    want = (np.arange(80) + 0.5) / 2 - 0.5
    assert np.allclose(out[24:56], want[24:56], atol=1e-5)


def test_labels_stay_labels_and_separate_axes():
    labels = rng.integers(0, 4, (1, 5, 8, 8)).astype(np.float32)
    for order in (0, 1):
        for spacing in ([1, 1, 1], [5, 1, 1]):
            out = case.resample_array(labels, [9, 11, 6], spacing, [1, 1, 1], Resampling(3, 0, order, order), labels=True)
            assert out.shape == (1, 9, 11, 6) and set(np.unique(out)) <= set(range(4))
    image = rng.normal(size=(2, 4, 6, 6))
    out = case.resample_array(image, [8, 6, 6], [6, 1, 1], [3, 1, 1], Resampling(3, 0))
    assert np.allclose(out[:, ::2], image)  # the coarse axis by nearest, nothing in plane
    assert case.resample_array(image, [4, 6, 6], [1, 1, 1], [1, 1, 1], Resampling()) is image


CONFIG = Config([1.0, 1.0, 1.0], [1, 0, 2], ["ZScoreNormalization"], [False])


def test_run_case_and_undo():
    image = rng.normal(size=(1, 6, 5, 7)).astype(np.float32)
    label = (rng.random((1, 6, 5, 7)) > 0.7).astype(np.float32) * 3
    config = Config([1.0, 2.0, 1.0], [1, 0, 2], ["ZScoreNormalization"], [False], {"0": {"mean": float(image.mean()), "std": float(image.std())}}, Resampling(1, 0, 0))
    out = case.run_case(image, [2.0, 1.0, 1.0], config, reference=label)
    assert out["image"].shape == (1, 5, 6, 7) and out["target"].dtype == np.int8 and abs(out["image"].mean()) < 1e-6
    assert {tuple(p[1:]) for p in out["class_locations"][3].tolist()} == {tuple(p) for p in np.argwhere(out["target"][0] == 3)}
    back = case.undo(out["image"], config, out["shape_before"], out["spacing_before"], case.Settings())
    assert np.allclose(back, image, atol=1e-5)


def test_stages_and_errors():
    image, label = np.ones((1, 4, 4, 4), np.float32), np.zeros((1, 4, 4, 4), np.float32)
    out = case.run_case(image, [1, 1, 1], CONFIG, stage="predict_and_evaluate", reference=label)
    assert out["target"] is None and out["evaluation_reference"] is label
    paired = case.run_case(image, [1, 1, 1], CONFIG, task="paired_generative", reference=image * 2)
    assert paired["target"].dtype == np.float32 and not paired["class_locations"]
    for bad in (
        dict(image=image, spacing=[1, 1, 1], reference=None), dict(image=image, spacing=[1, 1, 0], reference=label), dict(image=image * np.nan, spacing=[1, 1, 1], reference=label),
        dict(image=image, spacing=[1, 1, 1], reference=label[:, :3]), dict(image=np.ones((2, 4, 4, 4)), spacing=[1, 1, 1], reference=label), dict(image=image[0], spacing=[1, 1, 1], reference=label),
    ):
        with pytest.raises(ValueError):
            case.run_case(bad["image"], bad["spacing"], CONFIG, reference=bad["reference"])


def test_masks_are_united_and_masked_scores_leave_the_outside():
    image = np.zeros((1, 5, 5, 5), np.float32)
    image[0, 1:4, 1:4, 1:4] = rng.normal(size=(3, 3, 3)) + 5
    out = case.run_case(image, [1, 1, 1], Config([1.0] * 3, [0, 1, 2], ["ZScoreNormalization"], [True]), task="self_supervised", rules=case.MaskRules(image_threshold=1.0, closing=0), settings=case.Settings(locations=False))
    assert (out["image"][0][image[0] == 0] == 0).all() and abs(out["image"][0, 1:4, 1:4, 1:4].mean()) < 1e-6
    assert out["mask"].sum() == 27 and len(out["mask_locations"]) == 27
    assert case.thresholds(0.5, {"image": None}) == {"image": None, "target": 0.5}


def test_normalizers_and_inverses():
    v, stats = rng.normal(size=(3, 3, 3)) * 10, {"mean": 1.0, "std": 2.0, "percentile_00_5": -5.0, "percentile_99_5": 5.0, "clip_min": None, "clip_max": None}
    assert np.allclose(case.normalize(v, "CTNormalization", stats, None), (np.clip(v, -5, 5) - 1) / 2)
    assert np.allclose(case.inverse_normalize(case.normalize(v, "MinMaxClipNormalization", {"clip_min": -100, "clip_max": 100}, None), "MinMaxClipNormalization", {"clip_min": -100, "clip_max": 100}), v)
    assert case.normalize(v, "RescaleTo01Normalization", None, None).max() == 1.0
    assert np.allclose(case.normalize(v, "RGBTo01Normalization", None, None) * 255, v)
    for scheme in ("CTNormalization", "MinMaxClipNormalization", "other"):
        with pytest.raises(ValueError):
            case.normalize(v, scheme, None, None)
    with pytest.raises(ValueError):
        case.inverse_normalize(v, "RescaleTo01Normalization", None)


def test_file_formats_round_trip():
    volume, spacing = rng.integers(0, 200, (3, 4, 5)).astype(np.uint8), [3.0, 2.0, 1.0]
    wide = volume.astype(np.uint16) * 300
    for v in (volume, wide):
        for raw, name in ((images.write_nifti(v, spacing), "a.nii.gz"), (images.write_nifti(v, spacing, compress=False), "a.nii"), (rasters.write_meta(v, spacing), "a.mha"), (rasters.write_nrrd(v, spacing), "a.nrrd"), (rasters.write_tiff(v), "a.tif")):
            data, got, _ = images.decode(name, raw)
            assert (data == v).all() and (name == "a.tif" or got == spacing), name
        data, got, _ = images.decode("a.PNG", rasters.write_png(v[0]))
        assert data.shape == (1, 1, 4, 5) and (data[0, 0] == v[0]).all() and got == [999.0, 1.0, 1.0]
    import struct

    pixels = rng.integers(0, 255, (3, 4, 3)).astype(np.uint8)
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, 0, 0, 0, 0, 0) + pixels[::-1, :, ::-1].tobytes()
    assert (images.decode("a.bmp", bmp)[0][:, 0].transpose(1, 2, 0) == pixels).all()
    gipl = struct.pack(">5H", 5, 4, 3, 1, 8) + struct.pack(">3f", 1, 2, 3) + b"\0" * 230 + struct.pack(">I", 0xEFFFE9B0) + volume.tobytes()
    data, got, _ = images.decode("a.gipl", gipl)
    assert (data == volume).all() and got == spacing
    flipped = images.write_nifti(volume, spacing, [-1.0, 0, 0, 4, 0, 2.0, 0, 0, 0, 0, 3.0, 0])
    assert (images.decode("a.nii.gz", flipped, True)[0] == volume[:, :, ::-1]).all()
    for name in ("a.nii", "a.nrrd", "a.png", "a.tif", "a.bmp", "a.xyz"):
        with pytest.raises(Exception):
            images.decode(name, b"nothing at all" * 40)


def affine_of(order, signs, spacing, origin, angle=0.0):
    """x, y, z spacings; data axis k runs along world axis order[k]."""
    c, s = np.cos(angle), np.sin(angle)
    cols = np.zeros((3, 3))
    for k, (w, sign) in enumerate(zip(order, signs, strict=True)):
        cols[w, k] = sign * spacing[k]
    return np.concatenate([np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ cols, np.array(origin)[:, None]], axis=1)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 0, 2), (2, 1, 0)])
@pytest.mark.parametrize("signs", [(1, 1, 1), (-1, 1, -1), (-1, -1, 1)])
@pytest.mark.parametrize("angle", [0.0, 0.4])
def test_turned_volumes_keep_their_place_and_turn_back(order, signs, angle):
    rng = np.random.default_rng(3)
    data, spacing = rng.normal(size=(2, 3, 4, 5)), [3.0, 2.0, 1.0]
    affine = affine_of(order, signs, spacing[::-1], [7.0, -2.0, 1.0], angle)
    turned, new_spacing, new = orientation.to_ras(data, spacing, affine.ravel().tolist())
    new = np.array(new).reshape(3, 4)
    assert (np.abs(new[:, :3]).argmax(axis=0) == range(3)).all() and (np.diag(new[:, :3]) > 0).all()
    place = {tuple(np.round(affine[:, :3] @ [x, y, z] + affine[:, 3], 6) + 0.0): data[:, z, y, x].tolist() for z in range(3) for y in range(4) for x in range(5)}
    nz, ny, nx = turned.shape[1:]
    got = {tuple(np.round(new[:, :3] @ [x, y, z] + new[:, 3], 6) + 0.0): turned[:, z, y, x].tolist() for z in range(nz) for y in range(ny) for x in range(nx)}
    assert got == place and np.allclose(np.linalg.norm(new[:, :3], axis=0)[::-1], new_spacing)
    back, old_spacing = orientation.from_ras(turned, new_spacing, affine.ravel().tolist())
    assert (back == data).all() and old_spacing == spacing


def test_headers_hold_the_place_in_the_world():
    volume, spacing = np.arange(24, dtype=np.int16).reshape(2, 3, 4), [3.0, 2.0, 1.5]
    affine = affine_of((0, 2, 1), (-1, 1, 1), spacing[::-1], [4.0, 5.0, -6.0], 0.3).ravel().tolist()
    for raw, name in ((rasters.write_meta(volume, spacing, affine), "a.mha"), (rasters.write_nrrd(volume, spacing, affine), "a.nrrd"), (images.write_nifti(volume, spacing, affine), "a.nii.gz")):
        data, got, found = images.decode(name, raw)
        assert (data == volume).all() and np.allclose(got, spacing) and np.allclose(found, affine, atol=1e-5)
        turned = images.decode(name, raw, True)
        assert (orientation.from_ras(turned[0], turned[1], affine)[0] == volume).all()
    # without directions, axes count towards left and posterior
    assert images.decode("a.mha", rasters.write_meta(volume, spacing))[2] == [-1.5, 0, 0, 0, 0, -2.0, 0, 0, 0, 0, 3.0, 0]
    assert (images.decode("a.mha", rasters.write_meta(volume, spacing), True)[0] == volume[:, ::-1, ::-1]).all()
    space = b"NRRD0004\ntype: short\ndimension: 3\nspace: %s\nsizes: 4 3 2\nspace directions: (1.5,0,0) (0,2,0) (0,0,3)\nspace origin: (1,2,3)\nendian: little\nencoding: raw\n\n" + volume.tobytes()
    for name, want in ((b"right-anterior-superior", [1.5, 0, 0, 1, 0, 2, 0, 2, 0, 0, 3, 3]), (b"LAS", [-1.5, 0, 0, -1, 0, 2, 0, 2, 0, 0, 3, 3]), (b"left-posterior-superior", [-1.5, 0, 0, -1, 0, -2, 0, -2, 0, 0, 3, 3])):
        assert images.decode("a.nrrd", space.replace(b"%s", name))[2] == want


def test_four_dimensions_are_channels():
    text = b"ObjectType = Image\nNDims = 4\nDimSize = 4 3 2 5\nElementSpacing = 1 2 3 9\nElementType = MET_SHORT\nElementDataFile = LOCAL\n"
    data, spacing, affine = images.decode("a.mha", text + np.arange(120, dtype=np.int16).tobytes())
    assert data.shape == (5, 2, 3, 4) and (data.ravel() == np.arange(120)).all() and spacing == [3.0, 2.0, 1.0] and len(affine) == 12


def test_predictions_keep_a_reference_header():
    reference = bytearray(gzip.decompress(images.write_nifti(np.zeros((2, 3, 4), np.int16), [3.0, 2.0, 1.0], [0, 0, 1, 5, 1, 0, 0, 6, 0, 2, 0, 7])))
    reference[148:152] = b"note"
    struct.pack_into("<2f", reference, 112, 3.0, 9.0)  # scaling of the reference's own numbers
    volume = np.random.default_rng(1).normal(size=(2, 3, 4)).astype(np.float32)
    raw = images.write_nifti_like(volume, bytes(reference))
    data, spacing, affine = images.read_nifti(raw)
    assert (data == volume).all() and spacing == [3.0, 2.0, 1.0] and affine == [0, 0, 1, 5, 1, 0, 0, 6, 0, 2, 0, 7] and gzip.decompress(raw)[148:152] == b"note"
