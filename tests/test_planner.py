import pytest

from voxelloom.plans import planner
from voxelloom.sources import store


@pytest.mark.parametrize(
    ("spacing", "patch", "counts", "divisors"),
    [((1, 1, 1), (128, 128, 128), [5, 5, 5], [32, 32, 32]), ((3, 1, 1), (40, 192, 192), [3, 5, 5], [8, 32, 32]), ((5, 0.7, 0.7), (20, 256, 256), [2, 6, 6], [4, 64, 64]), ((1, 1), (512, 512), [7, 7], [128, 128])],
)
def test_pools(spacing, patch, counts, divisors):
    got = planner.pools(spacing, patch)
    assert (got[0], got[3], got[2]) == (counts, divisors, list(patch))


@pytest.mark.parametrize(("spacing", "shape", "cases", "patch", "batch"), [((1, 1, 1), (128,) * 3, 10, [128] * 3, 2), ((3, 1, 1), (40, 192, 192), 100, [40, 192, 192], 5), ((1, 1, 1), (4, 4, 4), 500, [4, 4, 4], 25)])
def test_patch_and_batch(spacing, shape, cases, patch, batch):
    assert planner.patch_and_batch(spacing, shape, cases) == (patch, batch)


def test_split_counts():
    assert [planner.split_counts(n, 0.2) for n in (2, 5, 10, 12, 13, 500)] == [1, 1, 2, 2, 3, 100]
    assert planner.split_counts(1, 0) == 0
    for n, ratio in ((1, 0.2), (5, 1.0)):
        with pytest.raises(ValueError):
            planner.split_counts(n, ratio)


def test_target_spacing():
    assert planner.target_spacing([5, 1, 1], [10, 100, 100], [4, 1, 1]) == [4, 1, 1]
    assert planner.target_spacing([5, 1, 1], [10, 100, 100], [0.5, 1, 1]) == [1 + 1e-5, 1, 1]
    assert planner.target_spacing([5, 1, 1], [80, 100, 100], [4, 1, 1]) == [5, 1, 1]
    assert planner.target_spacing([5, 1, 1], [10, 100, 100], [4, 1, 1], [2, 2, 2]) == [2, 2, 2]


def test_configs():
    plans = {"transpose_forward": [0, 1, 2], "configurations": {"base": {"spacing": [1, 1, 1], "normalization_schemes": ["CTNormalization"], "use_mask_for_norm": [False]}, "fine": {"inherits_from": "base", "spacing": [0.5] * 3}}}
    assert planner.config_from_json(plans, "fine").spacing == [0.5] * 3
    with pytest.raises(ValueError):
        planner.config_from_json(plans)
    plans["configurations"]["base"]["inherits_from"] = "fine"
    with pytest.raises(ValueError):
        planner.config_from_json(plans, "fine")
    config = planner.Config([1, 1, 1], [2, 0, 1], ["ZScoreNormalization"], [True])
    assert planner.config_from_json(planner.config_to_json(config)) == config
    assert planner.override_schemes(config, "minmax", 0, 5).stats["0"]["clip_max"] == 5
    assert planner.override_schemes(config, "ct").use_mask == [False]
    for bad in (([0, 1, 1], [0, 1, 2], ["a"], [True]), ([1, 1, 1], [0, 1, 1], ["a"], [True]), ([1, 1, 1], [0, 1, 2], ["a"], [])):
        with pytest.raises(ValueError):
            planner.Config(*bad)
    with pytest.raises(ValueError):
        planner.override_schemes(config, "minmax", 5, 5)


def test_names_and_merging():
    assert planner.schemes(planner.channel_names({"channel_names": {"1": "T2", "0": "CT"}}, 2)) == ["CTNormalization", "ZScoreNormalization"]
    with pytest.raises(ValueError):
        planner.channel_names({"modality": {"0": "CT"}}, 2)
    a = planner.configurations([1, 1, 1], [64, 64, 64], 10)
    b = {"3d": {**a["3d"], "patch_size": [32, 80, 64], "batch_size": 1}}
    merged = planner.merge_configurations(a, b)
    assert merged.keys() == {"3d"} and merged["3d"]["patch_size"] == [32, 64, 64] and merged["3d"]["batch_size"] == 1
    assert planner.default_configuration(a) == "3d" and planner.default_configuration({}) is None
    assert planner.transpose_axes([1, 3, 1]) == ([1, 0, 2], [1, 0, 2])


@pytest.mark.parametrize("task", ["segmentation", "paired_generative", "unpaired_generative", "self_supervised"])
def test_requests(task):
    for stage in planner.STAGES:
        rule = planner.REFERENCE_RULE.get((task, stage))
        for has in (True, False):
            if rule and (rule == "required") == has:
                planner.check_request(task, stage, has)
            else:
                with pytest.raises(ValueError):
                    planner.check_request(task, stage, has)


def test_bricks():
    block, chunk = store.brick_shape([64, 128, 128])
    assert 4 * block[0] * block[1] * block[2] <= 32_768 * 0.8 and all(c % b == 0 for b, c in zip(block, chunk, strict=True))
