"""Kernels over rows return many small results in a frame: a frame each took most of the time (F1, F2)."""

import numpy as np
import pandas as pd
import pytest

from voxelloom.operators import patches
from voxelloom.plans import pipeline, planner

CONFIG = planner.Config([1.0, 1.0, 1.0], [1, 2, 0], ["NoNormalization"], [False], {}, planner.Resampling(3, 0, 1, 0))


class Here:
    """Stands for a DataFrame and runs map functions at once, so that the frames they return can be counted."""

    def __init__(self, pdf):
        self.pdf, self.columns = pdf, list(pdf)

    def select(self, *_):
        return self

    def join(self, *_):
        return self

    def mapInPandas(self, run, schema):
        return list(run(iter([self.pdf])))


def volumes(n):
    return [np.random.default_rng(k).normal(size=(1, 4, 4, 4)).astype(np.float32) for k in range(n)]


def test_cases_leave_many_to_a_frame(spark):
    images = volumes(300)
    rows = pd.DataFrame({"case_id": [f"c{k}" for k in range(300)], "shape": [[1, 4, 4, 4]] * 300, "spacing": [[1.0, 1.0, 1.0]] * 300, "image": [v.ravel() for v in images]})
    done = pipeline.preprocess(Here(rows), CONFIG, task="segmentation", stage="predict")
    assert len(done) == 1 and list(done[0]["case_id"]) == list(rows["case_id"])
    assert all(np.array_equal(np.reshape(a, (4, 4, 4)), v[0].transpose(1, 2, 0)) for a, v in zip(done[0]["image"], images, strict=True))
    made = Here(done[0].assign(data=done[0]["image"]))
    back = pipeline.restore(made, made, CONFIG)
    assert len(back) == 1 and all(np.array_equal(a, v.ravel()) for a, v in zip(back[0]["data"], images, strict=True))


@pytest.mark.parametrize("records", ["1", "5", "10000"])
def test_slabs_that_lie_in_several_batches(spark, records):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        rows = [(k, [1, 4, 4, 4], v.ravel().tolist()) for k, v in enumerate(volumes(5))]
        df = spark.createDataFrame(rows, "case_id long, shape array<int>, data array<float>")
        back = patches.merge(patches.grid_patches(df, (2, 3, 3), model=lambda a: 2 * a), (2, 3, 3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(back) == 5 and all(np.array_equal(r.data, 2 * np.array(rows[r.case_id][2], np.float32)) for r in back)


def test_large_results_are_split():
    got = list(patches.frames(((k, np.zeros(1 << 18, np.float32)) for k in range(10)), ["k", "data"]))
    assert [len(f) for f in got] == [4, 4, 2] and [k for f in got for k in f["k"]] == list(range(10))


def test_patches_leave_many_to_a_frame():
    rows = pd.DataFrame({"case_id": range(100), "shape": [[1, 4, 4, 4]] * 100, "data": [v.ravel() for v in volumes(100)]})
    cut = lambda case_id, shape, data: ((case_id, k, data[k : k + 8]) for k in range(27))
    got = patches.over_rows(Here(rows), ["case_id", "shape", "data"], cut, "case_id long, patch int, data array<float>")
    assert len(got) == 1 and got[0].columns.tolist() == ["case_id", "patch", "data"] and len(got[0]) == 2700


def test_a_model_may_use_its_output_and_input_again(spark):
    df = spark.createDataFrame([(0, [1, 4, 4, 4], volumes(1)[0].ravel().tolist())], "case_id long, shape array<int>, data array<float>")
    out = np.zeros((1, 2, 2, 2), np.float32)

    def model(patch):
        patch *= 2
        out[:] = patch
        return out

    got = patches.grid_patches(df, (2, 2, 2), model=model).select("patch", "data").collect()
    want = patches.grid_patches(df, (2, 2, 2)).select("patch", "data").collect()
    assert {r.patch: list(r.data) for r in got} == {r.patch: [2 * v for v in r.data] for r in want}
