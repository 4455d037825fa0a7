import numpy as np
import pytest
from pyspark.sql import types as T

from voxelloom.llm import mtree, pqdedup

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("list", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("uid", T.LongType())])


def vectors(n=700, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 5):  # near copies, some of them across labels
        x[k] = x[(k * 7 + 1) % n] * rng.uniform(0.5, 2) + rng.normal(size=dim) * 0.05
    x[50:60] = x[50]
    rows = [(int(k), [float(np.float32(v)) for v in x[k]], int(k % 4) if k % 9 else None, 1, 2, 3) for k in range(n)]
    bad = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), []]
    rows += [(10_000 + 100 * k, v, 1, 1, 2, 3) for k, v in enumerate(bad)]
    return rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_top(rows, k=10):
    pts = [(r[0], np.floor(1024 * np.array(r[1], float)).astype(np.int64)) for r in rows if r[0] is not None and usable(r[1])]
    dim = max(len(v) for _, v in pts)
    ids, flat = np.array([i for i, _ in pts]), np.stack([np.pad(v, (0, dim - len(v))) for _, v in pts])
    out = []
    for at, (q, _) in enumerate(pts):
        if q % 100 == 0:
            best = sorted((-int(s), i) for n, (s, i) in enumerate(zip(flat @ flat[at], ids.tolist(), strict=True)) if n != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "options"), [(4096, {}), (64, {"pack": 2, "first": 1}), (50, {"fan": 3})])
def test_top_k(spark, block, options):
    rows = vectors()
    # repeated rows, rows that share a query's vec_id, and a query that is there twice
    rows += [rows[100], (200, rows[7][1], 1, 1, 2, 3), (300, rows[9][1], 1, 1, 2, 3), rows[8], rows[8], (None, rows[3][1], 1, 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in mtree.exact_top_k(df, block=block, **options).collect()) == brute_top(rows)


def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12))
    centres *= 3 / np.linalg.norm(centres, axis=1, keepdims=True)
    return np.concatenate([c + rng.normal(size=(100, 12)) * 0.02 for c in centres])


def test_the_tree_computes_few_distances():
    points = (clustered() * 1000).astype(np.int64)
    tree = mtree.MTree(points, np.arange(len(points)))
    found, computed = tree.search(points[5], 5, 10)
    want = sorted(((int(points[5] @ p), -i) for i, p in enumerate(points) if i != 5), reverse=True)[:10]
    assert sorted(((s, -i) for s, i, _ in found), reverse=True) == want
    assert computed < len(points) / 5


def test_the_bound_of_the_first_round_leaves_subtrees_out(spark):
    points = clustered()
    rows = [(k, [float(v) for v in p]) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree.searches(df, block=100)
    queries, computed = len(range(0, len(rows), 100)), found.agg(mtree.F.sum("computed")).first()[0]
    assert computed / queries < len(rows) / 4
    assert sorted(tuple(r) for r in mtree.exact_top_k(df, block=100).collect()) == brute_top(rows)


def test_fewer_than_k_and_none(spark):
    two = spark.createDataFrame(vectors()[:2], SCHEMA)
    assert {tuple(r)[:3] for r in mtree.exact_top_k(two).collect()} == {(0, 1, 1)}
    assert mtree.exact_top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mtree.exact_top_k(spark.createDataFrame(vectors()[1:3], SCHEMA)).collect() == []


def brute_dedup(rows, threshold=0.98):
    ok = [usable(r[1]) and len(r[1]) > 0 and any(r[1]) and r[2] is not None for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2]:
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], links[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("list_rows", "block", "fit_rows"), [(1024, 512, 200), (20, 8, 200), (4, 8, 40)])  # the last has fine lists
def test_dedup(spark, list_rows, block, fit_rows):
    rows = vectors(400) + vectors(400)[7:12] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    got = pqdedup.embedding_dedup(df, list_rows=list_rows, block=block, probing=2 * block, fit_rows=fit_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute_dedup(rows)


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.1], 1.2), (2, [1.0, 0.1], 1.7), (3, [1.0, 0.1000001], 1.2), (4, [1.0, 1e-300], 1.2), (5, [1.0, 0.1], None)]
    rows_of = lambda cast: [(i, v, None if y is None else cast(y)) for i, v, y in rows]
    want = brute_dedup(rows)
    for kind, cast in (("double", float), ("string", str)):
        df = spark.createDataFrame(rows_of(cast), f"vec_id long, embedding array<double>, label {kind}")
        assert sorted(map(tuple, pqdedup.embedding_dedup(df).collect())) == want


def test_dedup_of_nothing(spark):
    assert pqdedup.embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    only_bad = spark.createDataFrame(vectors()[-6:], SCHEMA)
    assert all(r.n_links == 0 and r.kept for r in pqdedup.embedding_dedup(only_bad).collect())
    null_id = spark.createDataFrame([(None, [1.0], 1, 1, 1, 1)], SCHEMA)
    assert [tuple(r) for r in pqdedup.embedding_dedup(null_id).collect()] == [(None, 0, None, True)]
