"""Exact top-k inner products by best-first search of an M-tree.

Inner products become distances by one more component: with M the longest norm of all vectors,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. The tree
has pages of routing objects, each with its covering radius and its distance to the parent
routing object, and leaf pages of vectors with theirs. A search takes pages from a queue by
their smallest possible distance; where the stored distances and the triangle inequality
already rule an entry out, its distance is never computed. Scores are integers, so the last
comparison is exact; the bounds have a slack above their rounding error.

The root page lies on the driver: at most `fan` routing objects from a bounded sample. Every
vector goes to its nearest one, and a hot object is split into subtrees of bounded size, which
are built once, each in one task, and written with their covering radius. A query searches the
subtrees in two rounds: first the `first` ones of least possible distance, which gives it a
bound, then, with that bound carried along, only the others that may still hold a better one.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without
a vec_id take no part; shorter vectors count as filled up with zeros; every row is a vector of
its own, also where rows repeat or share a vec_id, and a query leaves out its own row alone; a
vec_id that is asked twice has its ranks twice; ties go to the smaller vec_id; no rows give no
rows; extra columns are ignored. Components are taken to lie within +-2^20, so that scores fit
a long.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelloom.llm.shared import small_batches, written

FOUND = "query long, query_id long, uid long, vec_id long, score long, computed long"


def lifted(points: np.ndarray, most: float) -> np.ndarray:
    """Points with the component that makes all of them sqrt(most) long."""
    flat = points.astype(float)
    return np.concatenate([flat, np.sqrt(np.maximum(most - (flat**2).sum(axis=1), 0.0))[:, None]], axis=1)


class MTree:
    """page: most entries of a page. Node: (leaf, entries, distances to the parent object[, radii, children])."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, uids: np.ndarray | None = None, page: int = 64, most: float | None = None, centre: np.ndarray | None = None, seed: int = 5):
        self.points, self.ids, self.page = points, ids, page
        self.uids = ids if uids is None else uids
        self.most = float((points.astype(float) ** 2).sum(axis=1).max(initial=0.0)) if most is None else most
        self.flat, self.centre = lifted(points, self.most), centre
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), centre)
        self.radius = math.inf if centre is None else float(self._distance(np.arange(len(points)), centre).max(initial=0.0))

    def _distance(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.flat[rows] - to) ** 2).sum(axis=1), 0.0))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> tuple:
        to_parent = np.zeros(len(rows)) if parent is None else self._distance(rows, parent)
        if len(rows) <= self.page:
            return True, rows, to_parent
        fan = min(self.page, max(2, math.ceil(len(rows) / self.page)))
        pivots = self.rng.choice(rows, fan, replace=False)
        near = np.stack([self._distance(rows, self.flat[p]) for p in pivots], axis=1)
        own = near.argmin(axis=1)
        if (own == own[0]).all():  # equal points: cut by number
            own = np.arange(len(rows)) * fan // len(rows)
        kept = [k for k in range(fan) if (own == k).any()]
        radii = np.array([near[own == k, k].max() for k in kept])
        objects = pivots[kept]
        back = np.zeros(len(objects)) if parent is None else self._distance(objects, parent)
        return False, objects, back, radii, [self._build(rows[own == k], self.flat[pivots[k]]) for k in kept]

    def search(self, q: np.ndarray, own: int, k: int, least_score: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
        """The k best (score, id, uid) by score, then smaller id, and the number of distances computed.

        The row whose uid is `own` is left out, and so may be all below `least_score`, a score
        that k other rows are known to reach.
        """
        norm = float((q.astype(float) ** 2).sum())
        slack = 1e-6 * (norm + self.most + 1.0)
        target = np.append(q.astype(float), 0.0)
        best: list[tuple[int, int, int]] = []  # heap of (score, -id, -uid)
        computed = 0

        def floor() -> int | None:
            """The score below which nothing is wanted."""
            if len(best) < k:
                return least_score
            return best[0][0] if least_score is None else max(best[0][0], least_score)

        def limit() -> float:
            """The distance that a vector must not exceed."""
            return math.inf if (bound := floor()) is None else math.sqrt(max(norm + self.most - 2.0 * bound, 0.0) + slack)

        far = limit()
        d_root = math.nan if self.centre is None else float(np.sqrt(((self.centre - target) ** 2).sum()))
        queue = [(0.0, 0, d_root, self.root)]
        count = 0
        while queue:
            least, _, d_parent, node = heapq.heappop(queue)
            if least > far:
                break
            _, rows, to_parent = node[:3]
            maybe = np.ones(len(rows), bool)
            if not math.isnan(d_parent) and far < math.inf:
                reach = far if node[0] else far + node[3]
                maybe = np.abs(d_parent - to_parent) <= reach + 1e-9 * (1.0 + d_parent)
            at = np.flatnonzero(maybe)
            computed += len(at)
            if not len(at):
                continue
            if node[0]:
                scores, ids, uids = self.points[rows[at]] @ q, self.ids[rows[at]], self.uids[rows[at]]
                if (bound := floor()) is not None:
                    some = scores >= bound
                    scores, ids, uids = scores[some], ids[some], uids[some]
                for s, i, u in zip(scores.tolist(), ids.tolist(), uids.tolist(), strict=True):
                    if u == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i, -u))
                    elif (s, -i, -u) > best[0]:
                        heapq.heapreplace(best, (s, -i, -u))
                far = limit()
            else:
                d = self._distance(rows[at], target)
                for j, dist in zip(at.tolist(), d.tolist(), strict=True):
                    bound = max(dist - float(node[3][j]) - 1e-9 * (1.0 + dist), least)
                    if bound <= far:
                        count += 1
                        heapq.heappush(queue, (bound, count, dist, node[4][j]))
        return [(s, -i, -u) for s, i, u in best], computed


def padded(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def usable(column: str = "embedding"):
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def build_subtrees(points: DataFrame, objects: np.ndarray, most: float, dim: int, block: int) -> DataFrame:
    """(tree, object, radius, blob): the written subtrees of points(uid, vec_id, point), each of about `block` vectors at most."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = lifted(padded(batch.column(2).to_pylist(), dim), most)
            own = ((objects**2).sum(axis=1)[None, :] - 2.0 * flat @ objects.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["uid", "vec_id", "point", "object"])

    small_batches(points)
    dealt = written(points.select("uid", "vec_id", "point").mapInArrow(nearest, "uid long, vec_id long, point array<long>, object long"))
    cuts = dealt.groupBy("object").agg(F.ceil(F.count("*") / block).alias("cuts"))  # at most `fan` rows
    cut = dealt.join(F.broadcast(cuts), "object").withColumn("cut", F.pmod(F.xxhash64(F.lit(2), "uid"), F.col("cuts")))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        tree = MTree(padded(pdf["point"], dim), pdf["vec_id"].to_numpy(np.int64), pdf["uid"].to_numpy(np.int64), most=most, centre=objects[int(key[0])])
        return pd.DataFrame({"object": [key[0]], "cut": [key[1]], "radius": [tree.radius], "blob": [pickle.dumps(tree, protocol=5)]})

    built = cut.select("uid", "vec_id", "point", "object", "cut").groupBy("object", "cut").applyInPandas(build, "object long, cut long, radius double, blob binary")
    return written(built.withColumn("tree", F.monotonically_increasing_id()))


def search_subtrees(trees: DataFrame, asks: DataFrame, k: int, dim: int, pack: int) -> DataFrame:
    """FOUND of asks(tree, query, query_id, point, floor), in groups of about `pack` queries of one subtree."""
    packs = written(asks.groupBy("tree").agg(F.ceil(F.count("*") / pack).cast("int").alias("packs")))
    ask = asks.join(packs, "tree").withColumn("pack", F.pmod(F.xxhash64(F.lit(4), "query"), F.col("packs")).cast("int"))
    data = trees.select("tree", "blob").join(packs, "tree").select("tree", "blob", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"))

    def search(tree: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(tree) and len(ask):
            own = pickle.loads(tree["blob"].iloc[0])
            for query, query_id, q, floor in zip(ask["query"].tolist(), ask["query_id"].tolist(), padded(ask["point"], dim), ask["floor"].tolist(), strict=True):
                found, computed = own.search(q, query, k, None if math.isnan(floor) else int(floor))
                rows += [(query, query_id, u, i, s, computed if n == 0 else 0) for n, (s, i, u) in enumerate(found)] or [(query, query_id, -1, -1, 0, computed)]
        return pd.DataFrame(rows, columns=["query", "query_id", "uid", "vec_id", "score", "computed"], dtype="int64")

    grouped = data.groupBy("tree", "pack").cogroup(ask.select("tree", "pack", "query", "query_id", "point", F.col("floor").cast("double")).groupBy("tree", "pack"))
    return written(grouped.applyInPandas(search, FOUND))


def searches(vectors: DataFrame, *, k: int = 10, scale: int = 1024, every: int = 100, block: int = 4096, fan: int = 256, first: int = 2, pack: int = 1024) -> DataFrame | None:
    """FOUND over both rounds: at least the k best of every query; uid -1 marks a search without result. None: no queries."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    points = vectors.where(F.coalesce(usable(), F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), whole.alias("point"))
    points = written(points.withColumn("uid", F.monotonically_increasing_id()))
    norm = F.aggregate("point", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, dim, most = points.agg(F.count("*"), F.coalesce(F.max(F.size("point")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if not n:
        return None
    wanted = min(fan, math.ceil(n / block))
    # a hash filter leaves about four times as many before they are ranked; at most `fan` reach the driver
    place = F.pmod(F.xxhash64(F.lit(8), "uid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = points.where(place * F.lit(float(n)) < 4 * wanted + 64).orderBy(F.xxhash64(F.lit(8), "uid")).limit(wanted).select("point").collect()
    objects = np.unique(lifted(padded([r[0] for r in picked] or [[]], dim), most), axis=0)
    trees = build_subtrees(points, objects, most, dim, block)

    asked = points.where(F.col("vec_id") % every == 0).select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), "point")
    balls = trees.select("tree", "object", "radius")
    ball = written(balls.groupBy("object").agg(F.max("radius").alias("radius"), F.collect_list("tree").alias("trees")))  # at most `fan` rows

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest possible distance to each routing object's ball, nearest first."""
        for batch in batches:
            q = np.pad(padded(batch.column(2).to_pylist(), dim).astype(float), ((0, 0), (0, 1)))
            d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] - 2.0 * q @ objects.T + (objects**2).sum(axis=1)[None, :], 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.tolist(), pa.list_(pa.float64()))], names=["query", "query_id", "point", "away"])

    small_batches(points)
    away = asked.mapInArrow(reach, "query long, query_id long, point array<long>, away array<double>")
    least = away.select("query", "query_id", "point", F.posexplode("away").alias("object", "d")).join(F.broadcast(ball), "object")
    least = written(least.select("query", "query_id", "point", "object", "trees", F.greatest(F.col("d") - F.col("radius"), F.lit(0.0)).alias("least"), "d"))
    nearest = W.partitionBy("query").orderBy("least", "d", "object")
    ranked = least.withColumn("turn", F.row_number().over(nearest))
    now = ranked.where(F.col("turn") <= first).withColumn("tree", F.explode("trees"))
    found = search_subtrees(trees, now.select("tree", "query", "query_id", "point", F.lit(float("nan")).alias("floor")), k, dim, pack)
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    floors = found.where("uid >= 0").withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query").alias("_q"), F.col("score").alias("floor"))
    later = ranked.where(F.col("turn") > first).join(written(floors), F.col("query") == F.col("_q"), "left")
    # a vector of score s lies at sqrt(|q|^2 + M^2 - 2 s); the slack is that of the search
    norm = F.aggregate("point", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    limit = F.sqrt(F.greatest(norm + F.lit(most) - 2.0 * F.col("floor"), F.lit(0.0)) + 1e-6 * (norm + F.lit(most) + 1.0)) + 1e-6
    rest = later.where(F.col("floor").isNull() | (F.col("least") <= limit)).withColumn("tree", F.explode("trees"))
    more = search_subtrees(trees, rest.select("tree", "query", "query_id", "point", F.coalesce(F.col("floor").cast("double"), F.lit(float("nan"))).alias("floor")), k, dim, pack)
    return found.unionByName(more)


def exact_top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, **options) -> DataFrame:
    """query_id, rank, vec_id, score of vectors(vec_id, embedding); queries: vec_id divisible by `every`."""
    found = searches(vectors, k=k, every=every, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.where("uid >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
