"""Near-duplicate embeddings by product quantisation.

Unit vectors lie in coarse inverted lists (k-means centroids, each divided by a second, shared
set of fine centroids once lists would grow beyond `list_rows`) as residuals, cut into subspaces
and coded by one codeword each. A vector probes every list that may hold a vector within the
link distance d = sqrt(2 - 2 threshold): a vector of list c lies nearer to c than to this
vector's own centroid o, so this vector is at most d beyond the plane between them, which
gives |x - c|^2 - |x - o|^2 <= 2 d |c - o|; the same holds among the fine centroids of a coarse
list, with o the one nearest to x there. In a list, distances to coded vectors come from tables of
a member's residual against the codewords; a coded vector differs from its true one by
a stored error, so pairs whose table distance exceeds d by more than that error are ruled out
and none of the others. What is left is compared by exact cosine in double precision. Both
tests rule out only pairs below the threshold: recall is 1.

Vectors equal in every component and in label collapse to one first, known by two 64-bit hashes.
In the first round probing vectors travel as codes only, to lists whose members come with their
components; only vectors that the table distances leave with a partner come with theirs to a
second round, where the exact cosine decides.

Centroids and codewords are fitted on a bounded sample (`fit_rows`); every row is indexed.
Lists of one label are cut into blocks, and each pair of blocks is one task's group, which
returns link counts per vector and links that span its components, never its pairs.

Defined cases: rows whose vector is null, zero, or holds null or non-finite components, and rows
with a null label, link with nothing; labels of any type are compared as they are; shorter
vectors count as filled up with zeros; repeated rows are vectors of their own; a null vec_id
gives kept = true and counts as no id; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.mtree import usable
from voxelloom.llm.shared import connected_components, small_batches, written
from voxelloom.llm.simhash import spanning_labels

CODED = "uid long, label long, weight long, coarse int, fine int, role int, code binary, err double, vec binary"
GROUP = ["label", "coarse", "fine", "lo", "hi", "kind"]


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = squares(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = points[mine].mean(axis=0)
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (points**2).sum(axis=1)[:, None] - 2.0 * points @ centres.T + (centres**2).sum(axis=1)[None, :]


class Quantiser:
    """Lists are (coarse, fine): the centroid centres[coarse] + inner[fine]."""

    def __init__(self, sample: np.ndarray, coarse: int, fine: int = 1, parts: int = 8, words: int = 32):
        self.centres = k_means(sample, coarse, 8, 3)
        rest = sample - self.centres[squares(sample, self.centres).argmin(axis=1)]
        self.inner = k_means(rest, fine, 8, 5) if fine > 1 else np.zeros((1, sample.shape[1]))
        rest = rest - self.inner[squares(rest, self.inner).argmin(axis=1)]
        self.cuts = [c for c in np.array_split(np.arange(sample.shape[1]), parts) if len(c)]
        self.words = [k_means(rest[:, c], words, 6, 7) for c in self.cuts]
        self.between = np.sqrt(np.maximum(squares(self.centres, self.centres), 0.0))
        self.inside = np.sqrt(np.maximum(squares(self.inner, self.inner), 0.0))

    def centre(self, coarse: int, fine: int) -> np.ndarray:
        return self.centres[coarse] + self.inner[fine]

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector."""
        coarse = squares(unit, self.centres).argmin(axis=1)
        return coarse, squares(unit - self.centres[coarse], self.inner).argmin(axis=1)

    def probes(self, unit: np.ndarray, coarse: np.ndarray, fine: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, coarse, fine) of the lists after a vector's own that may hold a vector within reach."""
        d2 = squares(unit, self.centres)
        mine = d2[np.arange(len(unit)), coarse]
        near = d2 - mine[:, None] <= 2.0 * reach * self.between[coarse] + 1e-9
        near &= np.arange(len(self.centres))[None, :] >= coarse[:, None]  # each pair of lists once
        rows, lists = np.nonzero(near)
        out = []
        for lo in range(0, len(rows), 65_536):
            r, c = rows[lo : lo + 65_536], lists[lo : lo + 65_536]
            e2 = squares(unit[r] - self.centres[c], self.inner)
            least = e2.argmin(axis=1)
            close = e2 - e2[np.arange(len(r)), least][:, None] <= 2.0 * reach * self.inside[least] + 1e-9
            close &= (c > coarse[r])[:, None] | (np.arange(len(self.inner))[None, :] > fine[r][:, None])
            i, f = np.nonzero(close)
            out.append((r[i], c[i], f))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distances of the residuals to what the codes stand for."""
        codes = np.stack([squares(rest[:, c], w).argmin(axis=1) for c, w in zip(self.cuts, self.words, strict=True)], axis=1)
        error = sum(((rest[:, c] - w[codes[:, k]]) ** 2).sum(axis=1) for k, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)))
        return codes.astype(np.uint8), np.sqrt(error)

    def table_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rest), len(codes)))
        for k, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            table = ((rest[:, c][:, None, :] - w[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0.0))


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for at, v in enumerate(column):
        v = np.asarray(v, dtype=np.float64)
        out[at, : len(v)] = v
    return out


def _packed(raw: np.ndarray) -> list[bytes]:
    """Components in single precision where that is exact, else in double."""
    single = raw.astype("<f4")
    return [(s if e else d).tobytes() for s, d, e in zip(single, raw.astype("<f8"), (single == raw).all(axis=1), strict=True)]


def _unpacked(column: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in column], dtype=np.float64).reshape(len(column), dim)


def _sides(pdf: pd.DataFrame, lo: int, hi: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a group. kind 0: both of the list's own rows; 1: probing rows against own rows."""
    role, own = pdf["role"].to_numpy(), pdf["own"].to_numpy()
    return (np.flatnonzero(role == 1) if kind else np.flatnonzero(own == lo)), (np.flatnonzero(role == 0) if kind else np.flatnonzero(own == hi))


def count_links(vectors: DataFrame, *, threshold: float, fit_rows: int, list_rows: int, block: int, probing: int) -> DataFrame:
    """(uid, n, rep) rows: partial link counts, and a linked vector of each; of vectors(uid, label, weight, embedding).

    label is a long; uid is linked weight times to every vector that it is linked with.
    """
    rows, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "uid long, n long, rep long")
    small_batches(vectors)
    # each task would send its own smallest hashes: the filter leaves about four times fit_rows in all
    place = F.pmod(F.xxhash64(F.lit(9), "uid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = vectors.where(place * F.lit(float(rows)) < 4 * fit_rows)
    picked = near.select("embedding").orderBy(F.xxhash64(F.lit(9), "uid"), "uid").limit(fit_rows).toPandas()  # at most fit_rows
    sample = _stack(picked["embedding"], dim)
    lists = math.ceil(rows / list_rows)
    coarse = max(1, min(lists, fit_rows // 4))  # a centroid needs a few rows of the sample
    fine = max(1, min(math.ceil(lists / coarse), fit_rows // 4))
    quantiser = Quantiser(sample / np.linalg.norm(sample, axis=1, keepdims=True), coarse, fine)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                raw = _stack(part["embedding"], dim)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                c, f = quantiser.place(unit)
                q, pc, pf = quantiser.probes(unit, c, f, reach)
                n = np.concatenate([np.arange(len(c)), q])
                lists = np.concatenate([c, pc]), np.concatenate([f, pf])
                role = np.repeat([0, 1], [len(c), len(q)])
                # a probing vector is coded in the list that it probes, so that codes there are comparable
                codes, err = quantiser.encode(unit[n] - quantiser.centres[lists[0]] - quantiser.inner[lists[1]])
                yield pd.DataFrame({"uid": part["uid"].to_numpy()[n], "label": part["label"].to_numpy()[n], "weight": part["weight"].to_numpy()[n], "coarse": lists[0], "fine": lists[1], "role": role, "code": [v.tobytes() for v in codes], "err": err, "vec": _packed(raw) + [None] * len(q)})

    coded = written(vectors.select("uid", "label", "weight", "embedding").mapInPandas(encode, CODED))
    sizes = coded.groupBy("label", "coarse", "fine").agg(*[F.greatest(F.ceil(F.sum((F.col("role") == r).cast("long")) / most), F.lit(1)).cast("int").alias(f"n{r}") for r, most in ((0, block), (1, probing))])
    cut = coded.join(written(sizes), ["label", "coarse", "fine"]).withColumn("own", F.pmod(F.xxhash64(F.lit(6), "uid"), F.when(F.col("role") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    pair = lambda lo, hi, kind: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(kind).alias("kind"))
    inside = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda t: pair(F.least("own", t), F.greatest("own", t), 0))
    against = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda t: pair(t, F.col("own"), 1))
    asking = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda t: pair(F.col("own"), t, 1))
    groups = cut.withColumn("p", F.explode(F.when(F.col("role") == 0, F.concat(inside, against)).otherwise(asking)))
    groups = groups.select("uid", "label", "weight", "coarse", "fine", "role", "own", "code", "err", "vec", "p.lo", "p.hi", "p.kind")

    def rule_out(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows that table distances leave with a partner."""
        left, right = _sides(pdf, *key[3:])
        keep = np.zeros(len(pdf), bool)
        if len(left) and len(right):
            raw = _unpacked(pdf["vec"].iloc[right], dim)
            rest = raw / np.linalg.norm(raw, axis=1, keepdims=True) - quantiser.centre(key[1], key[2])
            codes, err = np.frombuffer(b"".join(pdf["code"]), dtype=np.uint8).reshape(len(pdf), -1), pdf["err"].to_numpy()
            for at in range(0, len(left), 1024):
                some = left[at : at + 1024]
                near = quantiser.table_distances(rest, codes[some]) <= reach + err[some][None, :] + 1e-9
                near &= right[:, None] != some[None, :]
                keep[some] |= near.any(axis=0)
                keep[right] |= near.any(axis=1)
        return pdf.loc[keep, [*GROUP, "uid", "weight", "role", "own"]]

    left = groups.groupBy(*GROUP).applyInPandas(rule_out, "label long, coarse int, fine int, lo int, hi int, kind int, uid long, weight long, role int, own int")
    left = written(left).join(vectors.select("uid", "embedding"), "uid")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, kind = key[3:]
        none = pd.DataFrame({"uid": [], "n": [], "rep": []}, dtype="int64")
        left, right = _sides(pdf, lo, hi, kind)
        if not len(left) or not len(right):
            return none
        raw, weight = _stack(pdf["embedding"], dim), pdf["weight"].to_numpy()
        norm = np.linalg.norm(raw, axis=1)
        near = (raw[left] / norm[left, None]) @ (raw[right] / norm[right, None]).T >= threshold - 1e-9
        a, b = np.nonzero(near)
        for at in range(0, len(a), 50_000):  # whatever a matrix product's order of summation
            i, j = left[a[at : at + 50_000]], right[b[at : at + 50_000]]
            linked = (np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold) & (i != j)
            near[a[at : at + 50_000], b[at : at + 50_000]] = linked
        if not near.any():
            return none
        rows, cols = spanning_labels(near)
        uid = pdf["uid"].to_numpy(np.int64)
        nodes = np.concatenate([uid[left], uid[right]])
        reps = nodes[np.concatenate([rows, cols])]
        same = kind == 0 and lo == hi  # then both sides hold the same vectors: count one of them
        n = np.concatenate([near @ weight[right], np.zeros(len(right), int) if same else weight[left] @ near])
        keep = (n > 0) | (nodes != reps)
        return pd.DataFrame({"uid": nodes[keep], "n": n[keep], "rep": reps[keep]})

    return left.groupBy(*GROUP).applyInPandas(compare, "uid long, n long, rep long")


def embedding_dedup(vectors: DataFrame, *, threshold: float = 0.98, fit_rows: int = 8192, list_rows: int = 1024, block: int = 1024, probing: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    doubles = F.col("embedding").cast("array<double>")
    marked = vectors.select(F.col("vec_id").cast("long"), F.col("label").alias("_label"), doubles.alias("embedding"))
    takes = F.coalesce(usable() & F.exists("embedding", lambda x: x != 0) & F.col("_label").isNotNull(), F.lit(False))
    # equal labels give equal numbers, and unequal ones would need 2^32 labels to meet
    kind = F.when(takes, F.xxhash64(F.lit(1), "_label"))
    rows = written(marked.select("vec_id", kind.alias("label"), F.when(takes, F.col("embedding")).alias("embedding"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")).withColumn("row", F.monotonically_increasing_id()))
    taking = rows.where("label is not null")
    copy = ["label", "k1", "k2"]
    copies = written(taking.groupBy(*copy).agg(F.min("row").alias("uid"), F.count("*").alias("weight"), F.min("vec_id").alias("first")))
    single = written(taking.select("row", "label", "embedding").join(copies.select(F.col("uid").alias("row"), "uid", "weight"), "row").drop("row"))
    found = written(count_links(single, threshold=threshold, fit_rows=fit_rows, list_rows=list_rows, block=block, probing=probing))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select(F.col("uid").alias("src"), F.col("rep").alias("dst")))
    member = written(copies.join(groups, copies.uid == groups.node, "left").select(*copy, "uid", "weight", "first", F.coalesce("component", "uid").alias("component")))
    heads = written(member.groupBy("component").agg(F.min("first").alias("head")))
    known = written(member.join(heads, "component").join(counts, "uid", "left").select(*copy, "head", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    out = rows.select("vec_id", *copy).join(known, copy, "left")
    component = F.coalesce("head", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
