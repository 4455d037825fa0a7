"""Exact quantiles of groups too large for one task.

`percentile` keeps every distinct value of a group in one task. Here a group's values are counted
in bins; the bin that holds a wanted rank is cut again, until few values are left in it. What
meets in one place is a histogram, or at most `few` values per wanted rank.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.columns import dbl


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float], few: int = 200_000, bins: int = 4096) -> dict:
    """{key: [linear-interpolated quantile of each prob]}; keys are few (channels). NaN for a key without values."""
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("abs(v) < double('infinity')")
    state = {r.k: r for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    wanted = {(k, rank): (r.lo, r.hi, rank, r.n) for k, r in state.items() for p in probs for rank in {math.floor(p * (r.n - 1)), math.ceil(p * (r.n - 1))}}
    found: dict = {}
    while wanted:
        # (lo, hi) closed ranges of each key, deduplicated; rank is counted inside its range
        ranges = sorted({(k, lo, hi) for (k, _), (lo, hi, _, _) in wanted.items()}, key=str)
        hit = None
        for at, (k, lo, hi) in enumerate(ranges):
            c = F.when(F.col("k").eqNullSafe(F.lit(k)) & F.col("v").between(dbl(lo), dbl(hi)), F.lit(at))
            hit = F.array(c) if hit is None else F.concat(hit, F.array(c))
        inside = rows.select("v", F.explode(F.filter(hit, lambda a: a.isNotNull())).alias("a"))
        small = {at for at, (k, lo, hi) in enumerate(ranges) if all(n <= few for (kk, _), (a, b, _, n) in wanted.items() if (kk, a, b) == (k, lo, hi))}
        nxt: dict = {}
        if small:
            got = inside.where(F.col("a").isin(*small)).groupBy("a").agg(F.array_sort(F.collect_list("v")).alias("s"))
            ranks = {at: sorted({rank for (kk, _), (a, b, rank, _) in wanted.items() if (kk, a, b) == ranges[at]}) for at in small}
            pick = F.create_map(*[x for at, rr in ranks.items() for x in (F.lit(at), F.array(*[F.lit(r) for r in rr]))])
            for r in got.select("a", F.transform(F.element_at(pick, F.col("a")), lambda i: F.get("s", i)).alias("q")).collect():
                for rank, q in zip(ranks[r.a], r.q, strict=True):
                    for (kk, whole), (a, b, inner, _) in wanted.items():
                        if (kk, a, b) == ranges[r.a] and inner == rank:
                            found[kk, whole] = q
        large = [at for at in range(len(ranges)) if at not in small]
        if large:
            los = F.create_map(*[x for at in large for x in (F.lit(at), F.array(dbl(ranges[at][1]), dbl(ranges[at][2])))])
            ends = F.element_at(los, F.col("a"))
            width = ends[1] - ends[0]
            number = F.when(width > 0, F.least(F.floor((F.col("v") - ends[0]) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
            hist: dict = {}
            for r in inside.where(F.col("a").isin(*large)).groupBy("a", number.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("a", "b").collect():
                hist.setdefault(r.a, []).append(r)
            for (k, whole), (lo, hi, rank, _) in wanted.items():
                if (at := ranges.index((k, lo, hi))) in hist:
                    left = rank
                    for r in hist[at]:
                        if left < r.n:
                            if r.lo == r.hi:
                                found[k, whole] = r.lo
                            else:
                                nxt[k, whole] = (r.lo, r.hi, left, r.n)
                            break
                        left -= r.n
        wanted = nxt
    out = {}
    for k, r in state.items():
        out[k] = []
        for p in probs:
            at = p * (r.n - 1)
            a, b = found[k, math.floor(at)], found[k, math.ceil(at)]
            out[k].append(a + (b - a) * (at - math.floor(at)))
    return out
