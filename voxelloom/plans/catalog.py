"""The engine's queries over the stand-in tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelloom.functions import columns as C
from voxelloom.functions.columns import dbl, rounded
from voxelloom.functions.ranks import ranked
from voxelloom.operators import masks, normalize, patches, resample, volumes
from voxelloom.plans import pipeline, planner
from voxelloom.plans.quantiles import exact_quantiles
from voxelloom.session import ship

SHAPE = (4, 4, 4)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOX = "vox AS (SELECT case_id, CAST(p // 16 AS INT) AS z, CAST(p // 4 % 4 AS INT) AS y, CAST(p % 4 AS INT) AS x, v FROM (SELECT vec_id AS case_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS p FROM embeddings))"
NAMES = "names AS (SELECT printf('case_%04d_%04d.nii.gz', conv_id, turn) AS name FROM conversations)"
SPACING = "sp AS (SELECT vec_id AS case_id, CAST(1 + vec_id % 5 AS DOUBLE) AS s FROM embeddings)"
R = "round({0}, 6) + 0.0::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """case_id, data, spacing: the embeddings as volumes of 4 x 4 x 4."""
    e = table(spark, d, "embeddings")
    spacing = F.array((F.lit(1) + F.col("vec_id") % 5).cast("double"), dbl(1), dbl(1))
    return e.select(F.col("vec_id").alias("case_id"), F.transform("embedding", lambda v: v.cast("double")).alias("data"), spacing.alias("spacing"))


def vox(spark: SparkSession, d: str) -> DataFrame:
    return volumes.voxels(cases(spark, d))


def as_voxels(df: DataFrame, shape=SHAPE) -> DataFrame:
    return volumes.voxels(df, shape=shape).withColumn("v", rounded(F.col("v")))


def changed(spark: SparkSession, d: str, f, shape=SHAPE) -> DataFrame:
    return as_voxels(cases(spark, d).select("case_id", f(F.col("data")).alias("data")), shape)


def labelled(c):
    return F.when(c > dbl(0.2), 2).when(c > dbl(0.1), 1).otherwise(0)


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v')} AS v FROM vox")
def voxel_explode(spark, d):
    return as_voxels(cases(spark, d))


Z = "(v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-8::DOUBLE)"


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format(Z)} AS v FROM vox WINDOW w AS (PARTITION BY case_id)")
def norm_zscore(spark, d):
    return changed(spark, d, normalize.zscore)


@query(f"""WITH {VOX}, s AS (SELECT case_id, avg(v) FILTER (abs(v) >= 0.05::DOUBLE) AS m, stddev_pop(v) FILTER (abs(v) >= 0.05::DOUBLE) AS sd FROM vox GROUP BY 1)
SELECT case_id, z, y, x, {R.format("CASE WHEN abs(v) >= 0.05::DOUBLE OR m IS NULL THEN (v - m) / greatest(sd, 1e-8::DOUBLE) ELSE v END")} AS v FROM vox JOIN s USING (case_id)""")
def norm_zscore_masked(spark, d):
    return changed(spark, d, lambda a: normalize.zscore_masked(a, F.transform(a, lambda v: F.abs(v) >= dbl(0.05))))


def intensity_stats(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Exact pooled statistics of a group, merged from partial aggregates."""
    p = F.percentile(v, F.array(dbl(0.005), dbl(0.5), dbl(0.995)))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), p.alias("p"))
    names = {"mean": F.col("mean"), "median": F.col("p")[1], "std": F.col("std"), "min": F.col("lo"), "max": F.col("hi"), "percentile_00_5": F.col("p")[0], "percentile_99_5": F.col("p")[2]}
    return out.select(*keys, "n", *[rounded(c).alias(k) for k, c in names.items()])


def stats_sql(keys: str, source: str) -> str:
    k = f"{keys}, " if keys else ""
    cols = {"mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "percentile_00_5": "quantile_cont(v, 0.005)", "percentile_99_5": "quantile_cont(v, 0.995)"}
    return f"SELECT {k}count(v) AS n, {', '.join(f'{R.format(c)} AS {n}' for n, c in cols.items())} FROM {source}" + (f" GROUP BY {keys}" if keys else "")


@query(f"""WITH {VOX}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM vox)
SELECT case_id, z, y, x, {R.format("(greatest(least(v, hi), lo) - m) / greatest(sd, 1e-8::DOUBLE)")} AS v FROM vox, s""")
def norm_ct(spark, d):
    values = cases(spark, d).select(F.lit(0).alias("pool"), F.explode("data").alias("v"))
    s = values.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).first()  # one row
    lo, hi = exact_quantiles(values, "pool", "v", [0.005, 0.995]).get(0, (0.0, 0.0))
    stats = F.struct(*[dbl(v or 0).alias(k) for k, v in (("mean", s["mean"]), ("std", s["std"]), ("lo", lo), ("hi", hi))])
    return changed(spark, d, lambda a: normalize.ct(a, stats))


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('(greatest(least(v, 0.2::DOUBLE), -0.2::DOUBLE) + 0.2::DOUBLE) / 0.4::DOUBLE')} AS v FROM vox")
def norm_minmax(spark, d):
    return changed(spark, d, lambda a: normalize.min_max(a, -0.2, 0.2))


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('(v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-8::DOUBLE)')} AS v FROM vox WINDOW w AS (PARTITION BY case_id)")
def norm_rescale01(spark, d):
    return changed(spark, d, normalize.rescale_01)


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v / 255.0::DOUBLE')} AS v FROM vox")
def norm_rgb01(spark, d):
    return changed(spark, d, normalize.rgb_01)


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v')} AS v FROM vox")
def norm_none(spark, d):
    return changed(spark, d, normalize.unchanged)


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v * 2.0::DOUBLE + 10.0::DOUBLE')} AS v FROM vox")
def norm_inverse_ct(spark, d):
    return changed(spark, d, lambda a: normalize.inverse_standard(a, F.struct(dbl(10).alias("mean"), dbl(2).alias("std"))))


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v * 0.4::DOUBLE - 0.2::DOUBLE')} AS v FROM vox")
def norm_inverse_minmax(spark, d):
    return changed(spark, d, lambda a: normalize.inverse_min_max(a, -0.2, 0.2))


def pooled_stats(df: DataFrame, key: str) -> DataFrame:
    """intensity_stats of groups that are few and large: their quantiles come from bounded histograms."""
    q = exact_quantiles(df, key, "v", [0.005, 0.5, 0.995])
    side = df.sparkSession.createDataFrame([(k, *v) for k, v in q.items()], f"_k {dict(df.dtypes)[key]}, p0 double, p1 double, p2 double")
    out = df.groupBy(key).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = out.join(side, F.col(key).eqNullSafe(F.col("_k")), "left")
    names = {"mean": "mean", "median": "p1", "std": "std", "min": "lo", "max": "hi", "percentile_00_5": "p0", "percentile_99_5": "p2"}
    return out.select(key, "n", *[rounded(F.col(c)).alias(k) for k, c in names.items()])


@query(f"WITH {VOX} {stats_sql('', 'vox')}")
def fingerprint_stats(spark, d):
    values = cases(spark, d).select(F.lit(0).alias("pool"), F.explode("data").alias("v"))
    return pooled_stats(values, "pool").drop("pool")


@query(stats_sql("channel", "(SELECT l_returnflag AS channel, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)"))
def fingerprint_lineitem(spark, d):
    return pooled_stats(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_quantity").cast("double").alias("v")), "channel")


@query(f"WITH {VOX} {stats_sql('case_id', '(SELECT * FROM vox WHERE v > 0.1::DOUBLE)')}")
def foreground_stats(spark, d):
    return intensity_stats(vox(spark, d).where(F.col("v") > dbl(0.1)), ["case_id"])


@query(f"""WITH {VOX}, f AS (SELECT *, v > 0.3::DOUBLE AS m, bool_or(v > 0.3::DOUBLE) OVER (PARTITION BY case_id) AS has FROM vox)
{stats_sql('case_id', '(SELECT * FROM f WHERE m OR NOT has)')}""")
def nonzero_stats_fallback(spark, d):
    inside = F.filter("data", lambda v: v > dbl(0.3))  # an empty mask stands for all voxels
    kept = cases(spark, d).select("case_id", F.explode(F.when(F.size(inside) > 0, inside).otherwise(F.col("data"))).alias("v"))
    return intensity_stats(kept, ["case_id"])


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, z, y, x) AS r FROM vox) WHERE r <= 5")
def intensity_top_k(spark, d):
    order = W.partitionBy("case_id").orderBy(F.desc("v"), "z", "y", "x")
    return vox(spark, d).withColumn("r", F.row_number().over(order)).where("r <= 5").select("case_id", "z", "y", "x", rounded(F.col("v")).alias("v"))


@query(f"WITH {SPACING} SELECT {R.format('quantile_cont(s, 0.5)')} AS z, 1.0::DOUBLE AS y, 1.0::DOUBLE AS x FROM sp")
def median_spacing(spark, d):
    return cases(spark, d).agg(*[rounded(F.percentile(F.col("spacing")[k], dbl(0.5))).alias(n) for k, n in enumerate("zyx")])


@query(f"WITH {SPACING} SELECT {R.format('CASE WHEN m > 3 AND 4 * 3 < 4 THEN greatest(p, 1.00001::DOUBLE) ELSE m END')} AS z, 1.0::DOUBLE AS y, 1.0::DOUBLE AS x FROM (SELECT quantile_cont(s, 0.5) AS m, quantile_cont(s, 0.1) AS p FROM sp)")
def target_spacing(spark, d):
    from voxelloom.plans import planner

    q = cases(spark, d).agg(*[F.percentile(F.col("spacing")[k], F.array(dbl(0.5), dbl(0.1))).alias(n) for k, n in enumerate("zyx")]).first()
    out = planner.target_spacing([c[0] for c in q], list(SHAPE), [c[1] for c in q])
    return spark.createDataFrame([tuple(float(round(v, 6)) for v in out)], "z double, y double, x double")


NEW = "CAST(round_even(s / 2.0::DOUBLE * 4, 0) AS INT)"


@query(f"WITH {SPACING} SELECT case_id, {NEW} AS z, 4 AS y, 4 AS x FROM sp")
def new_shape(spark, d):
    shape = C.new_shape(F.array(*map(F.lit, SHAPE)), F.col("spacing"), F.array(dbl(2), dbl(1), dbl(1)))
    return cases(spark, d).select("case_id", shape.alias("s")).select("case_id", *[F.col("s")[k].alias(n) for k, n in enumerate("zyx")])


@query(f"WITH {SPACING} SELECT quantile_cont({NEW}::DOUBLE, 0.5) AS z, 4.0::DOUBLE AS y, 4.0::DOUBLE AS x FROM sp")
def median_shape(spark, d):
    return new_shape(spark, d).agg(*[F.percentile(n, dbl(0.5)).alias(n) for n in "zyx"])


@query(f"WITH {SPACING} SELECT case_id, s > 3 AS anisotropic, CASE WHEN s > 3 THEN 0 END AS axis FROM sp")
def sep_z_decision(spark, d):
    s = F.col("spacing")
    return cases(spark, d).select("case_id", C.anisotropic(s).alias("anisotropic"), C.separate_axis(s, F.array(dbl(1), dbl(1), dbl(1))).alias("axis"))


@query(f"WITH {SPACING} SELECT case_id, CASE WHEN s > 1 THEN '0' ELSE '0x1x2' END AS axes FROM sp")
def lowres_axis(spark, d):
    return cases(spark, d).select("case_id", C.patch_key(C.lowres_axes(F.col("spacing"))).alias("axes"))


@query(f"WITH {SPACING} SELECT case_id, CASE WHEN s >= 3 THEN '0x1x2' ELSE '1x0x2' END AS axes FROM sp")
def transpose_axes(spark, d):
    """Spacing given as (3, s, 1): the coarsest axis first."""
    s = F.array(F.col("spacing")[0], dbl(3), dbl(1))
    return cases(spark, d).select("case_id", C.patch_key(C.transpose_forward(s)).alias("axes"))


@query(f"WITH {VOX} SELECT case_id, x AS z, z AS y, y AS x, {R.format('v')} AS v FROM vox")
def transpose(spark, d):
    return changed(spark, d, lambda a: volumes.transposed(a, SHAPE, (2, 0, 1)))


def weights_sql(n_in: int, n_out: int, order: int) -> str:
    rows = [(o, i, w) for o, cells in enumerate(resample.taps(n_in, n_out, order)) for i, w in cells]
    return f"(VALUES {', '.join(f'({o}, {i}, {w!r}::DOUBLE)' for o, i, w in rows)}) AS t(o, i, w)"


def resample_sql(source: str, shape, target, order: int) -> str:
    sql = source
    for axis, n_in, n_out in zip("zyx", shape, target, strict=True):
        if n_in != n_out:
            others = [a for a in "zyx" if a != axis]
            sql = f"(SELECT case_id, {', '.join(others)}, CAST(o AS INT) AS {axis}, sum(v * w) AS v FROM {sql} AS q JOIN {weights_sql(n_in, n_out, order)} ON i = {axis} GROUP BY case_id, {', '.join(others)}, o)"
    return sql


UP = (6, 5, 4)


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v')} AS v FROM {resample_sql('vox', SHAPE, (6, 3, 8), 0)}")
def resample_nearest(spark, d):
    return changed(spark, d, lambda a: resample.resample(a, SHAPE, (6, 3, 8), 0), (6, 3, 8))


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v')} AS v FROM {resample_sql('vox', SHAPE, UP, 1)}")
def resample_linear(spark, d):
    return changed(spark, d, lambda a: resample.resample(a, SHAPE, UP, 1), UP)


LAB = "CASE WHEN v > 0.2::DOUBLE THEN 2 WHEN v > 0.1::DOUBLE THEN 1 ELSE 0 END"


def _one(label: int) -> str:
    return resample_sql(f"(SELECT case_id, z, y, x, CAST(({LAB} = {label}) AS INT)::DOUBLE AS v FROM vox)", SHAPE, UP, 1)


@query(f"""WITH {VOX} SELECT a.case_id, a.z, a.y, a.x, CASE WHEN b.v >= 0.5::DOUBLE THEN 2 WHEN a.v >= 0.5::DOUBLE THEN 1 ELSE 0 END AS label
FROM {_one(1)} a JOIN {_one(2)} b USING (case_id, z, y, x)""")
def resample_label(spark, d):
    labels = F.transform("data", labelled)
    return volumes.voxels(cases(spark, d).select("case_id", resample.resample_labels(labels, SHAPE, UP, [1, 2]).alias("data")), shape=UP, value="label")


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v')} AS v FROM {resample_sql(resample_sql('vox', SHAPE, (4, 6, 6), 1), (4, 6, 6), (7, 6, 6), 0)}")
def resample_sepz(spark, d):
    """In plane first, linearly; then along the coarse axis, by nearest."""
    return changed(spark, d, lambda a: resample.resample(resample.resample(a, SHAPE, (4, 6, 6), 1), (4, 6, 6), (7, 6, 6), 0), (7, 6, 6))


@query(f"WITH {VOX}, r AS (SELECT case_id, z AS y, y AS x, x AS z, v FROM {resample_sql('vox', SHAPE, UP, 1)}) SELECT case_id, y AS z, x AS y, z AS x, {R.format('v')} AS v FROM {resample_sql('r', (4, 6, 5), (4, 4, 4), 1)}")
def undo_preprocessing(spark, d):
    """Linear up, transposed; then back to the old grid and the old axes."""
    def there_and_back(a):
        up = volumes.transposed(resample.resample(a, SHAPE, UP, 1), UP, (2, 0, 1))
        return volumes.transposed(resample.resample(up, (4, 6, 5), (4, 4, 4), 1), (4, 4, 4), (1, 2, 0))

    return changed(spark, d, there_and_back)


def _weights(name: str, axis: int) -> str:
    """The weight matrix of one axis as a table (o, i, w)."""
    m = resample.cubic_matrix(SHAPE[axis], UP[axis]) if SHAPE[axis] != UP[axis] else np.eye(SHAPE[axis])
    cells = ", ".join(f"({o}, {i}, {float(w)!r}::DOUBLE)" for o, row in enumerate(m) for i, w in enumerate(row))
    return f"{name} AS (SELECT * FROM (VALUES {cells}) t(o, i, w))"


@query(f"""WITH {VOX}, {_weights('wz', 0)}, {_weights('wy', 1)}, {_weights('wx', 2)},
az AS (SELECT case_id, wz.o AS z, y, x, sum(w * v) AS v FROM vox JOIN wz ON z = i GROUP BY 1, 2, 3, 4),
ay AS (SELECT case_id, z, wy.o AS y, x, sum(w * v) AS v FROM az JOIN wy ON y = i GROUP BY 1, 2, 3, 4),
ax AS (SELECT case_id, z, y, wx.o AS x, sum(w * v) AS v FROM ay JOIN wx ON x = i GROUP BY 1, 2, 3, 4),
lim AS (SELECT case_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1)
SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {R.format('greatest(least(v, hi), lo)')} AS v FROM ax JOIN lim USING (case_id)""")
def resample_cubic(spark, d):
    return as_voxels(resample.resample_cubic(cases(spark, d), SHAPE, UP), UP)


def names(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.format_string("case_%04d_%04d.nii.gz", "conv_id", "turn").alias("name"))


STRIP = "regexp_replace(name, '\\.(nii\\.gz|nii|nrrd|mha|gipl|tiff|tif|png|bmp)$', '', 'i')"


@query(f"WITH {NAMES} SELECT name, {STRIP} AS stem FROM names")
def scan_strip_suffix(spark, d):
    return names(spark, d).select("name", C.strip_suffix(F.col("name")).alias("stem"))


@query(f"WITH {NAMES} SELECT name, '.nii.gz' AS ending, 'sitk' AS reader FROM names")
def scan_ending(spark, d):
    from voxelloom.sources.scan import reader_of

    return names(spark, d).select("name", C.file_ending(F.col("name")).alias("ending")).withColumn("reader", reader_of(F.col("ending")))


CH = f"ch AS (SELECT DISTINCT regexp_extract({STRIP}, '^(.+_\\d{{4}})_(\\d{{4}})$', 1) AS case_id, CAST(regexp_extract({STRIP}, '^(.+_\\d{{4}})_(\\d{{4}})$', 2) AS INT) AS channel FROM names)"


@query(f"WITH {NAMES}, {CH} SELECT case_id, string_agg(CAST(channel AS VARCHAR), ',' ORDER BY channel) AS channels FROM ch GROUP BY 1")
def scan_multi(spark, d):
    """A name without a channel number is a case of its own, its channels null."""
    from voxelloom.sources.scan import channels

    ch = channels(names(spark, d)).select("case_id", "channel").distinct()
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("channel")), lambda c: c.cast("string")), ",")
    return ch.groupBy("case_id", F.isnull("channel").alias("_none")).agg(F.nullif(listed, F.lit("")).alias("channels")).drop("_none")


@query(f"WITH {NAMES}, {CH} SELECT case_id, count(*) AS n FROM ch WHERE NOT (channel = 1 AND case_id LIKE '%0') GROUP BY 1 HAVING NOT (min(channel) = 0 AND max(channel) = count(*) - 1)")
def scan_contiguity_errors(spark, d):
    from voxelloom.sources.scan import contiguity_errors

    holes = names(spark, d).distinct().where(r"not (name rlike r'_\d{3}0_0001\.nii\.gz$')")  # channel 1 of a case; a longer number has no channel
    return contiguity_errors(holes, "name").select("case_id", "n")


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
def id_match(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'no label' ELSE 'no document' END AS problem FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def id_mismatch(spark, d):
    from voxelloom.sources.scan import mismatches

    return mismatches(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id", "no document", "no label")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages)
SELECT a.doc_id AS id_a, b.page_id AS id_b FROM a JOIN b ON a.i % (SELECT count(*) FROM b) = b.i""")
def pair_modulo(spark, d):
    """The longer domain meets the shorter one by rank modulo its size; ids only, narrow tables."""
    a, b = ranked(table(spark, d, "documents").select("doc_id"), ["doc_id"], "i"), ranked(table(spark, d, "pages").select("page_id"), ["page_id"], "j")
    n = b.count()
    return a.join(b, F.col("i") % max(n, 1) == F.col("j")).select(F.col("doc_id").alias("id_a"), F.col("page_id").alias("id_b"))


@query(f"WITH {VOX} SELECT case_id, z, y, x, CAST(round_even(greatest(least(v * 4, 1), 0) * 255, 0) AS SMALLINT) AS q FROM vox")
def conflict_quantize(spark, d):
    return vox(spark, d).select("case_id", "z", "y", "x", F.rint(F.greatest(F.least(F.col("v") * 4, dbl(1)), dbl(0)) * 255).cast("short").alias("q"))


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('round_even(greatest(least(v * 4, 1), 0) * 255, 0) / 255.0::DOUBLE')} AS v FROM vox")
def conflict_dequantize(spark, d):
    return conflict_quantize(spark, d).select("case_id", "z", "y", "x", rounded(F.col("q") / dbl(255)).alias("v"))


@query("SELECT d.doc_id AS case_id, l.quality AS conflict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def conflict_left_join(spark, d):
    """Cases keep their place where the side table has a gap."""
    side = table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("conflict"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_id")).join(side, "case_id", "left")


def set_voxels(spark, d, cut: float = 0.1) -> DataFrame:
    return vox(spark, d).where(F.col("v") > dbl(cut)).select("case_id", "z", "y", "x")


@query(f"WITH {VOX} SELECT case_id, z, y, x, v > 0.1::DOUBLE AS m FROM vox")
def mask_threshold(spark, d):
    return vox(spark, d).select("case_id", "z", "y", "x", (F.col("v") > dbl(0.1)).alias("m"))


@query(f"WITH {VOX} SELECT case_id, z, y, x, abs(v) >= 0.05::DOUBLE AS m FROM vox")
def mask_nonzero(spark, d):
    return vox(spark, d).select("case_id", "z", "y", "x", (F.when(F.abs("v") < dbl(0.05), dbl(0)).otherwise(F.col("v")) != 0).alias("m"))


@query(f"WITH {VOX} SELECT case_id, z, y, x FROM vox WHERE v > 0.2::DOUBLE UNION SELECT case_id, z, y, x FROM vox WHERE v < -0.2::DOUBLE")
def mask_union(spark, d):
    v = vox(spark, d)
    return v.where(F.col("v") > dbl(0.2)).unionByName(v.where(F.col("v") < dbl(-0.2))).select("case_id", "z", "y", "x").distinct()


CROSS = "st AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dz, dy, dx))"
DIL = "dil AS (SELECT DISTINCT case_id, z + dz AS z, y + dy AS y, x + dx AS x FROM vox, st WHERE v > 0.1::DOUBLE AND z + dz BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 3 AND x + dx BETWEEN 0 AND 3)"


@query(f"WITH {VOX}, {CROSS}, {DIL} SELECT * FROM dil")
def mask_dilate(spark, d):
    return volumes.dilate(set_voxels(spark, d), SHAPE)


@query(f"WITH {VOX}, {CROSS} SELECT case_id, z - dz AS z, y - dy AS y, x - dx AS x FROM vox, st WHERE v > -0.1::DOUBLE GROUP BY 1, 2, 3, 4 HAVING count(*) = 7")
def mask_erode(spark, d):
    return volumes.erode(set_voxels(spark, d, -0.1))


@query(f"WITH {VOX}, {CROSS}, {DIL} SELECT case_id, z - dz AS z, y - dy AS y, x - dx AS x FROM dil, st GROUP BY 1, 2, 3, 4 HAVING count(*) = 7")
def mask_close(spark, d):
    return volumes.close(set_voxels(spark, d), SHAPE)


def mask_rows(spark, d, kernel) -> DataFrame:
    m = cases(spark, d).select("case_id", F.transform("data", lambda v: v > dbl(0.05)).alias("mask"))
    return volumes.voxels(masks.over_volumes(m, SHAPE, kernel), data="mask", value="m").where("m")


NEAR = "b.case_id = o.case_id AND b.z = o.z + st.dz AND b.y = o.y + st.dy AND b.x = o.x + st.dx"
RAW = "raw AS (SELECT case_id, z, y, x FROM vox WHERE v > 0.05::DOUBLE)"


def _filled(source: str, out: str) -> str:
    """CTEs: all voxels but the background that reaches the border."""
    return f"""{out}_bg AS (SELECT case_id, z, y, x FROM vox EXCEPT SELECT * FROM {source}),
{out}_open AS (SELECT * FROM {out}_bg WHERE z IN (0, 3) OR y IN (0, 3) OR x IN (0, 3) UNION SELECT b.* FROM {out}_open o, st, {out}_bg b WHERE {NEAR}),
{out} AS (SELECT case_id, z, y, x FROM vox EXCEPT SELECT * FROM {out}_open)"""


def _largest(source: str, out: str) -> str:
    """CTEs: the largest component, the one of the first voxel where sizes tie."""
    return f"""{out}_reach AS (SELECT case_id, z * 16 + y * 4 + x AS root, z, y, x FROM {source} UNION SELECT o.case_id, o.root, b.z, b.y, b.x FROM {out}_reach o, st, {source} b WHERE {NEAR}),
{out}_label AS (SELECT case_id, z, y, x, min(root) AS root FROM {out}_reach GROUP BY 1, 2, 3, 4),
{out}_best AS (SELECT case_id, root FROM (SELECT case_id, root, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, root) AS r FROM {out}_label GROUP BY 1, 2) WHERE r = 1),
{out} AS (SELECT case_id, z, y, x FROM {out}_label JOIN {out}_best USING (case_id, root))"""


@query(f"WITH RECURSIVE {VOX}, {CROSS}, {RAW}, {_filled('raw', 'done')} SELECT *, true AS m FROM done")
def mask_fill_holes(spark, d):
    return mask_rows(spark, d, masks.fill_holes)


@query(f"WITH RECURSIVE {VOX}, {CROSS}, {RAW}, {_largest('raw', 'done')} SELECT *, true AS m FROM done")
def mask_largest_component(spark, d):
    return mask_rows(spark, d, masks.largest)


@query(f"""WITH RECURSIVE {VOX}, {CROSS}, {RAW}, {_filled('raw', 'full_')},
grown AS (SELECT DISTINCT case_id, z + dz AS z, y + dy AS y, x + dx AS x FROM full_, st WHERE z + dz BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 3 AND x + dx BETWEEN 0 AND 3),
closed AS (SELECT case_id, z - dz AS z, y - dy AS y, x - dx AS x FROM grown, st GROUP BY 1, 2, 3, 4 HAVING count(*) = 7),
{_largest('closed', 'one')}, {_filled('one', 'done')} SELECT *, true AS m FROM done""")
def mask_postprocess(spark, d):
    return mask_rows(spark, d, masks.postprocess)


@query("""WITH s AS (SELECT DISTINCT CAST(l_linenumber + 6 AS INT) AS n FROM lineitem), g AS (SELECT n, unnest(range(0, greatest(n - 4, 0) + 1, 2)) AS a FROM s)
SELECT n, CAST(a AS INT) AS start FROM g UNION SELECT n, greatest(n - 4, 0) FROM s""")
def sliding_starts(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_linenumber") + 6).cast("int").alias("n")).distinct()
    return n.select("n", F.explode(C.sliding_starts(F.col("n"), F.lit(4), 0.5)).alias("start"))


GRID = "SELECT CAST(row_number() OVER (ORDER BY a.s, b.s, c.s) - 1 AS INT) AS patch, a.s AS sz, b.s AS sy, c.s AS sx FROM (VALUES (0), (1), (2)) a(s), (VALUES (0), (1), (2)) b(s), (VALUES (0), (1), (2)) c(s)"


def grid(df: DataFrame, shape=SHAPE, patch=(2, 2, 2), overlap=0.5) -> DataFrame:
    """df with one row per patch of its grid, in row-major order."""
    import itertools

    axes = [[0] if n <= p else sorted({*range(0, n - p + 1, max(1, round(p * (1 - overlap)))), n - p}) for n, p in zip(shape, patch, strict=True)]
    starts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("sz", "sy", "sx"), s, strict=True)]) for s in itertools.product(*axes)])
    return df.select("*", F.posexplode(starts).alias("patch", "_s")).select(*df.columns, "patch", "_s.sz", "_s.sy", "_s.sx")


@query(f"WITH g AS ({GRID}) SELECT vec_id AS case_id, patch, sz, sy, sx FROM embeddings, g")
def patch_grid(spark, d):
    return grid(cases(spark, d).select("case_id"))


def patch_voxels(spark, d) -> DataFrame:
    """Voxels of each patch, cut out of the volume's own array: no join."""
    index = F.expr("(z * 4 + y) * 4 + x + 1")
    p = grid(cases(spark, d).select("case_id", "data"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    p = p.withColumn("o", F.explode(steps)).selectExpr("case_id", "patch", "data", "sz + o.a as z", "sy + o.b as y", "sx + o.c as x")
    return p.select("case_id", "patch", "z", "y", "x", F.element_at("data", index.cast("int")).alias("v"))


INBOX = "z BETWEEN sz AND sz + 1 AND y BETWEEN sy AND sy + 1 AND x BETWEEN sx AND sx + 1"


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, patch, z, y, x, {R.format('v')} AS v FROM vox JOIN g ON {INBOX}")
def patch_crop(spark, d):
    return patch_voxels(spark, d).withColumn("v", rounded(F.col("v")))


@query(f"WITH {VOX}, g AS (SELECT a.i AS z, b.i AS y, c.i AS x FROM range(7) a(i), range(6) b(i), range(4) c(i)) SELECT e.vec_id AS case_id, CAST(g.z AS INT) AS z, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, {R.format('coalesce(v, 0.0::DOUBLE)')} AS v FROM embeddings e CROSS JOIN g LEFT JOIN vox ON vox.case_id = e.vec_id AND vox.z = g.z - 1 AND vox.y = g.y - 1 AND vox.x = g.x")
def patch_pad(spark, d):
    """Centred zero padding to (7, 6, 4): before = missing div 2."""
    cell = lambda i: (F.floor(i / 24) - 1, F.floor(i / 4) % 6 - 1, i % 4)

    def value(a):
        def at(i):
            z, y, x = cell(i)
            inside = z.between(0, 3) & y.between(0, 3)
            return F.when(inside, F.get(a, ((z * 4 + y) * 4 + x).cast("int"))).otherwise(dbl(0))

        return F.transform(F.sequence(F.lit(0), F.lit(7 * 6 * 4 - 1)), at)

    return changed(spark, d, value, (7, 6, 4))


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, z, y, x, {R.format('avg(v * (1 + patch))')} AS v FROM vox JOIN g ON {INBOX} GROUP BY 1, 2, 3, 4")
def overlap_avg(spark, d):
    p = patch_voxels(spark, d).withColumn("v", F.col("v") * (F.lit(1) + F.col("patch")))
    return p.groupBy("case_id", "z", "y", "x").agg(rounded(F.avg("v")).alias("v"))


@query(f"WITH {VOX} SELECT case_id, z, y, x, {R.format('v * 2')} AS v FROM vox")
def patch_predict_merge(spark, d):
    """A model over Arrow batches of patches, its overlapping predictions averaged."""
    import pyarrow.compute as pc

    def model(batches):
        for b in batches:
            yield b.set_column(b.schema.get_field_index("v"), "v", pc.multiply(b.column("v"), 2.0))

    p = patch_voxels(spark, d)
    return p.mapInArrow(model, p.schema).groupBy("case_id", "z", "y", "x").agg(rounded(F.avg("v")).alias("v"))


@query(f"""WITH {VOX} SELECT case_id, z, y, x, CAST(sum(c) OVER (PARTITION BY case_id, y, x ORDER BY z) AS BIGINT) AS s FROM (SELECT case_id, z, y, x, sum(b) OVER (PARTITION BY case_id, z, x ORDER BY y) AS c FROM (
SELECT case_id, z, y, x, sum(CAST(v > 0.1::DOUBLE AS INT)) OVER (PARTITION BY case_id, z, y ORDER BY x) AS b FROM vox))""")
def prefix_sum(spark, d):
    """Counts of set voxels in the box from the origin, chained axis by axis in one shuffle by case."""
    v = vox(spark, d).repartition("case_id").withColumn("s", (F.col("v") > dbl(0.1)).cast("long"))
    for axis, others in (("x", ("z", "y")), ("y", ("z", "x")), ("z", ("y", "x"))):
        v = v.withColumn("s", F.sum("s").over(W.partitionBy("case_id", *others).orderBy(axis)))
    return v.select("case_id", "z", "y", "x", "s")


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, patch, CAST(sum(CAST(v > 0.1::DOUBLE AS INT)) AS BIGINT) AS s FROM vox JOIN g ON {INBOX} GROUP BY 1, 2")
def box_sum(spark, d):
    return patch_voxels(spark, d).groupBy("case_id", "patch").agg(F.sum((F.col("v") > dbl(0.1)).cast("long")).alias("s"))


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, patch FROM vox JOIN g ON {INBOX} GROUP BY 1, 2 HAVING sum(CAST(v > 0.1::DOUBLE AS INT)) >= 4")
def patch_valid_starts(spark, d):
    return box_sum(spark, d).where("s >= 4").select("case_id", "patch")


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, patch, avg(CAST(v > 0.1::DOUBLE AS INT)) AS fraction FROM vox JOIN g ON {INBOX} GROUP BY 1, 2")
def foreground_fraction(spark, d):
    return patch_voxels(spark, d).groupBy("case_id", "patch").agg(F.avg((F.col("v") > dbl(0.1)).cast("int")).alias("fraction"))


@query("SELECT n, CAST(least(greatest(1, round_even(n * 0.2::DOUBLE, 0)), n - 1) AS BIGINT) AS val FROM (SELECT count(*) AS n FROM embeddings)")
def split_counts(spark, d):
    """Ids ranked by hash; the first become the validation split."""
    ids = table(spark, d, "embeddings").select("vec_id")
    n = ids.count()
    val = F.least(F.greatest(F.lit(1), F.rint(F.lit(n) * dbl(0.2))), F.lit(n - 1))
    order = ranked(ids.withColumn("h", F.xxhash64(F.lit(42), "vec_id")), ["h", "vec_id"], "r")
    return order.agg(F.count("*").alias("n"), F.sum((F.col("r") < val).cast("long")).alias("val"))


@query(f"WITH {VOX} SELECT case_id, label, CAST(least(count(*), 5) AS BIGINT) AS n FROM (SELECT case_id, {LAB} AS label FROM vox) WHERE label > 0 GROUP BY 1, 2")
def location_caps(spark, d):
    """At most five places a label, those of the smallest hash."""
    v = vox(spark, d).withColumn("label", labelled(F.col("v"))).where("label > 0")
    top = W.partitionBy("case_id", "label").orderBy(F.xxhash64(F.lit(1234), "case_id", "z", "y", "x"))
    return v.withColumn("r", F.row_number().over(top)).where("r <= 5").groupBy("case_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {VOX} SELECT case_id, z, y, x, greatest(0, z - 1) AS lo, least(z, 2) AS hi FROM vox WHERE v > 0.2::DOUBLE")
def start_bounds(spark, d):
    b = C.start_bounds(F.col("z"), F.lit(4), F.lit(2))
    return vox(spark, d).where(F.col("v") > dbl(0.2)).select("case_id", "z", "y", "x", b.alias("b")).select("case_id", "z", "y", "x", "b.lo", "b.hi")


@query("SELECT DISTINCT channel, CASE lower(channel) WHEN 'ct' THEN 'CTNormalization' WHEN 'nonorm' THEN 'NoNormalization' ELSE 'ZScoreNormalization' END AS scheme FROM (SELECT unnest([event_type, 'CT', 'noNorm']) AS channel FROM events)")
def channel_scheme_map(spark, d):
    names_ = F.array(F.col("event_type"), F.lit("CT"), F.lit("noNorm"))
    return table(spark, d, "events").select(F.explode(names_).alias("channel")).distinct().withColumn("scheme", C.scheme_of(F.col("channel")))


@query("SELECT vec_id AS case_id, 'spacing' AS problem FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id, 'size' FROM embeddings WHERE len(embedding) <> 64")
def validation_errors(spark, d):
    """One row per violated rule of a case, here with a spacing of 0 in every seventh."""
    bad = cases(spark, d).withColumn("spacing", F.when(F.col("case_id") % 7 == 0, F.array(dbl(0), dbl(1), dbl(1))).otherwise(F.col("spacing")))
    from voxelloom.sources.scan import violations

    return violations(bad, SHAPE)


@query("SELECT 'segmentation' AS task_mode, 'train' AS run_stage, CAST(vec_id AS VARCHAR) AS identifier FROM embeddings")
def manifest_roundtrip(spark, d):
    from voxelloom.sources.manifest import MANIFEST, manifest

    ids = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("identifier"))
    return manifest(ids, "segmentation", "train").select(F.from_json(F.to_json(F.struct("*")), MANIFEST).alias("m")).select("m.task_mode", "m.run_stage", F.explode("m.identifiers").alias("identifier"))


def case_rows(spark, d) -> DataFrame:
    """The embeddings as raw cases of the data set pipeline, on an even grid."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("case_id"), F.array(*[F.lit(n) for n in (1, *SHAPE)]).alias("shape"), F.array(dbl(1), dbl(1), dbl(1)).alias("spacing"), F.col("embedding").cast("array<float>").alias("image"))


def flat_voxels(df: DataFrame, data: str) -> DataFrame:
    return df.select("case_id", F.posexplode(data).alias("p", "v")).select("case_id", "p", rounded(F.col("v").cast("double")).alias("v"))


F32 = R.format("CAST(CAST({0} AS FLOAT) AS DOUBLE)")


@query(f"""WITH {VOX}, st AS (SELECT case_id, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS s FROM vox GROUP BY 1)
SELECT CAST(case_id AS VARCHAR) AS case_id, y * 16 + x * 4 + z AS p, {F32.format('(v - m) / s')} AS v FROM vox JOIN st USING (case_id)""")
def case_preprocess(spark, d):
    """The pipeline that the command line runs: axes turned, z-scores, no resampling on an even grid."""
    config = planner.Config([1.0, 1.0, 1.0], [1, 2, 0], ["ZScoreNormalization"], [False], {}, planner.Resampling(3, 0, 1, 0))
    return flat_voxels(pipeline.preprocess(case_rows(spark, d), config, task="segmentation", stage="predict"), "image")


@query(f"WITH {VOX} SELECT CAST(case_id AS VARCHAR) AS case_id, z * 16 + y * 4 + x AS p, {F32.format('2 * v')} AS v FROM vox")
def case_restore(spark, d):
    """Preprocessed, put through a model by overlapping patches, merged, and undone on the raw grid."""
    config = planner.Config([1.0, 1.0, 1.0], [1, 2, 0], ["NoNormalization"], [False], {}, planner.Resampling(3, 0, 1, 0))
    done = pipeline.preprocess(case_rows(spark, d), config, task="segmentation", stage="predict")
    return flat_voxels(pipeline.restore(pipeline.predict(done, lambda a: 2 * a, (2, 3, 3)), done, config), "data")


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, patch, sz, sy, sx, {F32.format('sum(v)')} AS s FROM vox JOIN g ON {INBOX} GROUP BY 1, 2, 3, 4, 5")
def patch_kernel_cut(spark, d):
    """Sums of the patches that prediction and training read."""
    volumes_ = case_rows(spark, d).select(F.col("case_id").cast("long").alias("case_id"), "shape", F.col("image").alias("data"))
    cut = patches.grid_patches(volumes_, (2, 2, 2))
    total = F.aggregate("data", dbl(0), lambda a, v: a + v.cast("double"))
    return cut.select("case_id", "patch", *[F.element_at("starts", k + 1).alias(f"s{a}") for k, a in enumerate("zyx")], rounded(total.cast("float").cast("double")).alias("s"))


@query(f"WITH {VOX}, g AS ({GRID}) SELECT case_id, patch, sz, sy, sx FROM vox JOIN g ON {INBOX} GROUP BY 1, 2, 3, 4, 5 HAVING sum(CAST(v > 0.1::DOUBLE AS INT)) >= 4")
def patch_kernel_valid_starts(spark, d):
    """The integral image's starts against plain sums."""
    rows = cases(spark, d).select("case_id", F.array(*[F.lit(n) for n in (1, *SHAPE)]).alias("shape"), F.transform("data", lambda v: (v > dbl(0.1)).cast("float")).alias("data"))
    found = patches.valid_starts(rows, (2, 2, 2), 0.5, 1000)
    return found.select("case_id", "patch", *[F.element_at("starts", k + 1).alias(f"s{a}") for k, a in enumerate("zyx")])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Data set statistics, CT normalisation, linear resampling and the foreground share of each case."""
    normal = norm_ct(spark, d).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))), lambda s: s["v"]).alias("data"))
    up = normal.select("case_id", resample.resample(F.col("data"), SHAPE, (6, 6, 6), 1).alias("data"))
    share = F.size(F.filter("data", lambda v: v > dbl(0.5))) / F.size("data")
    return up.select("case_id", rounded(share).alias("foreground"))


