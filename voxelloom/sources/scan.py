"""Finding cases: names to identifiers and channels, matching, validation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import columns as C
from voxelloom.sources import images, rasters
from voxelloom.sources.readers import DESCRIBED, Reader, by_description, named

READERS = {".nii.gz": "sitk", ".nii": "nibabel", ".nrrd": "sitk", ".mha": "sitk", ".gipl": "sitk", ".tiff": "tiff3d", ".tif": "natural2d", ".png": "natural2d", ".bmp": "natural2d"}


def checked_reader(files: DataFrame, reader: str | Reader | None, dataset: dict | None = None) -> Reader | None:
    """The reader to use; a file that it does not take is an error. None is by the ending of each file.

    "auto" goes by the data set's description where that names a reader.
    """
    found = named(reader)
    if found is None and dataset and dataset.get("overwrite_image_reader_writer") in DESCRIBED:
        found = by_description(dataset)
    if found is not None and (other := files.where(~F.lower("name").rlike(C.endings(found.endings))).first()) is not None:
        raise ValueError(f"{found.name} does not read {other['name']}")
    return found


def reader_of(ending: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])
    return F.try_element_at(known, ending)


def list_files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = C.ENDINGS) -> DataFrame:
    """(path, name) of the supported files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").rlike(pattern))


def dataset_description(spark: SparkSession, *folders: str | None) -> dict | None:
    """The first dataset.json of the folders and the folders above them, each folder before the one above."""
    for folder in filter(None, folders):
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for above in filter(None, (place, place.getParent())):
            path = spark._jvm.org.apache.hadoop.fs.Path(above, "dataset.json")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                found = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])
                if not isinstance(found, dict):
                    raise ValueError(f"{path.toString()} is not an object")
                return found
    return None


def channels(files: DataFrame, name: str = "name") -> DataFrame:
    """files with case_id and channel; a name without a channel number is its own case, its channel null."""
    return files.withColumns({"case_id": case_key(F.col(name)), "channel": C.channel_of(F.col(name))})


def contiguity_errors(files: DataFrame, name: str = "name") -> DataFrame:
    """Cases whose channels are not exactly 0 to n - 1, each once, and files whose names have no channel number."""
    by_case = channels(files, name).groupBy("case_id", F.isnull("channel").alias("_none")).agg(F.count("*").alias("n"), F.min("channel").alias("lo"), F.max("channel").alias("hi"), F.countDistinct("channel").alias("k"))
    return by_case.where(F.col("_none") | ~((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("k") == F.col("n")))).drop("_none")


def single_errors(files: DataFrame, name: str = "name") -> DataFrame:
    """Identifiers with more than one file, or with a channel other than 0, where one file each is due."""
    case = F.coalesce(F.nullif(C.case_of(F.col(name)), F.lit("")), C.strip_suffix(F.col(name)))
    rows = files.select(case.alias("case_id"), F.coalesce(F.expr(f"try_cast(nullif({_sql_channel(name)}, '') as int)"), F.lit(0)).alias("channel"))
    return rows.groupBy("case_id").agg(F.count("*").alias("n"), F.max("channel").alias("channel")).where("n > 1 or channel <> 0")


def _sql_channel(name: str) -> str:
    return f"regexp_extract(regexp_replace({name}, r'{C.ENDINGS}', ''), r'{C.MULTI}', 2)"


def scan_cases(files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """(case_id, paths): the channel files of each case in channel order; a name without a channel number is an error."""
    channel = F.coalesce("channel", F.raise_error(F.concat(F.lit("no channel number, as in case_0001_0000, in the name of "), F.col(name))).cast("int"))
    parts = channels(files, name).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(channel.alias("channel"), path))).alias("_c"))
    return parts.select("case_id", F.transform("_c", lambda c: c[path]).alias("paths"))


def mismatches(left: DataFrame, right: DataFrame, key: str, only_right: str, only_left: str) -> DataFrame:
    """(key, problem) for every identifier that one side lacks: two anti-joins."""
    return left.join(right, key, "left_anti").select(key, F.lit(only_left).alias("problem")).unionByName(right.join(left, key, "left_anti").select(key, F.lit(only_right).alias("problem")))


def violations(cases: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(case_id, problem): rules that a case of (data, spacing) breaks."""
    size = 1
    for n in shape:
        size *= n
    rules = {
        "size": F.coalesce(F.size("data"), F.lit(-1)) != size,
        "finite": F.exists("data", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))),
        "spacing": F.col("spacing").isNull() | (F.size("spacing") != len(shape)) | F.exists("spacing", lambda s: s.isNull() | F.isnan(s) | (s <= 0) | (s == F.lit(float("inf")))),
    }
    problems = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda p: p.isNotNull())
    return cases.select("case_id", F.explode(problems).alias("problem"))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= C.dbl(atol) + C.dbl(rtol) * F.abs(b)


def case_key(name: Column) -> Column:
    """The identifier of a file name, with or without a channel number."""
    return F.coalesce(F.nullif(C.case_of(name), F.lit("")), C.strip_suffix(name))


def load_cases(spark: SparkSession, folder: str, *, multi: bool = True, recursive: bool = False, to_ras: bool = False, reader: str | Reader | None = None, dataset: dict | None = None) -> DataFrame:
    """(case_id, shape, spacing, image) of a folder, its channel files stacked in order.

    Decoding is one map per file; one shuffle by case brings the channels together. Channels
    that are not 0 to n - 1, or differ in grid, are errors, as is a file that a named reader does not take.
    """
    own = named(reader)
    pattern = C.endings(own.endings) if own and reader == own else C.ENDINGS  # a reader of one's own chooses its files
    plain = F.regexp_replace("name", pattern, ".nii")
    files = list_files(spark, folder, recursive, pattern).withColumn("_plain", plain)
    bad = (contiguity_errors if multi else single_errors)(files, "_plain").first()
    if bad or files.first() is None:
        raise ValueError(f"channels of case {bad.case_id} are not complete" if bad else f"no image files in {folder}")
    v = images.read_volumes(spark, folder, "*", recursive, to_ras, checked_reader(files, reader, dataset))
    if files.where(F.lower("name").rlike(r"\.tiff?$")).first() is not None:
        v = rasters.with_side_spacing(spark, v, folder, recursive)
    v = v.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("name", plain)
    rows = v.select(case_key(F.col("name")).alias("case_id"), F.coalesce(F.expr(f"try_cast(nullif({_sql_channel('name')}, '') as int)"), F.lit(0)).alias("channel"), "shape", "spacing", "data")
    parts = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("channel", "shape", "spacing", "data"))).alias("c"))
    first = F.col("c")[0]
    same = F.forall("c", lambda c: (c["shape"] == first["shape"]) & F.forall(F.zip_with(c["spacing"], first["spacing"], lambda a, b: all_close(a, b)), lambda ok: ok))
    shape = F.when(F.size(first["shape"]) == 4, F.concat(F.array((F.size("c") * F.element_at(first["shape"], 1)).cast("int")), F.slice(first["shape"], 2, 3))).otherwise(F.concat(F.array(F.size("c")), first["shape"]))
    image = F.when(same, F.flatten(F.transform("c", lambda c: c["data"]))).otherwise(F.raise_error(F.concat(F.lit("channels differ in grid in case "), "case_id")))
    return parts.select("case_id", shape.alias("shape"), first["spacing"].alias("spacing"), image.alias("image"))


def matched(cases: DataFrame, references: DataFrame, name: str = "reference", same_spacing: bool = False) -> DataFrame:
    """Image cases with their references; identifiers that only one side has are an error, as are other sizes (or spacings)."""
    left, right = cases.select("case_id"), references.select("case_id")
    if bad := mismatches(left, right, "case_id", "no image", f"no {name}").limit(10).collect():
        raise ValueError("; ".join(f"{b.case_id}: {b.problem}" for b in bad))
    side = references.select("case_id", F.col("image").alias(name), F.element_at("shape", 1).alias("ref_channels"), F.col("shape").alias("_s"), F.col("spacing").alias("_spacing"))
    both = cases.join(side, "case_id")
    fits = F.slice("shape", 2, 3) == F.slice("_s", 2, 3)
    error = lambda what: F.raise_error(F.concat(F.lit(f"{what} differ in case "), "case_id"))
    near = (F.col("spacing") == F.col("_spacing")) | F.lit(not same_spacing)
    return both.withColumn(name, F.when(~fits, error("shapes")).when(~near, error("spacings")).otherwise(F.col(name))).drop("_s", "_spacing")
