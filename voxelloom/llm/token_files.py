"""Token counts by a separator scan of flat token files.

A flat file is a stream of little-endian ids, documents ended by an end-of-document id, with no
index. It is read in byte ranges that know nothing of documents, each by a task that seeks to
it, so a file may be of any size. Each block is scanned for the separator at once and yields the
lengths of the documents that end in it and the tokens left after its last separator. A prefix
scan over block summaries (two numbers a block) tells how many documents ended before a block
and how many tokens an open document brings along. Spark does that scan by window, per file,
over summaries only.

Files are opened by executors: by path where the folder is mounted, else through pyarrow's file
systems (s3, gs, hdfs, abfs and the like).

Defined cases: a file's tokens after its last separator are one more, unended document (ended is
false); an empty file has none; consecutive separators are documents of length 0; null texts are
empty; a very long text is one stretch of its file and spans blocks; no rows give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelloom.llm.shared import byte_bpe, default_vocabulary, shared_folder, small_batches, written

RANGES = "file string, block long, offset long, length long"


def file_system(uri: str):
    """(pyarrow file system, path there) of a URI as Spark writes it, or of a plain path."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files right under path, by the session's file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith((".", "_")))


def flat_ranges(files: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """RANGES of files(file, size): byte ranges of at most block_bytes."""
    cut = files.where("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_bytes}L)")).alias("block"))
    offset = F.col("block") * block_bytes
    return cut.select("file", "block", offset.alias("offset"), F.least(F.lit(block_bytes), F.col("size") - offset).alias("length"))


def flat_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """RANGES of the flat binary files right under path."""
    return flat_ranges(spark.createDataFrame(list_files(spark, path), "file string, size long"), block_bytes)


def count_tokens(ranges: DataFrame, *, separator: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, ended): the documents of RANGES in order, their separator not counted.

    width: bytes of an id; ranges hold whole ids.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)
        for batch in batches:
            for file, block, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened[0] != file:
                    system, path = file_system(file)
                    opened = file, system.open_input_file(path)
                ids = np.frombuffer(opened[1].read_at(length, offset), kind)
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                flat = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([len(ends)]), flat, pa.array([tail])], names=["file", "block", "n", "lengths", "tail"])

    small_batches(ranges)
    spread = ranges.repartition("file", (F.col("block") / 64).cast("long"))  # neighbours are read in one task
    found = written(spread.select("file", "block", "offset", "length").mapInArrow(scan, "file string, block long, n long, lengths array<long>, tail long"))
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    summary = found.select("file", "block", "n", "tail")
    # a document that is open at a block has the tail after the last separator, and whole blocks since
    run_before = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = (
        summary.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("run", F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(before), F.lit(0)))
        .withColumn("opened", F.coalesce(F.last(F.when(F.col("n") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0)))
        .withColumn("carry", F.col("opened") + F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("tail")).otherwise(0)).over(run_before), F.lit(0)))
    )
    joined = found.select("file", "block", "lengths").join(stitched.select("file", "block", "ordinal", "carry"), ["file", "block"])
    ended = joined.select("file", "ordinal", "carry", F.posexplode("lengths").alias("k", "length"))
    ended = ended.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    last = stitched.groupBy("file").agg(F.max_by(F.struct((F.col("ordinal") + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens")), "block").alias("open"))
    rest = last.where("open.n_tokens > 0").select("file", "open.ordinal", "open.n_tokens", F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def flatten(docs: DataFrame, folder: str, *, vocabulary: str | None = None, separator: int = 50256) -> tuple[DataFrame, DataFrame]:
    """Write docs(doc_id, text) as flat files of 16-bit ids, one a partition: (file, size), and (file, ordinal, doc_id).

    The separator's own text is encoded as ordinary text, so the id only ends documents. A
    task's attempt writes a file of its own; only files of attempts that Spark has accepted are
    in the result, so a lost executor or a second attempt changes nothing.
    """
    vocabulary = vocabulary or default_vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, context = byte_bpe(vocabulary), TaskContext.get()
        system, path = file_system(f"{folder}/flat-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin")
        file, ordinal, size = f"{folder}/{os.path.basename(path)}", 0, 0
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            for batch in batches:
                owners = batch.column(0)
                for text in batch.column(1):
                    ids = np.array([*encode(text.as_py() or "", False), separator], "<u2")
                    out.write(ids.tobytes())
                    size += 2 * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([ordinal]), pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners), pa.array([None], pa.int64())], names=["file", "first", "doc_ids", "size"])
                ordinal += len(owners)
        if ordinal:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([size])], names=["file", "first", "doc_ids", "size"])
        else:
            system.delete_file(path)

    small_batches(docs)
    flat = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, first long, doc_ids array<long>, size long"))
    owners = flat.where("size is null").select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return flat.where("size is not null").select("file", "size"), owners


def count_documents(docs: DataFrame, *, vocabulary: str | None = None, separator: int = 50256, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens of every row of docs, counted in the flat files that flatten() writes."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/flat-{uuid.uuid4().hex}"
    files, owners = flatten(docs, folder, vocabulary=vocabulary, separator=separator)
    counts = count_tokens(flat_ranges(files, block_bytes), separator=separator)
    # both sides are exploded arrays, which look tiny to the planner: ask for a merge, not a broadcast
    return owners.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
