"""Plumbing that the operators share: written tables, running offsets, tokens, components.

Nothing here gathers documents, links or components on the driver.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Where written tables go when no shared folder is named, which only local sessions may do.
LOCAL_FOLDER = "/tmp/checkpoints/voxelloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets LOCAL_FOLDER."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/") + "/voxelloom"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_FOLDER


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, most: int = 4 << 20) -> None:
    """Let the session's Arrow batches hold `most` bytes, unless it has set a size: a batch lies in Python twice or more."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("bB") == str(64 << 20):
        conf.set(key, str(most))


def discard_written(spark: SparkSession) -> None:
    """Delete what this application has written; results read from it must have been saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_offset(df: DataFrame, group: list[str], weight: Column, order: list[str], buckets: int, out: str) -> DataFrame:
    """Add `out`, the sum of `weight` over the earlier rows of the group.

    A group is split into `buckets` by a hash of the order columns; rows run by bucket, then
    by the order columns, so one hot group is spread over many tasks and only the bucket
    sums meet. Rows equal in all order columns get consecutive offsets in any order.
    """
    df = df.withColumn("_bkt", F.pmod(F.xxhash64(F.lit(11), *order), F.lit(buckets)).cast("int")).withColumn("_wt", weight)
    inside = W.partitionBy(*group, "_bkt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_bkt").agg(F.sum("_wt").alias("_sum"))
    before = W.partitionBy(*group).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*group, "_bkt", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    rows = df.withColumn("_in", F.coalesce(F.sum("_wt").over(inside), F.lit(0)))
    return rows.join(base, [*group, "_bkt"]).withColumn(out, F.col("_in") + F.col("_base")).drop("_bkt", "_wt", "_in", "_base")


def buckets_for(rows: int, per_bucket: int = 200_000, least: int = 16) -> int:
    return max(least, math.ceil(rows / per_bucket))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (src, dst).

    Min-label propagation with pointer jumping. Each step is a join of two written tables, so
    that adaptive execution splits a hot label, and an aggregation with map-side combining.
    Rounds grow with the logarithm of the longest path.
    """
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("m"))
        hooked = written(labels.join(seen, labels.node == seen.src, "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        parent = hooked.select(F.col("node").alias("p"), F.col("component").alias("grand"))
        jumped = written(hooked.join(parent, hooked.component == parent.p, "left").select("node", F.least("component", "grand").alias("component"), (F.least("component", "grand") < F.col("old")).alias("moved")))
        labels = jumped.select("node", "component")
        if not jumped.where("moved").limit(1).count():
            return labels


_ENCODERS: dict[str, object] = {}
#: Runs of white space from this length on go to the slower library: the faster one's stack ends at some hundred thousand.
LONG_SPACE = re.compile(r"(?<!\s)\s{4096}")


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str):
    """text -> list of ids, as the byte-level vocabulary file of `tokenizers` gives them.

    The rank file beside it holds the same vocabulary and its library is four times as fast,
    so ids come from that one; only the special token's text, which the JSON file maps to one
    id, is cut out beforehand. A test holds both libraries against each other. Texts with very
    long runs of white space come from `tokenizers` itself.
    """
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {}
        with open(path.rsplit(".", 1)[0] + ".tiktoken", "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special, special_id = "<|endoftext|>", len(ranks)

        def encode(text: str, specials: bool = True) -> list[int]:
            if LONG_SPACE.search(text):
                slow = Tokenizer.from_file(path)
                slow.encode_special_tokens = not specials
                return slow.encode(text, add_special_tokens=False).ids
            if not specials or special not in text:
                return plain(text)
            ids: list[int] = []
            for k, part in enumerate(text.split(special)):
                if k:
                    ids.append(special_id)
                ids += plain(part)
            return ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]
