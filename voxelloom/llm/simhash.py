"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of at most `bits` differing bits agree in at least 8 - bits of their 8 bytes. Lists
under single byte values would hold a 256th of all rows each, so the index lists fingerprints
under three byte positions at once: a family of position sets such that whichever `8 - bits`
positions agree, one set of the family lies within them (Turan's triples for four of eight).
A pair that meets in a list shares the list's bytes; the bytes shared at the other positions are
added to that tally from the two postings, pairs that reach the guaranteed minimum of 8 - bits
are kept, and only of those the differing bits are counted.

Copies with equal fingerprints collapse first. Short lists are joined with themselves; a long
list is cut into blocks and each pair of blocks becomes one task of its own, which returns
links that span the same components as all of its links, never all pairs.

Defined cases: null or wordless text has fingerprint 0 and links like any other; repeated rows
each get a row; null doc_id counts as no id (component_id is null if a component has none); a
very long text is hashed in parts; no rows give no rows; extra columns are ignored by
`simhash_dedup` and kept, whatever their names, by `keep_one_each`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.shared import connected_components, fresh, small_batches, written

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of white-space-separated words."""
    from xxhash import xxh64_intdigest as xx

    tokens = (text or "").encode().translate(UPPER_TO_LOWER).split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xx(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[shingle - 1 :].tolist()
    first = [0, *(ends[: len(tokens) - shingle] + 1).tolist()]
    hashes = np.fromiter((xx(flat[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def position_sets(agree: int) -> list[tuple[int, ...]]:
    """Sets of at most 3 byte positions, one of which lies in any `agree` positions that agree."""
    if agree != 4:
        return list(itertools.combinations(range(8), min(3, agree)))
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    sets = [t for p in parts for t in itertools.combinations(p, 3)]
    sets += [(*two, one) for p, q in zip(parts, parts[1:] + parts[:1], strict=True) for two in itertools.combinations(p, 2) for one in q]
    return sorted(tuple(sorted(s)) for s in sets)


def shared_bytes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many byte positions agree, of each pair of unsigned fingerprints."""
    tally = np.zeros((len(left), len(right)), np.uint8)
    for p in range(8):
        shift = np.uint64(8 * p)
        tally += (left >> shift).astype(np.uint8)[:, None] == (right >> shift).astype(np.uint8)[None, :]
    return tally


def spanning_labels(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links near[i, j] between i and n + j: the smallest node of each node's component."""
    n, m = near.shape
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        new_cols = np.minimum(cols, np.where(near, rows[:, None], n + m).min(axis=0, initial=n + m))
        new_rows = np.minimum(rows, np.where(near, new_cols[None, :], n + m).min(axis=1, initial=n + m))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def links(fps: DataFrame, bits: int = 4, short: int = 16, block: int = 1024) -> DataFrame:
    """(src, dst) whose components are those of all pairs of distinct fps within `bits` bits.

    `short`: a list up to this length is joined with itself. `block`: rows of a block of longer
    lists. Both are physical choices and change no result.
    """
    agree = 8 - bits
    sets = position_sets(agree)
    masks = [sum(0xFF << 8 * p for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])).alias("key"))
    lists = written(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = written(index.hint("merge").join(lists, "key"))  # the exploded index looks small to the planner

    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum(F.when(F.shiftright(differ, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8))
    small = met.where(F.col("n") <= short)
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (tally >= agree) & (F.bit_count(differ) <= bits))
    found = pairs.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))

    long = met.where(F.col("n") > short).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    long = long.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks")).cast("int"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = long.select("key", "fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def join_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        own, fp = pdf["own"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        left, right = fp[own == lo], fp[own == hi]
        near = shared_bytes(left, right) >= agree
        i, j = np.nonzero(near)
        near[i, j] = np.bitwise_count(left[i] ^ right[j]) <= bits
        rows, cols = spanning_labels(near)
        nodes = np.concatenate([left, right]).view(np.int64)
        src, dst = nodes, nodes[np.concatenate([rows, cols])]
        keep = src != dst
        return pd.DataFrame({"src": src[keep], "dst": dst[keep]})

    blocks = long.groupBy("key", "lo", "hi").applyInPandas(join_blocks, "src long, dst long")
    return found.unionByName(blocks).distinct()


def components(prints: DataFrame, bits: int = 4) -> DataFrame:
    """prints(doc_id, fp, ...) with component_id added."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    groups = written(connected_components(links(fps, bits)))
    linked = fps.join(groups, fps.fp == groups.node).select("fp", "first_doc", "component")
    heads = written(linked.groupBy("component").agg(F.min("first_doc").alias("component_id")))
    heads = written(linked.join(heads, "component").select("fp", "component_id"))
    every = written(fps.join(heads, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id")))
    return prints.join(every, "fp")


def simhash_dedup(docs: DataFrame, *, bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text)."""
    out = components(written(fingerprints(docs, shingle)), bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, *, bits: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component one row with its smallest doc_id, nulls last.

    Rows are numbered in a written copy, so rows of other components stay whether they share
    that doc_id or have none. Of a component's rows that share the smallest doc_id one stays.
    """
    own, uid = fresh(docs, "_fp"), fresh(docs, "_uid")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema, T.StructField(own, T.LongType())])

    def add_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(None if (text := t.as_py()) is None else str(text), shingle) for t in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, own])

    small_batches(docs)
    rows = written(docs.mapInArrow(add_prints, schema).withColumn(uid, F.monotonically_increasing_id()))
    prints = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("fp"), F.col(uid).alias("uid"))
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
    fps = written(prints.groupBy("fp").agg(head.alias("head")))
    groups = written(connected_components(links(fps, bits)))
    linked = written(fps.join(groups, fps.fp == groups.node, "left").select("fp", "component", "head"))
    firsts = linked.where("component is not null").groupBy("component").agg(F.min("head").alias("head")).select("head")
    heads = written(firsts.unionByName(linked.where("component is null").select("head")).select(F.col("head.uid").alias("_head")))
    # merged at every size: a broadcast of small heads would only hold until they grow
    return rows.join(heads.hint("merge"), rows[uid] == heads["_head"], "left_semi").select(*docs.columns)
