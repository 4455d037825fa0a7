"""Packing by non-negative least squares over shallow length combinations.

A document's ids and its end id are cut into whole windows and one rest, so the histogram of
piece lengths has at most `window` bins however large the corpus is. Combinations of two or
three lengths that fill a window exactly are enumerated, their repeat counts solved for
against the histogram (image space reconstruction updates, which keep counts non-negative),
rounded without overdrawing a bin, and the residual histogram is packed greedily, the largest
length first and then the largest that still fits. The resulting table of combinations, whose
size depends on `window` alone, is the only thing that is broadcast: a piece looks up its rank
among the pieces of its length.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for
itself; no rows give no rows; extra columns are ignored; a long document takes many windows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import buckets_for, byte_bpe, default_vocabulary, running_offset, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
END_ID = 1


def cut_documents(docs: DataFrame, vocabulary: str, window: int, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut them into windows: PIECES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4").tobytes()
                n = len(ids)
                rows += [(doc_id, at, min(window, n - at), zlib.crc32(raw[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def combinations(hist: np.ndarray, per_length: int = 3) -> np.ndarray:
    """Rows of three lengths (0: unused) that fill the window exactly: every pair, and some triples of each length."""
    window = len(hist) - 1
    there = np.flatnonzero(hist[:window])
    there = there[there > 0]
    rows = [(a, window - a, 0) for a in there if a <= window - a and hist[window - a]]
    for a in there:
        rest = there[(there < window - a) & (there > 0)]
        rest = rest[hist[window - a - rest] > 0]
        gain = np.minimum(hist[rest], hist[window - a - rest])
        rows += [(a, b, window - a - b) for b in rest[np.argsort(-gain, kind="stable")[:per_length]]]
    return np.unique(np.sort(np.array(rows, dtype=np.int64).reshape(-1, 3), axis=1), axis=0)


def solve_counts(combos: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|, where A counts the lengths of each combination."""
    if not len(combos):
        return np.zeros(0)
    used = combos > 0
    wanted = np.where(used, hist[combos], 0).sum(axis=1).astype(float)
    x = np.full(len(combos), hist.sum() / max(1, used.sum()))
    for _ in range(rounds):
        filled = np.bincount(combos[used], weights=np.repeat(x, used.sum(axis=1)), minlength=len(hist))
        x *= wanted / np.maximum(np.where(used, filled[combos], 0).sum(axis=1), 1e-12)
    return x


def pattern_table(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram; hist[n] counts pieces of length n."""
    window, left = len(hist) - 1, hist.copy()
    table = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    combos = combinations(left)
    x = solve_counts(combos, left)
    for k in np.argsort(-x, kind="stable"):
        lengths = tuple(int(n) for n in combos[k][::-1] if n)
        times = min(int(x[k] + 0.5), *(int(left[n]) // lengths.count(n) for n in lengths))
        if times > 0:
            for n in lengths:
                left[n] -= times
            table.append((lengths, times))
    open_lengths = [int(n) for n in np.flatnonzero(left)]
    while open_lengths:
        chosen: dict[int, int] = {}
        room, k = window, len(open_lengths)
        while k and room >= open_lengths[0]:
            k = bisect.bisect_right(open_lengths, room, 0, k)
            if not k:
                break
            n = open_lengths[k - 1]
            chosen[n] = take = min(room // n, int(left[n]))
            room -= take * n
            k -= 1
        times = min(int(left[n]) // c for n, c in chosen.items())
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                open_lengths.remove(n)
        table.append((tuple(n for n, c in chosen.items() for _ in range(c)), times))
    return table


def pack_pieces(pieces: DataFrame, window: int) -> DataFrame:
    """Give every piece its sequence and offset there; pieces are at most `window` long."""
    spark = pieces.sparkSession
    hist = np.zeros(window + 1, dtype=np.int64)
    for n, count in pieces.groupBy("length").count().collect():  # at most `window` rows
        hist[n] = count
    rows, used, base = [], np.zeros(window + 1, dtype=np.int64), 0
    for lengths, times in pattern_table(hist):
        offset = 0
        for n in lengths:
            rows.append((n, int(used[n]), int(used[n]) + times, base, offset))
            used[n] += times
            offset += n
        base += times
    # bounded: a few entries for each length below `window`, whatever the corpus
    places = spark.createDataFrame(rows, "length long, lo long, hi long, base long, offset long")
    ranked = running_offset(pieces, ["length"], F.lit(1), ["doc_id", "start", "ids_crc32", "doc_tokens"], buckets_for(int(hist.max())), "rank")
    placed = ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(places.length)
    return placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(written(cut_documents(docs, vocabulary or default_vocabulary("byte_bpe_50k.json"), window)), window)
