"""Packed token ids in binary: best-fit-decreasing bins found with a segment tree.

Whole texts become ids and an end id; a document longer than a row is split losslessly. Pieces
of a batch of bounded size go, longest first, into the row with the least sufficient room. A
segment tree over room sizes holds which sizes have open rows, so each search takes the
logarithm of the row length. Every row is one packed id array (little-endian unsigned 32 bits,
padded to the row length), its cumulative segment lengths, and position ids, packed likewise, that
begin at 0 with each segment; a segment that continues a document goes on from its start there if
`resume`.

Batches are packed where they are read, without a shuffle; `pack` sizes them.

Defined cases: null or empty text is the end id alone; repeated rows are packed each for itself;
no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import byte_bpe, default_vocabulary

ROWS = "shard int, row long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


class RoomTree:
    """Open rows by room; `best(n)` finds a row of least room >= n through a segment tree of counts."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Take out (room, row)."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is at most `size` long."""
    tree, rows = RoomTree(size), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room, row = tree.best(lengths[k]) or (size, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            tree.put(room - lengths[k], row)
    return rows


def position_ids(cu_seqlens: list[int], starts: list[int], size: int, resume: bool = False) -> np.ndarray:
    """Positions of a row: from 0, or from the piece's start, at each segment; padding counts from 0."""
    out = np.zeros(size, np.int64)
    for k, (a, b) in enumerate(zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True)):
        out[a:b] = np.arange(b - a) + (starts[k] if resume else 0)
    out[cu_seqlens[-1] :] = np.arange(size - cu_seqlens[-1])
    return out


def pack_binary(docs: DataFrame, *, vocabulary: str | None = None, size: int = 2048, end_id: int = 1, pad_id: int = 0, pack: int = 4_000_000, resume: bool = False) -> DataFrame:
    """ROWS of docs(doc_id, text). pack: tokens that are packed together at least. resume: see position_ids."""
    vocabulary = vocabulary or default_vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, row, encode = TaskContext.get().partitionId(), 0, byte_bpe(vocabulary)
        pieces: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal row, held, pieces
            made = best_fit_decreasing([len(p[2]) for p in pieces], size)
            cols: list[list] = [[] for _ in range(8)]
            for members in made:
                own = [pieces[k] for k in members]
                cut = np.cumsum([0, *(len(p[2]) for p in own)])
                ids = np.full(size, pad_id, "<u4")
                ids[: cut[-1]] = np.concatenate([p[2] for p in own])
                cut, starts = cut.tolist(), [p[1] for p in own]
                positions = position_ids(cut, starts, size, resume).astype("<u4")
                for c, v in zip(cols, (shard, row, cut[-1], ids.tobytes(), positions.tobytes(), cut, [p[0] for p in own], starts), strict=True):
                    c.append(v)
                row += 1
            pieces, held = [], 0
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["shard", "row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                pieces += [(doc_id, at, ids[at : at + size]) for at in range(0, len(ids), size)]
                held += len(ids)
                if held >= pack:
                    yield flush()
        if pieces:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def write_binary(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet shards, uncompressed so that readers can map the id pages."""
    rows.write.option("compression", "none").parquet(path)


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the pieces back out of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4")
                out += [(d, s, ids[a:b].tolist()) for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)]
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["doc_id", "start", "ids"])

    return rows.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, "doc_id long, start long, ids array<long>")
