import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxelloom.llm import binpack, packing, token_files
from voxelloom.llm.shared import byte_bpe, default_vocabulary

PATH = default_vocabulary("byte_bpe_50k.json")


def slow_ids(text, specials=True):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not specials
    return t.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_agree():
    rng, encode, t = random.Random(2), byte_bpe(PATH), Tokenizer.from_file(PATH)
    for k in range(4000):
        chars = [chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD800), rng.randrange(0x1F000, 0x1FB00), 32, 10])) for _ in range(rng.randrange(1, 30))]
        text = "".join(chars) + "<|endoftext|> x" * (k % 7 == 0)
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
    spaces = "a" + " " * 300_000 + "b"
    assert encode(spaces) == slow_ids(spaces)


def test_packing(docs):
    rows = packing.pack_documents(docs, window=2048).collect()
    by_piece, by_doc = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_piece.setdefault(r.sequence_id, []).append(r)
    for own in by_piece.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(by_piece) == list(range(len(by_piece)))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in texts.items():
        want = []
        for text in own:
            ids = [*slow_ids(text), 1]
            raw = np.array(ids, "<u4").tobytes()
            want += [(at, min(2048, len(ids) - at), zlib.crc32(raw[4 * at : 4 * at + 8192]), len(ids)) for at in range(0, len(ids), 2048)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]) == sorted(want)


def test_packing_wastes_little(spark, small):
    rows = packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert len({r.sequence_id for r in rows}) <= np.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1


def test_least_squares_uses_up_the_histogram():
    rng = np.random.default_rng(4)
    hist = np.zeros(129, np.int64)
    np.add.at(hist, rng.integers(1, 129, 5000), 1)
    used = np.zeros_like(hist)
    for lengths, times in packing.pattern_table(hist):
        assert sum(lengths) <= 128 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == hist).all()
    combos = packing.combinations(hist)
    x = packing.solve_counts(combos, hist)
    fill = np.bincount(combos[combos > 0], weights=np.repeat(x, (combos > 0).sum(axis=1)), minlength=129)
    assert (x >= 0).all() and np.abs(fill - hist)[1:128].sum() < 0.5 * hist[1:128].sum()


def test_empty_tables(no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    assert binpack.pack_binary(no_docs).count() == 0
    assert token_files.count_documents(no_docs).count() == 0


@pytest.mark.parametrize("size", [64, 2048])
def test_binary_rows_round_trip(docs, size):
    rows = binpack.pack_binary(docs, size=size)
    for r in rows.collect():
        assert len(r.ids) == 4 * size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        positions = binpack.position_ids(r.cu_seqlens, r.starts, size)
        assert all(positions[a] == 0 for a in r.cu_seqlens[:-1])
    got = {}
    for r in binpack.unpack(rows).collect():
        got.setdefault(r.doc_id, []).append((r.start, tuple(r.ids)))
    want = {}
    for r in docs.collect():
        ids = [*slow_ids(r.text), 1]
        want.setdefault(r.doc_id, []).extend((at, tuple(ids[at : at + size])) for at in range(0, len(ids), size))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("resume", [False, True])
def test_positions_in_the_written_files(docs, tmp_path, resume):
    import pyarrow.parquet as pq

    binpack.write_binary(binpack.pack_binary(docs, size=64, resume=resume), str(tmp_path / "rows"))
    files = sorted((tmp_path / "rows").glob("*.parquet"))
    assert files and all(pq.read_metadata(f).row_group(0).column(0).compression == "UNCOMPRESSED" for f in files if pq.read_metadata(f).num_row_groups)
    rows, continued = [r for f in files for r in pq.read_table(f).to_pylist()], 0
    for r in rows:
        want = []
        for a, b, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["starts"], strict=False):
            want += [start * resume + k for k in range(b - a)]
            continued += start > 0
        assert np.frombuffer(r["positions"], "<u4").tolist() == want + list(range(64 - r["n_tokens"]))
    assert continued and sum(r["n_tokens"] for r in rows) == sum(len(slow_ids(r.text)) + 1 for r in docs.collect())


def test_segment_tree_is_best_fit():
    rng = random.Random(8)
    for _ in range(50):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 80))]
        rooms, want = [], []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else 100) - n)
            want = rooms
        got = binpack.best_fit_decreasing(lengths, 100)
        assert sorted(100 - sum(lengths[k] for k in row) for row in got) == sorted(want)
        assert sorted(k for row in got for k in row) == list(range(len(lengths)))


def test_token_counts(docs):
    got = sorted(((r.doc_id, r.n_tokens) for r in token_files.count_documents(docs, block_bytes=194).collect()), key=str)
    assert got == sorted(((r.doc_id, len(slow_ids(r.text, False))) for r in docs.collect()), key=str)


def test_separator_scan_of_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    want = set()
    for k in range(4):
        ids = rng.integers(0, 40, 5000 * k).astype("<u2")
        (tmp_path / f"f{k}.bin").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 7)
        lengths = (np.diff(ends, prepend=-1) - 1).tolist()
        want |= {(f"f{k}.bin", i, n, True) for i, n in enumerate(lengths)}
        if len(ids) and (rest := len(ids) - 1 - int(ends[-1])):
            want.add((f"f{k}.bin", len(lengths), rest, False))
    got = token_files.count_tokens(token_files.flat_files(spark, str(tmp_path), 64), separator=7).collect()
    assert {(r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.ended) for r in got} == want


def test_flat_files_hold_the_documents_in_order(docs, tmp_path):
    """The files are flat ids and separators, and nothing else; owners name each document's place."""
    files, owners = token_files.flatten(docs, f"file://{tmp_path}/flat")
    streams = {r.file: np.fromfile(r.file.removeprefix("file://"), "<u2") for r in files.collect()}
    assert all(2 * len(streams[r.file]) == r.size for r in files.collect())
    parts = {f: np.split(s, np.flatnonzero(s == 50256) + 1) for f, s in streams.items()}
    got = sorted(((r.doc_id, parts[r.file][r.ordinal][:-1].tolist()) for r in owners.collect()), key=str)
    assert got == sorted(((r.doc_id, slow_ids(r.text, False)) for r in docs.collect()), key=str)


def test_file_systems(tmp_path):
    from pyarrow import fs

    for uri in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        system, path = token_files.file_system(uri)
        assert isinstance(system, fs.LocalFileSystem) and path == str(tmp_path)
