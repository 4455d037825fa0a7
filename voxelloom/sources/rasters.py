"""More image files: TIFF, BMP and GIPL decoded; TIFF, PNG, MetaImage and NRRD encoded; side files."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import columns as C
from voxelloom.sources import orientation

Decoded = tuple[np.ndarray, list[float], list[float]]
UNIT = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
#: Type codes of the format and their sizes; sample formats 1 unsigned, 2 signed, 3 float.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
GIPL_TYPES = {7: "i1", 8: "u1", 15: "i2", 16: "u2", 31: "u4", 32: "i4", 64: "f4", 65: "f8"}


def _unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at] - 256 * (raw[at] > 127)
        if n >= 0:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (1 - n if n > -128 else 0)
            at += 2
    return bytes(out)


def tiff_pages(raw: bytes) -> list[np.ndarray]:
    """Pages (y, x, samples) of a striped file: stored, deflated or run-length packed."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack(end + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    pages, at = [], struct.unpack(end + "I", raw[4:8])[0]
    while at:
        n = struct.unpack(end + "H", raw[at : at + 2])[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(end + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in (1, 3, 4, 16):
                size = TIFF_SIZES[kind] * count
                place = at + 10 + 12 * k if size <= 4 else struct.unpack(end + "I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                tags[tag] = np.frombuffer(raw, end + {1: "u1", 3: "u2", 4: "u4", 16: "u8"}[kind], count, place).tolist()
        width, height, packing = tags[256][0], tags[257][0], tags.get(259, [1])[0]
        samples, bits = tags.get(277, [1])[0], tags.get(258, [1])[0]
        if bits not in (8, 16, 32, 64) or packing not in (1, 8, 32946, 32773) or tags.get(317, [1])[0] != 1 or tags.get(284, [1])[0] != 1:
            raise ValueError("unsupported TIFF variant")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(bits // 8)
        strips = [raw[o : o + c] for o, c in zip(tags[273], tags[279], strict=True)]
        body = b"".join(s if packing == 1 else _unpack_bits(s) if packing == 32773 else zlib.decompress(s) for s in strips)
        pages.append(np.frombuffer(body, end + kind, width * height * samples).reshape(height, width, samples))
        at = struct.unpack(end + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return pages


def read_tiff(raw: bytes) -> Decoded:
    """One page is a picture of (c, 1, y, x); several are a volume of (z, y, x)."""
    pages = tiff_pages(raw)
    if len(pages) == 1:
        return pages[0].transpose(2, 0, 1)[:, None].astype(np.float32), [999.0, 1.0, 1.0], UNIT
    return np.stack([p[..., 0] for p in pages]).astype(np.float32), [1.0, 1.0, 1.0], UNIT


def write_tiff(volume: np.ndarray) -> bytes:
    """(z, y, x) as deflated pages."""
    bits, fmt = 8 * volume.dtype.itemsize, {"u": 1, "i": 2, "f": 3}[volume.dtype.kind]
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for page in volume:
        body = zlib.compress(page.astype(page.dtype.newbyteorder("<")).tobytes())
        place = len(out)
        out += body + b"\0" * (len(body) % 2)
        struct.pack_into("<I", out, link, len(out))
        entries = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, bits), (259, 3, 8), (262, 3, 1), (273, 4, place), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(body)), (339, 3, fmt)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def read_bmp(raw: bytes) -> Decoded:
    """Uncompressed pictures of 8 (palette), 24 or 32 bits."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, head, width, height, _, bits, packing = struct.unpack("<IIiiHHI", raw[10:34])
    if bits not in (8, 24, 32) or packing not in (0, 3):
        raise ValueError("unsupported BMP variant")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        table = np.frombuffer(raw, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        image = table[rows]
        image = image[..., :1] if (image == image[..., :1]).all() else image
    else:
        image = rows.reshape(abs(height), width, bits // 8)[..., [2, 1, 0, 3][: bits // 8]]
    return image.transpose(2, 0, 1)[:, None].astype(np.float32), [999.0, 1.0, 1.0], UNIT


def read_gipl(raw: bytes) -> Decoded:
    if struct.unpack(">I", raw[252:256])[0] not in (0xEFFFE9B0, 0x2AE389B8):
        raise ValueError("not a GIPL file")
    x, y, z, _, kind = struct.unpack(">5H", raw[:10])
    spacing = [abs(float(s)) for s in struct.unpack(">3f", raw[10:22])][::-1]
    data = np.frombuffer(raw, ">" + GIPL_TYPES[kind], x * y * max(1, z), 256).reshape(max(1, z), y, x)
    return data.astype(np.float32), spacing, orientation.from_lps(spacing[::-1])


def write_png(image: np.ndarray) -> bytes:
    """(y, x) of 8 or 16 bits, unsigned."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    depth = 8 * image.dtype.itemsize
    lines = b"".join(b"\0" + row.astype(row.dtype.newbyteorder(">")).tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _words(values) -> str:
    return " ".join(f"{float(v):.17g}" for v in np.ravel(values))


def write_meta(volume: np.ndarray, spacing: list[float], affine: list[float] | None = None) -> bytes:
    kind = {"u1": "MET_UCHAR", "u2": "MET_USHORT", "i2": "MET_SHORT", "f4": "MET_FLOAT", "f8": "MET_DOUBLE"}[volume.dtype.str[1:]]
    place = ""
    if affine is not None:
        turn, origin = orientation.to_lps(affine)
        place = f"TransformMatrix = {_words(turn.T)}\nOffset = {_words(origin)}\n"
    text = f"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nCompressedData = False\n{place}DimSize = {' '.join(map(str, volume.shape[::-1]))}\nElementSpacing = {_words(spacing[::-1])}\nElementType = {kind}\nElementDataFile = LOCAL\n"
    return text.encode() + volume.astype(volume.dtype.newbyteorder("<")).tobytes()


def write_nrrd(volume: np.ndarray, spacing: list[float], affine: list[float] | None = None) -> bytes:
    kind = {"u1": "uint8", "u2": "uint16", "i2": "int16", "f4": "float", "f8": "double"}[volume.dtype.str[1:]]
    place = f"spacings: {_words(spacing[::-1])}\n"
    if affine is not None:
        turn, origin = orientation.to_lps(affine)
        point = lambda v: f"({_words(v).replace(' ', ',')})"
        place = f"space: left-posterior-superior\nspace directions: {' '.join(point(turn[:, k] * spacing[2 - k]) for k in range(3))}\nspace origin: {point(origin)}\n"
    text = f"NRRD0004\ntype: {kind}\ndimension: 3\nsizes: {' '.join(map(str, volume.shape[::-1]))}\n{place}endian: little\nencoding: raw\n\n"
    return text.encode() + volume.astype(volume.dtype.newbyteorder("<")).tobytes()


def label_type(labels: np.ndarray) -> np.ndarray:
    """8 bits unless a label needs 16."""
    return labels.astype(np.uint16 if labels.max(initial=0) >= 255 else np.uint8)


ENCODERS = {
    ".tif": lambda v, s, a: write_tiff(v), ".tiff": lambda v, s, a: write_tiff(v), ".mha": write_meta, ".nrrd": write_nrrd,
    ".png": lambda v, s, a: write_png(v[0]),
}


def encode_files(volumes: DataFrame, ending: str) -> DataFrame:
    """(case_id, name, content) of label volumes(case_id, shape, spacing, data); TIFF files get a side file with the spacing.

    MetaImage and NRRD files are placed in the world where volumes have an affine, and turned back
    onto the axes of their original_affine where they have one.
    """
    if ending not in ENCODERS:
        raise ValueError(f"no writer for {ending}")
    encode = ENCODERS[ending]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                volume, spacing = label_type(np.asarray(r.data).reshape([int(n) for n in r.shape][-3:])), [float(s) for s in r.spacing]
                affine = None if r.affine is None else list(r.affine)
                if r.original_affine is not None:
                    (volume, spacing), affine = orientation.from_ras(volume, spacing, list(r.original_affine)), list(r.original_affine)
                rows.append((r.case_id, f"{r.case_id}{ending}", encode(volume, spacing, affine)))
                if ending in (".tif", ".tiff"):
                    rows.append((r.case_id, f"{r.case_id}.json", json.dumps({"spacing": spacing}).encode()))
            yield pd.DataFrame(rows, columns=["case_id", "name", "content"])

    world = [(F.col(c) if c in volumes.columns else F.lit(None)).cast("array<double>").alias(c) for c in ("affine", "original_affine")]
    return volumes.select(F.col("case_id").cast("string"), "shape", "spacing", "data", *world).mapInPandas(run, "case_id string, name string, content binary")


def with_side_spacing(spark: SparkSession, volumes: DataFrame, folder: str, recursive: bool = False) -> DataFrame:
    """VOLUME rows; stacks of TIFF pages take the spacing of their JSON side files, (1, 1, 1) without one.

    A side file is named after the case: a file's name without its ending, or without its channel
    of five characters too, which goes first.
    """
    side = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    side = side.select(F.regexp_replace("path", r"\.json$", "").alias("_stem"), F.from_json(F.col("content").cast("string"), "spacing array<double>").alias("s")).select("_stem", F.col("s.spacing").alias("_spacing"))
    stem = F.when(F.lower("path").rlike(r"\.tiff?$") & (F.size("shape") == 3), F.regexp_replace("path", C.ENDINGS, ""))
    rows = volumes.withColumns({"_stem": stem, "_short": F.substring(stem, F.lit(1), F.length(stem) - 5)})
    short = side.select(F.col("_stem").alias("_short"), F.col("_spacing").alias("_first"))
    rows = rows.join(side, "_stem", "left").join(short, "_short", "left")
    return rows.withColumn("spacing", F.coalesce("_first", "_spacing", "spacing")).drop("_stem", "_short", "_spacing", "_first")
