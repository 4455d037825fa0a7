"""Image files: NIfTI, MetaImage, NRRD, GIPL, TIFF, PNG and BMP, decoded and encoded without imaging libraries.

Files are read by Spark (binaryFile, any store), decoded one per row in Arrow functions, and come
out as typed volumes: shape and spacing in z, y, x order, float32 voxels in C order.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import columns as C
from voxelloom.sources import orientation
from voxelloom.sources.rasters import label_type, read_bmp, read_gipl, read_tiff

VOLUME = "path string, shape array<int>, spacing array<double>, affine array<double>, original_affine array<double>, data array<float>"
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
META_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NRRD_TYPES = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "int": "i4", "int32": "i4", "uint32": "u4", "float": "f4", "double": "f8"}


def read_nifti(raw: bytes) -> tuple[np.ndarray, list[float], list[float]]:
    """(array in z, y, x, spacing, affine of 12 numbers)."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(end + "i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack(end + "8h", raw[40:56])
    kind = np.dtype(end + NIFTI_TYPES[struct.unpack(end + "h", raw[70:72])[0]])
    zooms = struct.unpack(end + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(end + "3f", raw[108:120])
    shape = [max(1, n) for n in dims[1 : 1 + dims[0]]]
    if any(n != 1 for n in shape[3:]):
        raise ValueError("only volumes of three dimensions are read")
    shape = (shape + [1, 1, 1])[:3]
    data = np.frombuffer(raw, kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(np.float32)
    if slope not in (0.0, 1.0) or inter:
        data = data * np.float32(slope or 1.0) + np.float32(inter)
    sform = struct.unpack(end + "h", raw[254:256])[0]
    affine = np.array(struct.unpack(end + "12f", raw[280:328]) if sform else [zooms[1], 0, 0, 0, 0, zooms[2], 0, 0, 0, 0, zooms[3], 0], float).reshape(3, 4)
    spacing = [float(z) for z in zooms[1:4]]
    return np.ascontiguousarray(data.transpose(2, 1, 0)), spacing[::-1], affine.ravel().tolist()


def write_nifti(data: np.ndarray, spacing: list[float], affine: list[float] | None = None, compress: bool = True) -> bytes:
    """data in z, y, x; spacing likewise."""
    code, kind = next((c, k) for c, k in NIFTI_TYPES.items() if np.dtype("<" + k) == data.dtype.newbyteorder("<"))
    zooms = [float(s) for s in spacing[::-1]]
    affine = affine or [zooms[0], 0, 0, 0, 0, zooms[1], 0, 0, 0, 0, zooms[2], 0]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *data.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * np.dtype(kind).itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *zooms, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.astype("<" + kind).tobytes()  # x runs fastest in both
    return gzip.compress(raw, mtime=0) if compress else raw


def write_nifti_like(data: np.ndarray, reference: bytes) -> bytes:
    """data (z, y, x) as 32-bit floats under the header of another NIfTI file: its affines, codes and texts stay."""
    raw = gzip.decompress(reference) if reference[:2] == b"\x1f\x8b" else reference
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    head = bytearray(raw[:348]) + bytes(4)
    struct.pack_into(end + "8h", head, 40, 3, *data.shape[::-1], 1, 1, 1, 1)
    struct.pack_into(end + "2h", head, 70, 16, 32)
    struct.pack_into(end + "3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + data.astype(end + "f4").tobytes(), mtime=0)


def read_meta(raw: bytes) -> tuple[np.ndarray, list[float], list[float]]:
    head, pos = {}, 0
    while True:
        line_end = raw.index(b"\n", pos)
        key, _, value = raw[pos:line_end].decode("ascii", "replace").partition("=")
        head[key.strip()], pos = value.strip(), line_end + 1
        if key.strip() == "ElementDataFile":
            break
    if head["ElementDataFile"] != "LOCAL":
        raise ValueError("only MetaImage files that hold their data are read")
    body = raw[pos:]
    if head.get("CompressedData", "False").lower() == "true":
        body = zlib.decompress(body)
    shape = [int(n) for n in head["DimSize"].split()]
    kind = (">" if head.get("BinaryDataByteOrderMSB", "False").lower() == "true" else "<") + META_TYPES[head["ElementType"]]
    numbers = lambda *keys: next(([float(v) for v in head[k].split()] for k in keys if k in head), None)
    spacing = numbers("ElementSpacing", "ElementSize") or [1.0] * len(shape)
    turn = numbers("TransformMatrix", "Orientation", "Rotation")  # one axis after the other
    return _zyx(np.frombuffer(body, kind, int(np.prod(shape))), shape, spacing, np.array(turn).reshape(len(shape), -1).T if turn else None, numbers("Offset", "Position", "Origin"))


def read_nrrd(raw: bytes) -> tuple[np.ndarray, list[float], list[float]]:
    head_end = re.search(rb"\r?\n\r?\n", raw)
    if not raw.startswith(b"NRRD") or not head_end:
        raise ValueError("not an NRRD file")
    head = dict(m.groups() for m in re.finditer(r"(?m)^([a-z ]+):\s*(.*?)\r?$", raw[: head_end.start()].decode("ascii", "replace")))
    body = raw[head_end.end() :]
    if head.get("encoding", "raw") in ("gzip", "gz"):
        body = gzip.decompress(body)
    shape = [int(n) for n in head["sizes"].split()]
    kind = (">" if head.get("endian") == "big" else "<") + NRRD_TYPES[head["type"]]
    vectors = lambda key: np.array([[float(x) for x in v.split(",")] for v in re.findall(r"\(([^)]*)\)", head.get(key, ""))])
    cols, origin = vectors("space directions").T, vectors("space origin").ravel()
    signs = np.ones(cols.shape[0] or 3)
    space = head.get("space", "").lower()
    if space.startswith(("right", "ra")):  # the other two spaces count towards left
        signs[0] = -1
    if "anterior" in space or space in ("ras", "las"):
        signs[1] = -1
    if cols.size:
        spacing = np.linalg.norm(cols, axis=0).tolist()
        turn = cols * signs[:, None] / np.maximum(np.linalg.norm(cols, axis=0), 1e-12)
    else:
        spacing, turn = [float(s) for s in head.get("spacings", "1 " * len(shape)).split()], None
    return _zyx(np.frombuffer(body, kind, int(np.prod(shape))), shape, spacing, turn, (origin * signs).tolist() if origin.size else None)


def _zyx(flat: np.ndarray, shape: list[int], spacing: list[float], turn: np.ndarray | None = None, origin: list[float] | None = None) -> tuple[np.ndarray, list[float], list[float]]:
    """Two dimensions become one slice, far from others; a fourth one is channels. turn and origin count towards left and posterior."""
    data = flat.reshape(shape[::-1]).astype(np.float32)
    if data.ndim not in (2, 3, 4) or len(spacing) != data.ndim:
        raise ValueError("only two to four dimensions are read")
    n = min(data.ndim, 3)
    affine = orientation.from_lps([abs(s) for s in spacing[:n]], None if turn is None else turn[:n, :n], origin)
    spacing = [abs(s) for s in spacing[:n][::-1]]
    if n == 2:
        data, spacing = data[None], [max(spacing) * 999, *spacing]
        affine[10] = spacing[0]
    return data, spacing, affine


def read_png(raw: bytes) -> tuple[np.ndarray, list[float], list[float]]:
    """Gray or colour PNG of 8 or 16 bits, not interlaced: channels as (C, 1, Y, X)."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    pos, packed = 8, b""
    width = height = depth = colour = 0
    while pos < len(raw):
        n, kind = struct.unpack(">I4s", raw[pos : pos + 8])
        chunk, pos = raw[pos + 8 : pos + 8 + n], pos + 12 + n
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if depth not in (8, 16) or colour not in (0, 2, 4, 6) or interlaced:
                raise ValueError("unsupported PNG variant")
        elif kind == b"IDAT":
            packed += chunk
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width * step), np.uint8)
    for y, line in enumerate(lines):
        out[y + 1] = _unfilter(int(line[0]), line[1:], out[y], step)
    image = out[1:].reshape(height, width, channels, depth // 8)
    data = image[..., 0] if depth == 8 else image[..., 0].astype(np.uint16) * 256 + image[..., 1]
    return data.transpose(2, 0, 1)[:, None].astype(np.float32), [999.0, 1.0, 1.0], [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 999, 0]


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    out = line.astype(np.int64)
    above = up.astype(np.int64)
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        corner = above[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + above[i]) // 2
        else:
            p = left + above[i] - corner
            guess = min((left, above[i], corner), key=lambda c, p=p: abs(p - c))
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


DECODERS = {".nii.gz": read_nifti, ".nii": read_nifti, ".mha": read_meta, ".nrrd": read_nrrd, ".png": read_png, ".gipl": read_gipl, ".tiff": read_tiff, ".tif": read_tiff, ".bmp": read_bmp}


def decode(name: str, raw: bytes, to_ras: bool = False) -> tuple[np.ndarray, list[float], list[float]]:
    for ending, reader in DECODERS.items():
        if name.lower().endswith(ending):
            found = reader(raw)
            return orientation.to_ras(*found) if to_ras else found
    raise ValueError(f"no reader for {name}")


def read_volumes(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, to_ras: bool = False, reader=None) -> DataFrame:
    """VOLUME rows of the image files in a folder, read by ending or by a `readers.Reader`; other files are left out.

    With `to_ras`, or a reader that turns, axes go towards right, anterior and superior.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    read, turn = (reader.read, to_ras or reader.turns) if reader else (decode, to_ras)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                data, spacing, original = read(path, raw)
                affine = original
                if turn:
                    data, spacing, affine = orientation.to_ras(data, spacing, original)
                yield pd.DataFrame({"path": [path], "shape": [list(data.shape)], "spacing": [spacing], "affine": [[float(a) for a in affine]], "original_affine": [[float(a) for a in original]], "data": [data.ravel()]})

    return files.select("path", "content").where(F.lower("path").rlike(C.endings(reader.endings) if reader else C.ENDINGS)).mapInPandas(run, VOLUME)


def encode_labels(volumes: DataFrame) -> DataFrame:
    """(case_id, content): label volumes(case_id, shape, spacing, affine, data) as NIfTI bytes, 8 bits unless a label needs 16.

    Volumes with an original_affine are turned back onto its axes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                data, spacing, affine = np.asarray(r.data).reshape(list(r.shape)), list(r.spacing), list(r.affine)
                if r.original_affine is not None:
                    (data, spacing), affine = orientation.from_ras(data, spacing, list(r.original_affine)), list(r.original_affine)
                out.append(write_nifti(label_type(data), spacing, affine))
            yield pd.DataFrame({"case_id": pdf["case_id"], "content": out})

    back = F.col("original_affine") if "original_affine" in volumes.columns else F.lit(None)
    return volumes.select(F.col("case_id").cast("string"), "shape", "spacing", "affine", "data", back.cast("array<double>").alias("original_affine")).mapInPandas(run, "case_id string, content binary")


def encode_like(volumes: DataFrame, references: DataFrame) -> DataFrame:
    """(case_id, content): the first channel of volumes(case_id, shape, data) under the header of references(case_id, content), NIfTI files."""
    rows = volumes.select(F.col("case_id").cast("string"), "shape", "data").join(references.select(F.col("case_id").cast("string"), "content"), "case_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                size = [int(n) for n in r.shape][-3:]
                out.append(write_nifti_like(np.asarray(r.data)[: int(np.prod(size))].reshape(size), r.content))
            yield pd.DataFrame({"case_id": pdf["case_id"], "content": out})

    return rows.mapInPandas(run, "case_id string, content binary")
