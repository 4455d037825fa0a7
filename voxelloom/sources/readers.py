"""Readers by name, by file ending and as a data set description asks; users may add their own.

A reader is a function of one file: (name, content) to (array, spacing, affine). Spark lists the
files and runs it on the executors, so a reader of one's own must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from voxelloom.sources import images

#: The names that a description may give, and the readers they stand for.
DESCRIBED = {"NaturalImage2DIO": "natural_2d", "SimpleITKIO": "simpleitk", "Tiff3DIO": "tiff3d", "NibabelIO": "nibabel", "NibabelIOWithReorient": "nibabel_reorient"}


@dataclass(frozen=True)
class Reader:
    name: str
    endings: tuple[str, ...]
    read: Callable[[str, bytes], tuple[np.ndarray, list[float], list[float]]]
    turns: bool = False

    def takes(self, name: str) -> bool:
        return name.lower().endswith(self.endings)


def picture(name: str, raw: bytes):
    """A single picture, gray or of three or four channels."""
    data, spacing, affine = images.decode(name, raw)
    if data.ndim != 4 or data.shape[1] != 1 or len(data) not in (1, 3, 4):
        raise ValueError(f"{name} is not a picture")
    return data, spacing, affine


def stack(name: str, raw: bytes):
    """A file of several pages."""
    data, spacing, affine = images.decode(name, raw)
    if data.ndim != 3:
        raise ValueError(f"{name} is not a volume")
    return data, spacing, affine


READERS = {
    r.name: r
    for r in (
        Reader("natural_2d", (".png", ".bmp", ".tif"), picture),
        Reader("simpleitk", (".nii.gz", ".nrrd", ".mha", ".gipl"), images.decode),
        Reader("tiff3d", (".tif", ".tiff"), stack),
        Reader("nibabel", (".nii", ".nii.gz"), images.decode),
        Reader("nibabel_reorient", (".nii", ".nii.gz"), images.decode, turns=True),
        Reader("simpleitk_reorient", (".nii.gz", ".nrrd", ".mha", ".gipl"), images.decode, turns=True),
    )
}


def register(reader: Reader) -> Reader:
    """Make a reader known by its name."""
    if reader.name in ("auto", *READERS):
        raise ValueError(f"there is a reader {reader.name!r} already")
    READERS[reader.name] = reader
    return reader


def named(reader: str | Reader | None) -> Reader | None:
    """A reader by its name; none for "auto", which goes by the ending of each file."""
    if reader in (None, "auto"):
        return None
    if isinstance(reader, Reader):
        return reader
    if reader not in READERS:
        raise ValueError(f"reader is auto or one of {', '.join(READERS)}")
    return READERS[reader]


def by_ending(ending: str, example: tuple[str, bytes] | None = None, nonmatching: bool = False) -> Reader:
    """The first reader that takes the ending and, given an example (name, content), can open it.

    `nonmatching` lets readers of other endings try the example too.
    """
    for name in DESCRIBED.values():
        reader = READERS[name]
        if ending.lower() not in reader.endings and not (nonmatching and example):
            continue
        if example is None:
            return reader
        try:
            reader.read(*example)
        except Exception:  # whatever a decoder meets in a file that is not its own
            continue
        return reader
    raise ValueError(f"no reader for {ending}" + (f" can open {example[0]}" if example else ""))


def by_description(dataset: dict, example: tuple[str, bytes] | None = None, nonmatching: bool = False) -> Reader:
    """The reader that a description names in overwrite_image_reader_writer, else the one of its file_ending."""
    asked = dataset.get("overwrite_image_reader_writer", "None")
    return READERS[DESCRIBED[asked]] if asked in DESCRIBED else by_ending(dataset["file_ending"], example, nonmatching)
