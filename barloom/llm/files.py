"""Plain files in the shared folder, written and memory-mapped by tasks."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after the other."""
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path))
    with system.open_output_stream(path) as out:
        for x in arrays:
            out.write(np.ascontiguousarray(x))


@contextmanager
def local(uri: str) -> Iterator[str]:
    """A path that can be memory-mapped: the shared file itself, or a copy while it is used where the store has no paths."""
    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        yield path
        return
    folder = tempfile.mkdtemp()
    try:
        copy = os.path.join(folder, os.path.basename(path))
        fs.copy_files(path, copy, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        yield copy
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def mapped(path: str, kind: str, count: int, offset: int = 0) -> np.ndarray:
    """``count`` values of a file, memory-mapped; an empty file can't be mapped."""
    return np.memmap(path, kind, "r", offset, (count,)) if count else np.zeros(0, kind)
