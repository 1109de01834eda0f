"""Flat arrays in files of the shared folder: tasks write a part each, workers map them into memory.

A part is written under a name of its own try and then moved, so repeated and speculative tasks do no harm. In a folder
that is mounted (``file://``) parts are mapped where they lie; from another store a worker copies a part once, maps the
copy and unlinks it, so that nothing stays behind.

Defined cases: an empty array makes an empty file, which maps to an empty array; a part that is written again replaces the
first one whole; keys may repeat among the lists that are merged, whose counts add up, and of no lists or empty ones the
result is empty; a part that isn't there raises.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pfs


def _store(path: str) -> tuple[pfs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pfs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pfs.FileSystem.from_uri(path)


def write_part(folder: str, name: str, array: np.ndarray) -> None:
    store, at = _store(f"{folder}/{name}")
    store.create_dir(os.path.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data if len(array) else b"")
    store.move(own, at)


def map_part(folder: str, name: str, dtype) -> np.ndarray:
    store, at = _store(f"{folder}/{name}")
    dtype = np.dtype(dtype)
    if isinstance(store, pfs.LocalFileSystem):
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.empty(0, dtype)
    found = store.get_file_info(at)
    if found.type != pfs.FileType.File:
        raise FileNotFoundError(f"{folder}/{name}")
    if not found.size:
        return np.empty(0, dtype)
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(at) as source:
            shutil.copyfileobj(source, copy)
        copy.flush()
        return np.memmap(copy.name, dtype, "r")


def planes(sorted_values: np.ndarray) -> bytes:
    """Differences of ascending values, their bytes by significance, so that the shuffle's compression finds the zeros."""
    steps = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    width = steps.dtype.itemsize
    return steps.view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    steps = np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(dtype).reshape(-1), dtype=dtype)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their summed counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often each occurs; sorts keys in place."""
    keys.sort()
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))
