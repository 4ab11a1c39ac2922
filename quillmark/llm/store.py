"""Sorted arrays in the shared folder: written by tasks, memory-mapped by workers.

Readers know from the model's list of shards which arrays exist, so an array that
cannot be read is an error and fails the task.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np


def _local(path: str) -> str | None:
    """The path on the file system, if the place is one."""
    parts = urlparse(path)
    return parts.path if parts.scheme in ("", "file") else None


def save(path: str, **arrays: np.ndarray) -> None:
    """Writes ``path``-<name>.npy for each array; a later attempt replaces an earlier one whole."""
    for name, values in arrays.items():
        place = f"{path}-{name}.npy"
        if local := _local(place):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            part = f"{local}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as out:
                np.save(out, values)
            os.replace(part, local)
        else:
            from pyarrow import fs

            store, inside = fs.FileSystem.from_uri(place)
            store.create_dir(os.path.dirname(inside), recursive=True)
            part = f"{inside}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                np.save(out, values)
            store.move(part, inside)


#: Bytes of arrays that a worker keeps copied or read at once, and files that it keeps mapped.
KEPT_BYTES, KEPT_FILES = 64 << 20, 2048
_kept: OrderedDict[str, np.ndarray] = OrderedDict()
_held = 0


def _own(array: np.ndarray) -> int:
    """Bytes of an array that is not mapped."""
    return 0 if isinstance(array, np.memmap) else array.nbytes


def forget() -> None:
    """Drops all arrays that this worker holds."""
    global _held
    _kept.clear()
    _held = 0


def load(path: str, name: str) -> np.ndarray:
    """The array, memory-mapped; from a store without paths it is read into memory.

    A worker keeps what it used last: mapped files by their number, arrays in
    memory by their bytes.
    """
    global _held
    place = f"{path}-{name}.npy"
    if place in _kept:
        _kept.move_to_end(place)
        return _kept[place]
    local = _local(place)
    if local is None:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(place)
        with store.open_input_file(inside) as source:
            array = np.load(source)
    else:
        array = np.load(local, mmap_mode="r") if os.path.getsize(local) > 4096 else np.load(local)
    _kept[place] = array
    _held += _own(array)
    while len(_kept) > KEPT_FILES or _held > KEPT_BYTES and len(_kept) > 1:
        _held -= _own(_kept.popitem(last=False)[1])
    return array


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there.

    Ascending ``wanted`` keeps the look-ups close together.
    """
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
