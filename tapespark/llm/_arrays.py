"""Files of named numpy arrays in the shared folder, written whole by tasks and memory-mapped by workers."""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np

#: The files that a worker has open, least used first: a process may map only so many.
MOST_OPEN = 2048
_open: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write all arrays to one file; the name appears only when the file is whole, so a repeated task is harmless."""
    head, at = [], 0
    for name, x in arrays.items():
        head.append([name, x.dtype.str, len(x), at])
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)

    def put(out) -> None:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes())
            out.write(b"\0" * (-x.nbytes % 64))

    path, part = _local(uri), f".{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + part, "wb") as out:
            put(out)
        os.replace(path + part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path + part) as out:
        put(out)
    store.move(path + part, path)


def map_arrays(uri: str) -> dict[str, np.ndarray] | None:
    """The arrays of one file, memory-mapped; of a store that is not mounted, read into memory. None if there is no such file."""
    if uri in _open:
        _open.move_to_end(uri)
        return _open[uri]
    while len(_open) >= MOST_OPEN:
        _open.popitem(last=False)
    path, raw = _local(uri), None
    if path is not None:
        raw = np.memmap(path, np.uint8, "r") if os.path.exists(path) else None
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_stream(path) as source:
                raw = np.frombuffer(source.read(), np.uint8)
    if raw is None:
        _open[uri] = None
        return None
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = 8 + size
    _open[uri] = {name: raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in json.loads(raw[8:base].tobytes())}
    return _open[uri]
