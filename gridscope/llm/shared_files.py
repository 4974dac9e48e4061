"""Plain binary files in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_file(path: str, data: bytes) -> None:
    """Write a file whole or not at all; a second attempt of the same task replaces it by the same bytes."""
    local = _local(path)
    if local is None:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(where), recursive=True)
        with system.open_output_stream(where) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, local)


def map_file(path: str, kind: np.dtype) -> np.ndarray:
    """A file as a memory-mapped array. From a remote store it is first copied into an unlinked file."""
    local = _local(path)
    if local is not None:
        return np.memmap(local, kind, "r") if os.path.getsize(local) else np.zeros(0, kind)
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    copy = tempfile.TemporaryFile()
    with system.open_input_stream(where) as data:
        while block := data.read(8 << 20):
            copy.write(block)
    copy.flush()
    return np.memmap(copy, kind, "r") if copy.tell() else np.zeros(0, kind)
