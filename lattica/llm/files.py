"""Files in a folder that driver and executors share, by local path or by any URI that pyarrow's filesystems know."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Writes under another name and renames, so a retried or doubled task leaves one whole file."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(part, path)


def open_file(uri: str):
    """A seekable binary file object for reading."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
