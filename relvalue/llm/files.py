"""Streams of bytes in the shared folder, for formats that Spark has no writer for.

Each task writes a file under a name of its own and reports it as a row. Only files in the
committed rows are read, so what a lost or repeated task left behind is never seen.
"""

from __future__ import annotations

import uuid


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and ":" in uri:  # Hadoop's short form, file:/folder
        scheme, _, rest = uri.partition(":")
        uri = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str):
    """A new file in ``folder``: its URI and an output stream."""
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)


def open_stream(uri: str):
    system, path = _filesystem(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)
