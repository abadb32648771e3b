"""Files that tasks write to the shared folder: opened by URI, committed under a temporary name by a rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def commit(uri: str, write: Callable) -> None:
    """Calls write with an open stream of a temporary file, then renames it to the uri. A task that runs twice leaves one whole file; a write that fails leaves none."""
    system, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/_temporary-{name}-{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(part) as out:
            write(out)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type == fs.FileType.File:
            system.delete_file(part)
        raise


def open_file(uri: str):
    """Random access to the file; mapped into memory where it is local."""
    import pyarrow as pa

    system, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
