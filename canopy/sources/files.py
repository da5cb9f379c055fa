"""Files by path or URI, local or in a store that pyarrow's filesystems reach (file, hdfs, s3, gs)."""

from __future__ import annotations

import fnmatch
import posixpath
import re
from typing import IO

from pyarrow import fs

_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path and the path in it; file:/x and file:///x are local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if _SCHEME.match(path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def find(pattern: str) -> list[str]:
    """The files that match, sorted; wildcards stand in the last part only, and missing files match nothing."""
    store, path = resolve(pattern)
    folder, name = posixpath.split(path)
    prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return sorted(prefix + posixpath.join(folder, f.base_name) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name))


def size(path: str) -> int:
    store, inside = resolve(path)
    return store.get_file_info(inside).size


def exists(path: str) -> bool:
    store, inside = resolve(path)
    return store.get_file_info(inside).type == fs.FileType.File


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """A range of a file's bytes, fewer where it ends."""
    store, inside = resolve(path)
    with store.open_input_file(inside) as f:
        f.seek(offset)
        return f.read(length)


def create(path: str) -> IO[bytes]:
    """A new file to write; its folder is made where it is missing."""
    store, inside = resolve(path)
    if posixpath.dirname(inside):
        store.create_dir(posixpath.dirname(inside), recursive=True)
    return store.open_output_stream(inside)
