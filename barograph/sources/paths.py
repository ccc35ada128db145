"""File systems of paths, for code that runs in Python on the driver or in tasks."""

from __future__ import annotations

import pyarrow.fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it. Spark writes local URIs with one slash or three; both are the same place."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path
