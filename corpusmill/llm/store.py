"""Shared storage for these operators: tables (see ``corpusmill.sources.storage``) and raw files."""

from __future__ import annotations

from corpusmill.sources.storage import discard, materialise, new_path, shared_dir

__all__ = ["discard", "file_system", "materialise", "new_path", "shared_dir"]


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI, for raw files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
