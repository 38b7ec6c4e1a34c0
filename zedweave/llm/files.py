"""Files in the shared folder, written and read by Python workers on any store that pyarrow opens."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = at(uri)
    store.create_dir(path, recursive=True)


def open_write(uri: str):
    store, path = at(uri)
    return store.open_output_stream(path)


def open_read(uri: str):
    """A stream, from the beginning."""
    store, path = at(uri)
    return store.open_input_stream(path)


def local(uri: str) -> str | None:
    """The path, if the file can be memory-mapped."""
    store, path = at(uri)
    return path if isinstance(store, fs.LocalFileSystem) else None
