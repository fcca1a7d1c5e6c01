"""Binary files in the shared folder, written and read inside tasks.

Spark has no writer for raw bytes, so tasks open the shared store themselves
through pyarrow's file systems, which know local paths and the common stores by
URI. A task writes under a fresh name and reports it as a row; only names that
come back from finished tasks are ever read, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

from typing import Any

from pyarrow import fs


def open_store(uri: str) -> tuple[Any, str]:
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> Any:
    """A stream for a new file; its folder is made if need be."""
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


class RangeReader:
    """Reads ranges of one file."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def at(self, offset: int, length: int) -> bytes:
        if length <= 0:
            return b""
        got = self.file.read_at(length, offset)
        if len(got) != length:
            raise EOFError(f"{len(got)} of {length} bytes at {offset}")
        return bytes(got)

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
