"""Binary files in a folder that all executors share, written and read inside tasks.

A task writes under a name of its own and reports it in its rows, so what a lost or repeated task
wrote is never read: readers take names from reports that Spark has committed.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _located(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pafs.FileSystem.from_uri(f"{'s3' if scheme.startswith('s3') else scheme}:{rest}")
    return pafs.LocalFileSystem(), folder


def create(folder: str, suffix: str):
    """(name, stream) of a new file."""
    system, path = _located(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return name, system.open_output_stream(f"{path}/{name}", compression=None)


def write(folder: str, name: str, data: bytes) -> None:
    system, path = _located(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)


def opened(folder: str, name: str):
    system, path = _located(folder)
    return system.open_input_file(f"{path}/{name}")
