"""Files that executors write and read in the shared folder, by pyarrow's file systems (local, HDFS, S3, GCS).

A task writes under names of its own and returns them; only names in a committed Parquet manifest count, so a task that
runs twice, or whose executor is lost, leaves at most an unused file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def make(uri: str) -> str:
    system, path = folder(uri)
    system.create_dir(path, recursive=True)
    return uri


def create(uri: str, suffix: str):
    """A new file's stream and its name."""
    system, path = folder(uri)
    name = uuid.uuid4().hex + suffix
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}"), name


def stream(uri: str, name: str):
    system, path = folder(uri)
    return system.open_input_stream(f"{path}/{name}")


def random(uri: str, name: str):
    system, path = folder(uri)
    return system.open_input_file(f"{path}/{name}")
