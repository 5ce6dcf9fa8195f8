"""Tables and files that the driver and all executors must see.

They live in the folder that motifloom.sources.shared finds: always a whole URI.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from motifloom.sources.shared import shared_path as shared_dir, stored

__all__ = ["filesystem", "local_copy", "put_file", "shared_dir", "shuffle_partitions", "stored"]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, usable on the driver and in Python workers."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: under another name first, then renamed."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def local_copy(uri: str) -> str:
    """A path that this process can map into memory.

    Files of a shared folder that is mounted are used in place; those of an object store
    are fetched once into the worker's own temporary folder.
    """
    system, path = filesystem(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return path
    own = os.path.join(tempfile.gettempdir(), uuid.uuid5(uuid.NAMESPACE_URL, uri).hex)
    if not os.path.exists(own):
        part = f"{own}.{uuid.uuid4().hex}"
        with system.open_input_stream(path) as src, open(part, "wb") as dst:
            while block := src.read(1 << 24):
                dst.write(block)
        os.replace(part, own)
    return own


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
