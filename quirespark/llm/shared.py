"""Files and tables that all executors reach: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from quirespark.scratch import base_dir, new_dir, removed, written

__all__ = ["base_dir", "bounded_batches", "local_path", "mapped", "new_dir", "removed", "write_whole", "written"]


#: Rows of an Arrow batch that goes to Python: ten thousand long texts, the default, can be gigabytes.
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def local_path(uri: str) -> str | None:
    """The POSIX path of a URI that names one, else None."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data) -> None:
    """Writes a file under a name of its own, then renames it, so that no reader sees a part of it."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    store, key = _remote(uri)
    store.create_dir(os.path.dirname(key), recursive=True)
    part = f"{key}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, key)


def mapped(uri: str, dtype: str):
    """A file as a flat array, memory-mapped where the store is a file system, else read."""
    import numpy as np

    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    store, key = _remote(uri)
    with store.open_input_file(key) as f:
        return np.frombuffer(f.read(), dtype=dtype)
