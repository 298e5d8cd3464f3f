"""Tables and arrays that are written once and read again, below the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new URI below ``spark.checkpoint.dir``; in local mode, where none is set, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        _made.append(shared)
    uri = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(uri)
    return uri


@atexit.register
def _remove() -> None:
    for uri in _made:
        if uri.startswith(("file:", "/")):
            shutil.rmtree("/" + uri.removeprefix("file:").lstrip("/"), ignore_errors=True)
        else:
            with contextlib.suppress(Exception):  # the store may be gone before this process ends
                from pyarrow import fs

                store, at = fs.FileSystem.from_uri(uri)
                store.delete_dir(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet and read it back."""
    uri = fresh_folder(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Every file below the paths with its time and length, and the application that looked: the same as long
    as nothing is rewritten."""
    jvm, seen = spark._jvm, []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return spark.sparkContext.applicationId, spark.sparkContext.startTime, *sorted(seen)


def _mounted(uri: str) -> str | None:
    """The path of a URI that this machine mounts, or None."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith(("file:", "/")) else None


def put_array(uri: str, name: str, values: np.ndarray) -> None:
    """Write an array below ``uri``, whole or not at all; a task that runs again leaves the same one."""
    raw = np.ascontiguousarray(values)
    folder = _mounted(uri)
    if folder:
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        raw.tofile(part)
        os.replace(part, f"{folder}/{name}")
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(raw.tobytes())
    store.move(part, f"{at}/{name}")


#: Arrays that a worker holds, mapped or read; the oldest goes first.
MOST_MAPPED = 512
_mapped: dict[tuple[str, str], np.ndarray] = {}


def mapped(uri: str, name: str, dtype) -> np.ndarray:
    """An array written by ``put_array``: memory-mapped where its folder is mounted, else read once."""
    key = (uri, name)
    if key not in _mapped:
        while len(_mapped) >= MOST_MAPPED:
            _mapped.pop(next(iter(_mapped)))
        folder = _mounted(uri)
        if folder:
            path = f"{folder}/{name}"
            _mapped[key] = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        else:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(f"{at}/{name}") as src:
                _mapped[key] = np.frombuffer(src.read(), dtype)
    return _mapped[key]
