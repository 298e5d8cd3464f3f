"""Matrices in SafeTensors files, read by row ranges and written by tasks, and checksums of files.

A file begins with eight bytes, the length of its JSON header, which names each tensor's type,
shape and place in the bytes behind it. Files are opened by the machine that reads them; a
path is a mounted one or a URI that Arrow's file systems know.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Element types by name. BF16 is the upper half of F32.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "<u1"}
WIDTHS = {**{t: np.dtype(d).itemsize for t, d in TYPES.items()}, "BF16": 2}
#: Longest header, bytes that one partition reads, rows of a batch, bytes hashed at a time.
MOST_HEADER, PARTITION_BYTES, BATCH_ROWS, CHUNK = 100_000_000, 32 << 20, 4096, 8 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def files_below(path: str) -> list[str]:
    """The file itself, or the ``.safetensors`` files in a folder, by name."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = path.removesuffix("/")
    if info.type == fs.FileType.File:
        return [path]
    return [f"{base}/{f.base_name}" for f in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda f: f.base_name) if f.base_name.endswith(".safetensors")]


def header_of(path: str) -> tuple[dict, int]:
    """The checked header of a file, and where its tensors' bytes begin.

    Tensors must have known types, as many bytes as their shape asks for, and follow one another from the
    first byte to the last, without gaps or overlaps.
    """
    store, at = _store(path)
    with store.open_input_file(at) as src:
        whole = src.size()
        if whole < 8:
            raise ValueError(f"{path}: too short for a header")
        (length,) = struct.unpack("<Q", src.read_at(8, 0))
        if length > min(MOST_HEADER, whole - 8):
            raise ValueError(f"{path}: the header's length is {length}")
        try:
            header = json.loads(src.read_at(length, 8))
        except ValueError:
            raise ValueError(f"{path}: the header is no JSON") from None
    if not isinstance(header, dict):
        raise ValueError(f"{path}: the header is no object")
    end = 0
    tensors = {k: v for k, v in header.items() if k != "__metadata__"}
    for name, t in sorted(tensors.items(), key=lambda kv: kv[1]["data_offsets"]):
        lo, hi = t["data_offsets"]
        if t["dtype"] not in WIDTHS:
            raise ValueError(f"{path}: {name} has the unknown type {t['dtype']}")
        if lo != end or hi - lo != prod(t["shape"]) * WIDTHS[t["dtype"]]:
            raise ValueError(f"{path}: {name} is not where and as long as it should be")
        end = hi
    if 8 + length + end != whole:
        raise ValueError(f"{path}: {whole - 8 - length - end} bytes belong to no tensor")
    return header, 8 + length


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tensor = options["path"], options["tensor"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.finite = str(options.get("finite", "true")).lower() == "true"

    def _shape(self, path: str) -> tuple[dict, int, int, int]:
        header, start = header_of(path)
        if self.tensor not in header:
            raise ValueError(f"{path} has no tensor {self.tensor}")
        t = header[self.tensor]
        if not 1 <= len(t["shape"]) <= 2:
            raise ValueError(f"{path}: {self.tensor} has {len(t['shape'])} dimensions")
        return t, start + t["data_offsets"][0], t["shape"][0], t["shape"][1] if len(t["shape"]) == 2 else 1

    def partitions(self) -> list[Rows]:
        out = []
        for path in files_below(self.path):
            t, _, rows, width = self._shape(path)
            step = max(1, self.bytes // max(1, width * WIDTHS[t["dtype"]]))
            out += [Rows(path, lo, min(rows, lo + step)) for lo in range(0, rows, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows):
        if not partition.path:
            return
        t, start, _, width = self._shape(partition.path)
        size = width * WIDTHS[t["dtype"]]
        store, at = _store(partition.path)
        with store.open_input_file(at) as src:
            for lo in range(partition.first, partition.last, BATCH_ROWS):
                hi = min(partition.last, lo + BATCH_ROWS)
                raw = src.read_at((hi - lo) * size, start + lo * size)
                if t["dtype"] == "BF16":
                    values = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(np.float64)
                else:
                    values = np.frombuffer(raw, TYPES[t["dtype"]]).astype(np.float64)
                if self.finite and not np.isfinite(values).all():
                    raise ValueError(f"{partition.path}: {self.tensor} has values that are not finite in rows {lo} to {hi - 1}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * width, max(1, width), dtype=np.int32)[: hi - lo + 1] if width else np.zeros(hi - lo + 1, np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (hi - lo)), pa.array(np.arange(lo, hi)), lists], names=["file", "row", "values"])


class SafeTensors(DataSource):
    """``spark.read.format("safetensors").option("tensor", name).load(path)``: (file, row, values) of one tensor.

    Values come as doubles (64-bit integers beyond 2**53 are rounded). ``finite`` = false admits infinities and NaN. A vector is a matrix of one
    column. ``partitionbytes`` bounds what a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_safetensors(spark: SparkSession, path: str, tensor: str, **options) -> DataFrame:
    spark.dataSource.register(SafeTensors)
    reader = spark.read.format("safetensors").option("tensor", tensor)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def write_file(path: str, tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> None:
    """One file of arrays, under its name only when it is whole."""
    names = {np.dtype(d): t for t, d in TYPES.items()}
    header, at = ({"__metadata__": metadata} if metadata else {}), 0
    for name, a in tensors.items():
        header[name] = {"dtype": names[a.dtype.newbyteorder("<")], "shape": list(a.shape), "data_offsets": [at, at + a.nbytes]}
        at += a.nbytes
    text = json.dumps(header).encode()
    store, to = _store(path)
    store.create_dir(to.rsplit("/", 1)[0], recursive=True)
    part = f"{to}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(struct.pack("<Q", len(text)) + text)
        for a in tensors.values():
            out.write(np.ascontiguousarray(a).tobytes())
    store.move(part, to)


def write_safetensors(df: DataFrame, uri: str, id_col: str, vector_col: str, most_rows: int = 65_536) -> int:
    """Write vectors as tensors ``ids`` and ``matrix`` (F32) of one file per task and ``most_rows`` rows; the number of files.

    Rows with a null id or vector are left out; vectors of other lengths than their file's first are an error.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id is not null and v is not null")

    def write(batches):
        from pyspark import TaskContext

        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def end():
            ids = np.concatenate([b["id"].to_numpy() for b in held])
            flat = [b["v"].flatten().to_numpy(zero_copy_only=False) for b in held]
            matrix = np.concatenate(flat).astype("<f4").reshape(len(ids), -1)
            widths = np.unique(np.concatenate([np.diff(b["v"].offsets.to_numpy()) for b in held]))
            if len(widths) > 1:
                raise ValueError(f"vectors of {widths.tolist()} numbers in one file")
            write_file(f"{uri}/part-{task:05d}-{count:05d}.safetensors", {"ids": ids.astype("<i8"), "matrix": matrix})

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most_rows:
                end()
                count, held, size = count + 1, [], 0
        if size:
            end()
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["files"])

    return rows.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def file_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of stated files, each read in chunks by one task."""
    def digest(batches):
        for batch in batches:
            out = []
            for path in batch["path"].to_pylist():
                store, at = _store(path)
                made, size = hashlib.sha256(), 0
                with store.open_input_file(at) as src:
                    while chunk := src.read(CHUNK):
                        made.update(chunk)
                        size += len(chunk)
                out.append((path, size, made.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "sha256"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1024)), "path")
    return listed.mapInArrow(digest, "path string, bytes long, sha256 string")


def verified(found: DataFrame, pins: DataFrame) -> DataFrame:
    """The pinned files as they were found; a missing file or another checksum is an error that names the first few."""
    wrong = pins.join(found.select("path", F.col("sha256").alias("is")), "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("is"))).orderBy("path").limit(5).collect()
    if wrong:
        raise ValueError("checksums differ: " + ", ".join(r.path for r in wrong))
    return found.join(pins.select("path"), "path", "left_semi")
