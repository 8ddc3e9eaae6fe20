"""Array and image files as Spark jobs: large .npy files are read by row ranges, tables are written as .npy and .png files.

File bytes go through ``pyarrow.fs``, which opens local and shared folders and the common object stores
by their URI. A .npy file of any size is read by many tasks: its header says where each row of the first
axis lies, so a file becomes a table of ranges, and a range a read of its own bytes.
"""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = "path string, sample_id long, shape array<int>, pixels array<float>, error string"
#: Bytes of a range, and of a file that is still read whole.
RANGE, WHOLE = 32 << 20, 64 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    plain = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), plain) if plain.startswith("/") else pafs.FileSystem.from_uri(path)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``SAMPLES``."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "sample_id", "shape", "pixels", "error"])


def _header(file) -> tuple[tuple, bool, np.dtype, int]:
    """(shape, column-major, type, where the body begins) of an open .npy file."""
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, fortran, dtype, file.tell()


def array_ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, first, rows, at, dtype, shape, error) of .npy files (path): ranges of at most ``size`` bytes (or one row) of the first axis."""

    def plan(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    system, plain = opened(path)
                    with system.open_input_file(plain) as file:
                        shape, fortran, dtype, body = _header(file)
                    if not shape:
                        raise ValueError("no first axis")
                    if fortran and len(shape) > 1:
                        raise ValueError("a column-major array has no ranges of rows")
                except Exception as error:  # any unreadable file is a row, not a failed job
                    out.append((path, None, None, None, None, None, str(error)[:200]))
                    continue
                row = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
                step = max(1, size // max(1, row))
                out += [(path, i, min(step, shape[0] - i), body + i * row, dtype.str, list(shape[1:]), None) for i in range(0, shape[0], step)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "first", "rows", "at", "dtype", "shape", "error"])

    return files.select("path").mapInArrow(plan, "path string, first long, rows long, at long, dtype string, shape array<int>, error string")


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``SAMPLES`` of ``array_ranges``, dealt over tasks: a task holds one range at a time."""

    def load(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is not None:
                    yield batch_of([(r["path"], None, None, None, r["error"])])
                    continue
                dtype = np.dtype(r["dtype"])
                width = int(np.prod(r["shape"], dtype=np.int64))
                system, plain = opened(r["path"])
                with system.open_input_file(plain) as file:
                    file.seek(r["at"])
                    body = file.read(r["rows"] * width * dtype.itemsize)
                if len(body) < r["rows"] * width * dtype.itemsize:
                    yield batch_of([(r["path"], None, None, None, f"the file ends within its rows from {r['first']}")])
                    continue
                rows = np.frombuffer(body, dtype).reshape(r["rows"], width)
                for i in range(0, len(rows), 1000):
                    yield batch_of([(r["path"], r["first"] + i + k, r["shape"], row, None) for k, row in enumerate(rows[i : i + 1000].astype(np.float32))])

    return ranges.repartition(F.xxhash64("path", "first")).mapInArrow(load, SAMPLES)


def _put(folder: str, name: str, content: bytes) -> str:
    """A file written under another name and then renamed, so a task that runs again leaves one whole file."""
    system, plain = opened(folder)
    system.create_dir(plain, recursive=True)
    with system.open_output_stream(f"{plain}/.{name}.part") as out:
        out.write(content)
    system.move(f"{plain}/.{name}.part", f"{plain}/{name}")
    return f"{plain}/{name}"


def write_arrays(df: DataFrame, folder: str, value: str = "pixels", rows: int = 100_000) -> DataFrame:
    """(path, rows) of .npy files, each of at most ``rows`` rows of a task; runs when read, files are named by task and place."""

    def save(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        kept: list[np.ndarray] = []

        def flush():
            nonlocal number, kept
            array = np.concatenate(kept)
            head = np.lib.format.header_data_from_array_1_0(array)
            body = io.BytesIO()
            np.lib.format.write_array_header_1_0(body, head)
            path = _put(folder, f"part-{part:05d}-{number:05d}.npy", body.getvalue() + array.tobytes())
            number, kept = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(array)], pa.int64())], names=["path", "rows"])

        for batch in batches:
            if batch.num_rows:
                kept.append(np.asarray(batch.column(0).flatten(), dtype=np.float32).reshape(batch.num_rows, -1))
            if sum(map(len, kept)) >= rows:
                yield flush()
        if kept:
            yield flush()

    return df.select(F.col(value).cast("array<float>")).mapInArrow(save, "path string, rows long")


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit gray PNG of (height, width) pixels, without filters."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = pixels.shape
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = pixels
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def write_images(df: DataFrame, folder: str, width: int) -> DataFrame:
    """(name, path) of a PNG for each row (name, pixels 0 to 255); runs when read."""

    def save(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            paths = [_put(folder, f"{name}.png", png(np.array(p, np.uint8).reshape(-1, width))) for name, p in zip(names, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["name", "path"])

    return df.select(F.col("name").cast("string").alias("name"), F.col("pixels").cast("array<int>").alias("pixels")).mapInArrow(save, "name string, path string")
