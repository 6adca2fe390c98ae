"""Sound files (RIFF, type WAVE) as rows with mono samples, and clips as such files."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tempora.functions.session import prepare

#: Sample formats that are read, by (format code, bits): how they are stored, and what full scale is.
STORED = {(1, 16): ("<i2", 1 << 15), (3, 32): ("<f4", 1)}
EXTENSIBLE = 0xFFFE  # the real format code then stands in the first two bytes of the sub-format


def sections(content: bytes) -> Iterator[tuple[str, memoryview]]:
    """Names and bodies of a file's sections; each begins on an even byte, the last may be cut short."""
    view = memoryview(content)
    if bytes(view[:4]) + bytes(view[8:12]) != b"RIFFWAVE":
        raise ValueError("this is no sound file of the RIFF kind")
    rest = view[12:]
    while len(rest) >= 8:
        size = int.from_bytes(rest[4:8], "little")
        yield bytes(rest[:4]).decode("latin-1"), rest[8 : 8 + size]
        rest = rest[8 + size + (size & 1) :]


def decode(content: bytes, strict: bool = False) -> tuple[int, int, np.ndarray]:
    """Sample rate, number of channels, and the mean of the channels as 32-bit floats.

    16-bit integers and 32-bit floats are read; ``strict`` refuses all but one channel of 16 bits.  Of
    sections that repeat the first counts; samples that the file cuts short count as far as they go."""
    layout = samples = None
    for name, body in sections(content):
        if name == "fmt " and layout is None and len(body) >= 16:
            layout = body
        elif name == "data" and samples is None:
            samples = body
    if layout is None or samples is None:
        raise ValueError("the file doesn't say how its sound is stored, or holds none")
    code, channels, rate = struct.unpack_from("<HHI", layout)
    bits = int.from_bytes(layout[14:16], "little")
    if code == EXTENSIBLE:
        code = int.from_bytes(layout[24:26], "little") if len(layout) >= 26 else 1
    if (code, bits) not in STORED or not channels or not rate:
        raise ValueError(f"sound of format {code} with {bits} bits and {channels} channels isn't read")
    if strict and (channels, bits) != (1, 16):
        raise ValueError(f"one channel of 16 bits is needed, not {channels} of {bits}")
    kind, full = STORED[code, bits]
    frame = np.dtype((kind, (channels,)))
    found = np.frombuffer(samples[: len(samples) // frame.itemsize * frame.itemsize], kind).reshape(-1, channels)
    return rate, channels, (found.mean(axis=1, dtype=np.float64) / full).astype(np.float32)


def encode(channels: list[np.ndarray], rate: int, frames: int | None = None) -> bytes:
    """16-bit samples of one or more channels of one length, clipped to -1..1; ``frames``, if given, must be their length."""
    table = np.stack([np.asarray(c, np.float64) for c in channels], axis=1)
    if frames is not None and len(table) != frames:
        raise ValueError(f"{frames} frames were announced, {len(table)} came")
    body = np.floor(np.clip(table, -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
    n = table.shape[1]
    out = io.BytesIO()
    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * 2, n * 2, 16, b"data", len(body)))
    out.write(body)
    return out.getvalue()


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """file, sample_rate, channels, samples of every file below ``path``; an unreadable file is an error that names it."""
    prepare(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: contents are large
                file, content = (batch.column(k)[i].as_py() for k in (0, 1))
                try:
                    rate, channels, samples = decode(content, strict)
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([rate], pa.int64()), pa.array([channels], pa.int32()), pa.array([samples], pa.list_(pa.float32()))], names=["file", "sample_rate", "channels", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, sample_rate long, channels int, samples array<float>")


def write(clips: DataFrame, folder: str) -> None:
    """A file ``<name>.wav`` in ``folder`` (a URI or a shared path) for each clip (name, sample_rate, samples).

    A file is written under another name and then moved, so that a task that is tried again leaves one."""
    prepare(clips.sparkSession)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        done = 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, rate, samples = (batch.column(k)[i] for k in range(3))
                draft = f"{top}/.{name.as_py()}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(encode([samples.values.to_numpy(zero_copy_only=False)], rate.as_py()))
                store.move(draft, f"{top}/{name.as_py()}.wav")
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    import pyarrow.fs  # noqa: F401

    clips.select("name", "sample_rate", "samples").mapInArrow(save, "done long").agg({"done": "sum"}).collect()
