"""Token-ID output: shards of independent zstandard frames with a trailing seek table.

A shard is, in this order,

* data frames: each an independent zstandard frame (with its own content checksum) of at most
  ``frame_bytes`` bytes of little-endian unsigned 32-bit ids; documents follow one another,
* a skippable frame (magic ``0x184D2A50``) that lists the documents: their number as u64, then
  ids (i64), whether the id is null (u8) and numbers of ids (u64),
* the seek table of the public seekable format: a skippable frame (magic ``0x184D2A5E``) with an
  entry (compressed size, content size, low 32 bits of the content's XXH64; u32 each) for every
  frame before it, the list's with content size 0, then the number of entries (u32), the
  descriptor ``0x80`` and the magic ``0x8F92EAB1``.

A reader takes the last bytes of a shard, then only the frames that hold the document it wants.

Documents go to shards by ascending ``doc_id`` (nulls first; rows of one id by the hash of their
text).  A null text counts as empty, an empty one holds the end id alone, an empty table makes
shards without documents, columns other than id and text are not looked at, repeated rows are
written again.  A shard is named by its task attempt, and the manifest lists only those of
attempts that Spark took, so lost executors or repeated tasks leave no half-written data in it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.session import cut, fresh, partitions, prepare

from .encoder import chunks, encoder

LIST, TABLE, FOOT, CHECKED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def filesystem(uri: str):
    """The file system of a URI, local or remote, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; holds at most a frame of ids and the list of its documents."""

    def __init__(self, out, frame_bytes: int) -> None:
        import xxhash
        import zstandard

        self.out, self.frame_bytes, self.hash = out, frame_bytes, xxhash.xxh64_intdigest
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.waiting, self.size, self.table = [], 0, []
        self.ids, self.null, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush(False)

    def flush(self, last: bool) -> None:
        held = b"".join(self.waiting)
        at = 0
        while len(held) - at >= self.frame_bytes or (last and at < len(held)):
            part = held[at : at + self.frame_bytes]
            at += len(part)
            frame = self.press.compress(part)
            self.out.write(frame)
            self.table.append((len(frame), len(part), self.hash(part) & 0xFFFFFFFF))
        self.waiting, self.size = [held[at:]], len(held) - at

    def close(self) -> int:
        self.flush(True)
        listed = struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        self.out.write(struct.pack("<II", LIST, len(listed)) + listed)
        self.table.append((8 + len(listed), 0, 0))
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKED, FOOT)
        self.out.write(struct.pack("<II", TABLE, len(body)) + body)
        return sum(self.counts)


class ShardReader:
    """Reads a shard's list of documents, and of its frames those that are asked for."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        file.seek(max(0, size - 9))
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOT or flags != CHECKED:
            raise ValueError("not a shard: its seek table is missing")
        file.seek(size - 9 - 12 * n)
        table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.content = np.concatenate([[0], np.cumsum(table[:-1, 1])])
        self.checks = table[:, 2]
        file.seek(int(self.at[n - 1]) + 8)
        listed = file.read(int(table[-1, 0]) - 8)
        m = struct.unpack_from("<Q", listed)[0]
        self.ids = np.frombuffer(listed, "<i8", m, 8)
        self.null = np.frombuffer(listed, "u1", m, 8 + 8 * m)
        self.counts = np.frombuffer(listed, "<u8", m, 8 + 9 * m).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        if self.held[0] != k:
            self.file.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.at[k + 1] - self.at[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, raw)
        return self.held[1]

    def parts(self, row: int) -> Iterator[bytes]:
        """The bytes of one document's ids, frame by frame."""
        a, b = 4 * int(self.starts[row]), 4 * int(self.starts[row] + self.counts[row])
        k = int(np.searchsorted(self.content, a, "right")) - 1
        while a < b:
            raw, base = self.frame(k), int(self.content[k])
            part = raw[a - base : b - base]
            yield part
            a, k = a + len(part), k + 1

    def tokens(self, row: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(row)), "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, frame_bytes: int = 1 << 20) -> DataFrame:
    """Encode every text and write the shards; gives the manifest, a row for each shard in order."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        store, top = filesystem(path)
        store.create_dir(top, recursive=True)
        name = f"shard-{pid:06d}-{uuid.uuid4().hex}.zst"
        end, enc = struct.pack("<I", end_id), encoder(tokenizer)
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            shard = ShardWriter(out, frame_bytes)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for a in range(0, len(ids), 512):
                    for at, some in chunks(texts.slice(a, 512).to_pylist()):
                        for k, raw in enumerate(enc.encode(some)):
                            shard.add(ids[a + at + k], raw + end)
            n = shard.close()
        yield pa.RecordBatch.from_pydict({"shard": [pid], "file": [name], "n_docs": [len(shard.ids)], "n_tokens": [n]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return cut(rows.select("doc_id", "text").mapInArrow(write, "shard int, file string, n_docs long, n_tokens long"), "manifest")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read all shards back: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32, with the shard and the document's place in it.

    The manifest has one row for each shard, so the running total over it stays small.
    """
    prepare(spark)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "file", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{top}/{row['file']}") as file:
                    shard = ShardReader(file)
                    for a in range(0, len(shard.ids), 4096):
                        some = range(a, min(a + 4096, len(shard.ids)))
                        crcs = []
                        for k in some:
                            crc = 0
                            for part in shard.parts(k):
                                crc = zlib.crc32(part, crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.ids[a : a + 4096], pa.int64(), mask=shard.null[a : a + 4096].astype(bool)),
                                pa.array(shard.starts[a : a + 4096] + row["base"], pa.int64()),
                                pa.array(shard.counts[a : a + 4096], pa.int64()),
                                pa.array(crcs, pa.int64()),
                                pa.array([row["shard"]] * len(some), pa.int32()),
                                pa.array(list(some), pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"],
                        )

    return shards.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, place long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, manifest)
