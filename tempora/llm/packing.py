"""Packing token sequences by non-negative least squares over length patterns.

Texts are encoded where they lie; a document longer than a sequence is cut into full pieces, the
first one taking what is left over.  The histogram of piece lengths (as many entries as a
sequence has tokens, however large the corpus) is all that the plan needs: patterns of one to
three lengths that fill a sequence are enumerated, non-negative repeat counts fitted to the
histogram by least squares, rounded, and what they leave is packed best-fit, longest first, on the
histogram too.  The plan is a list of recipes (lengths, repeats).  The n-th piece of a length
takes that length's n-th slot; its number n is its place in its partition plus the pieces of that
length in the partitions before.

Null and empty texts are one piece (the end id).  Null ids and repeated rows are packed like any
other row, an empty table gives an empty result, and further columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.session import cut, freed, prepare

from .encoder import chunks, encoder

Recipe = tuple[tuple[int, ...], int]
COUNTS = 1 << 20  # rows of counts that one task writes


def patterns(hist: np.ndarray, anchors: int = 16) -> np.ndarray:
    """Ordered triples of lengths (0: none) that fill a sequence, from lengths that occur.

    All singles and pairs; of the triples those with one of ``anchors`` lengths, taken at equal
    shares of the pieces, in them, so that every length has some.
    """
    cap = len(hist) - 1
    a = np.arange(1, cap + 1)
    found = [np.array([[cap, 0, 0]]), np.stack([a, cap - a, 0 * a], 1)]
    if total := hist.sum():
        marks = np.unique(np.searchsorted(np.cumsum(hist), total * (np.arange(anchors) + 0.5) / anchors))
        for b in marks:
            found.append(np.stack([a, np.full(cap, b), cap - a - b], 1))
    rows = np.concatenate(found)
    rows = np.unique(np.sort(rows[(rows >= 0).all(1)], 1)[:, ::-1], axis=0)
    ok = (rows[:, 0] > 0) & ((rows == 0) | (hist[rows] > 0)).all(1)
    return rows[ok]


def fit(hist: np.ndarray, rows: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - hist|^2, by multiplicative updates.

    A's column for a pattern counts its lengths.  All data are non-negative, so that each update
    x *= A'h / A'Ax lowers the error and keeps x non-negative.
    """
    size, h = len(hist), hist.astype(float)
    h[0] = 0
    goal = h[rows].sum(1)
    x = np.full(len(rows), h.sum() / max(1, len(rows)) / 3 + 1e-9)
    for _ in range(rounds):
        made = np.zeros(size)
        for j in range(rows.shape[1]):
            made += np.bincount(rows[:, j], x, size)
        made[0] = 0
        x *= goal / np.maximum(made[rows].sum(1), 1e-12)
    return x


def best_fit(hist: np.ndarray, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[Recipe]:
    """Best fit, longest first, of a whole histogram: equal bins are kept as one with a count."""
    cap = len(hist) - 1
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(lengths: tuple[int, ...], n: int) -> None:
        if n:
            bins = room[cap - sum(lengths)]
            bins[lengths] = bins.get(lengths, 0) + n

    for lengths, n in begun:
        put(lengths, n)
    for size in range(cap, 0, -1):
        left = int(hist[size])
        while left:
            free = min((r for r, bins in room.items() if r >= size and bins), default=None)
            if free is None:
                per = cap // size
                put((size,) * per, left // per)
                put((size,) * (left % per), 1 if left % per else 0)
                break
            lengths, n = next(iter(room[free].items()))
            per = min(free // size, left)
            take = min(n, left // per)
            del room[free][lengths]
            put(lengths, n - take)
            put((*lengths, *(size,) * per), take)
            left -= take * per
    return [(lengths, n) for r in sorted(room) for lengths, n in room[r].items()]


def plan(hist: np.ndarray) -> list[Recipe]:
    """Recipes for all pieces: fitted patterns, rounded, then the residual packed best-fit."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    recipes: list[Recipe] = []
    rows = patterns(left)
    if len(rows):
        x = fit(left, rows)
        for k in np.argsort(-x, kind="stable"):
            n = int(np.floor(x[k] + 0.5))
            if not n:
                break
            lengths = tuple(int(v) for v in rows[k] if v)
            n = min([n, *(int(left[v]) // lengths.count(v) for v in lengths)])
            if n:
                for v in lengths:
                    left[v] -= n
                recipes.append((lengths, n))
    return [*recipes, *best_fit(left)]


def slots(recipes: list[Recipe], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of equal slots: length, number of its first, its first sequence, its offset;
    in the order of (length, number)."""
    used = np.zeros(cap + 1, np.int64)
    rows, sequence = [], 0
    for lengths, n in recipes:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, j]) for j in range(4))


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Encode and cut: a row for each piece, with its partition and its number there among those
    of its length."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), struct.pack("<I", end_id)
        seen = [0] * (capacity + 1)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column(0).to_pylist()
                out: list[list] = [[], [], [], [], [], []]
                for at, some in chunks(part.column(1).to_pylist()):
                    for k, raw in enumerate(enc.encode(some)):
                        raw += end
                        n = len(raw) // 4
                        edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                        for j in range(len(edges) - 1):
                            size = edges[j + 1] - edges[j]
                            for column, v in zip(out, (ids[at + k], j, edges[j], size, zlib.crc32(raw[4 * edges[j] : 4 * edges[j + 1]]), seen[size]), strict=True):
                                column.append(v)
                            seen[size] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds, strict=True)), pa.array([shard] * len(out[0]), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "number", "shard"])

    return docs.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, number long, shard int")


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark: SparkSession = prepare(docs.sparkSession)
    cuts = cut(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity), "pieces")
    # a row for each length of a partition at most, so few files, whatever the number of shuffle partitions
    files = -(-len(cuts.inputFiles()) * (capacity + 1) // COUNTS) or 1
    counts = cut(cuts.groupBy("shard", "length").agg(F.count("*").alias("n")).coalesce(files), "counts")
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        hist[length] = n
    lengths, firsts, sequences, offsets = slots(plan(hist), capacity)
    begin = np.searchsorted(lengths, np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(files), "bases")
    numbered = cuts.join(bases, ["shard", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # slots of one length lie together, so one search over (length, number) finds all
        span = int(firsts.max()) + 1 if len(firsts) else 1
        key = lengths * span + firsts
        for batch in batches:
            size, number = (batch.column(j).to_numpy(zero_copy_only=False) for j in (3, 5))
            low, high = begin[size], begin[size + 1]
            at = np.minimum(np.searchsorted(key, size * span + np.minimum(number, span - 1), "right"), high) - 1
            if (at < low).any():
                raise ValueError("a piece has no slot")
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # workers drop their table of words here, else they hold it beside what the join and the writing of all files need
    return numbered.mapInArrow(freed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
