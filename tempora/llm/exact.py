"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over (the first bytes of the normalised text, its
digest, doc_id) and sorted within their partition by the same key and the whole text, so equal
texts lie next to each other.  One pass compares each text in full with the one before it.  The
splitters are short whatever the texts' lengths, and as doc_id is part of the key, a text that a
third of all rows share is spread over as many partitions as its rows need.  Runs that cross a
partition's edge are joined by a second pass over the first and last run of each partition.

Null texts count as empty.  Rows with a null id sort last in their group: the smallest id that is
not null stays, or, if a group has null ids only, its keep_id is null.  Of rows that repeat an id
and a text, one stays.  An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.session import cut, freed, partitions, prepare

SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text_sha256 string, shard int, run int, first boolean, local_keep long, local_size long, edge boolean, edge_text string"


def normalised(text):
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Emit each sorted partition's rows with their run: its number, least id and size here.

    Holds the ids of one run and one text.  ``edge`` marks the first and last run, whose first
    row carries the text for the comparison across partitions.
    """
    shard = TaskContext.get().partitionId()
    arrow = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("shard", pa.int32()), ("run", pa.int32()), ("first", pa.bool_()), ("local_keep", pa.int64()), ("local_size", pa.int64()), ("edge", pa.bool_()), ("edge_text", pa.string())])
    columns: list[list] = [[] for _ in arrow]
    run, ids, sha, text = 0, [], None, None

    def close(last: bool) -> None:
        n, edge = len(ids), last or run == 0
        keep = next((i for i in ids if i is not None), None)
        for column, values in zip(columns, (ids, [sha] * n, [shard] * n, [run] * n, [True] + [False] * (n - 1), [keep] * n, [n] * n, [edge] * n, [text if edge else None] + [None] * (n - 1)), strict=True):
            column.extend(values)

    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            for doc_id, digest, norm in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if norm != text:
                    if ids:
                        close(False)
                        run += 1
                        if len(columns[0]) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                            columns = [[] for _ in arrow]
                    ids, sha, text = [], digest, norm
                ids.append(doc_id)
    if ids:
        close(True)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def content_sort(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 32) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("sha"), "norm", F.substring("norm", 1, prefix).alias("head"))
    # ids that are null go last: they stay only where a group has no other
    key = [F.col("head"), F.col("sha"), F.col("doc_id").asc_nulls_last()]
    rows = rows.repartitionByRange(partitions(spark), *key).sortWithinPartitions("head", "sha", "norm", F.col("doc_id").asc_nulls_last())
    runs = cut(rows.select("doc_id", "sha", "norm").mapInArrow(_runs, SCHEMA), "runs")

    # at most two rows for each partition, in the order of the partitions
    edges = runs.filter("first and edge").select("shard", "run", "text_sha256", "edge_text", "local_keep", "local_size")
    order = Window.orderBy("shard", "run")
    same = (F.col("text_sha256") == F.lag("text_sha256").over(order)) & (F.col("edge_text") == F.lag("edge_text").over(order))
    edges = edges.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    island = Window.partitionBy("island")
    joined = cut(edges.select("shard", "run", F.min("local_keep").over(island).alias("all_keep"), F.sum("local_size").over(island).alias("all_size"), F.min(F.struct("shard", "run")).over(island).alias("head")), "edges")
    here = runs.select("doc_id", "text_sha256", "shard", "run", "first", "local_keep", "local_size")
    # two rows a partition: small however large the table is
    out = here.join(F.broadcast(joined), ["shard", "run"], "left")
    keep = F.when(F.col("all_size").isNull(), F.col("local_keep")).otherwise(F.col("all_keep"))
    starts = F.col("first") & (F.col("head").isNull() | (F.col("head") == F.struct("shard", "run")))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("all_size", "local_size").alias("group_size"), starts.alias("kept"), "text_sha256")


def exact_keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The same sort carries whole rows, and a row whose text equals the one before it is dropped
    while its partition is read.  What is left to find is a first run that goes on from the
    partition before.
    """
    spark = prepare(docs.sparkSession)
    names = docs.columns
    own = [f"__tempora_{x}" for x in ("id", "head", "sha", "norm", "shard", "run")]
    ident, head, sha, norm, shard, run = own
    rows = docs.withColumns({ident: F.col(id_col).cast("long"), norm: normalised(F.col(text_col))})
    rows = rows.select(*names, ident, F.substring(norm, 1, prefix).alias(head), F.sha2(norm, 256).alias(sha))
    rows = rows.repartitionByRange(partitions(spark), head, sha, F.col(ident).asc_nulls_last())
    rows = rows.withColumn(norm, normalised(F.col(text_col))).sortWithinPartitions(head, sha, norm, F.col(ident).asc_nulls_last())
    width = len(names)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, before = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            mask, runs = [], []
            for a in range(0, batch.num_rows, 1024):
                for text in batch.column(width).slice(a, 1024).to_pylist():
                    mask.append(text != before)
                    if text != before:
                        k += 1
                        runs.append(k)
                        before = text
            part = batch.filter(pa.array(mask, pa.bool_()))
            columns = [*part.columns[:width], pa.array([at] * len(runs), pa.int32()), pa.array(runs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, shard, run])

    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(run, T.LongType())])
    kept = cut(rows.select(*names, norm).mapInArrow(freed(firsts), schema), "kept")
    # at most two rows a partition: its first and last text, compared in full with their neighbour
    ends = kept.groupBy(shard).agg(F.max(run).alias("last"))
    edges = kept.join(F.broadcast(ends), shard).filter((F.col(run) == 0) | (F.col(run) == F.col("last")))
    order = Window.orderBy(shard, run)
    edges = edges.select(shard, run, normalised(F.col(text_col)).alias("text")).withColumn("goes_on", F.col("text") == F.lag("text").over(order))
    again = cut(edges.filter("goes_on").select(shard, run), "again")
    return kept.join(F.broadcast(again), [shard, run], "left_anti").select(*names)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
