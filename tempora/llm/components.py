"""Connected components of a link table, without gathering links anywhere.

Every round first reduces the links to forests: a task takes at most about ``per_task`` links, joins
them, and gives each node's link to the least node it reaches there.  If one task held all links,
that is the result.  Otherwise randomised contraction follows: nodes get random ranks, each node is
merged into the least ranked of itself and its neighbours, and the links between different merged
nodes are the next round's.  At most three quarters of the nodes are expected to be left each round,
so that all rounds together read a small multiple of the links, however long their chains are.
Tables are cut between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.session import cut, discard


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links of one task as (a, b) with b the least node that a reaches by them, b < a."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = [(x, least) for x in list(root) if (least := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame, per_task: int = 50_000) -> DataFrame:
    """``links`` (a long, b long) as (node, label): label is the least node that can be reached.

    Nodes without links aren't listed; links with a null end and links to oneself don't count.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, merged = cut(links.distinct(), "links"), []
    while n := links.count():
        tasks = -(-n // per_task)
        own = links.coalesce(1) if tasks == 1 else links.repartition(tasks, "a", "b")
        stars = own.mapInArrow(forest, "a long, b long")
        stars = cut(stars if tasks == 1 else stars.distinct(), "stars")
        discard(links)
        if tasks == 1:
            merged.append(stars.select(F.col("a").alias("node"), F.col("b").alias("into")).union(stars.select("b", "b").distinct()))
            break
        rank = lambda c, n=len(merged): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("rank"), F.col(c).alias("id"))
        both = stars.select("a", "b").union(stars.select("b", "a"))
        into = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("least"))
        into = cut(into.select("node", F.least("least", rank("node"))["id"].alias("into")), "into")
        merged.append(into)
        left = stars.join(into.select(F.col("node").alias("a"), F.col("into").alias("x")), "a").select("x", "b")
        left = left.join(into.select(F.col("node").alias("b"), F.col("into").alias("y")), "b").filter("x <> y")
        links = cut(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(stars)
    if not merged:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    last = merged.pop()
    while merged:  # each round's nodes find what the next rounds merged them into
        into, after = merged.pop(), last
        found = into.join(after.select(F.col("node").alias("into"), F.col("into").alias("end")), "into", "left")
        last = cut(found.select("node", F.coalesce("end", "into").alias("into")), "into")
        discard(into, after)
    least = last.groupBy("into").agg(F.min("node").alias("label"))
    return last.join(least, "into").select("node", "label")
