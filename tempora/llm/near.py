"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct shingles of five words (ASCII letters lower-cased; words are
runs without ASCII white space; fewer words make one shingle).  Two permutations of the 2^32
positions make the whole signature: the first scatters shingles, the second, shifted by k around
the circle, gives coordinate k as ``min over x of second(first(x) + k)``.  Bands of five
coordinates are bucket keys; 48 bands miss a pair at a similarity of 0.75 with a probability of
(1 - 0.75^5)^48, about 2e-6, and more similar pairs more rarely.  Whatever shares a bucket is
compared on full sets.

No bucket is expanded into all its pairs.  Texts with equal sets are one node, and buckets with
the same nodes are one bucket.  Nodes that share one of the first ``early`` bands meet in groups of
at most ``block``, the bucket's least node being in each; of a group's pairs that may be linked a
spanning forest, the most alike first, is confirmed on full sets, and components of the links label
the nodes.  From then on only buckets of several labels count.  Such a bucket's nodes are those of
its largest component, of which no two are compared, and the others: groups hold a block of others
with up to ``wide`` of the largest component, or two blocks of others.  Forests are confirmed as
long as that joins components; then all pairs that are left, but for those ruled out: by fewer than
62 % of equal coordinates, 4.5 standard deviations below 0.75, by the sizes of their sets, or by
their odd sketches, which bound the symmetric difference from below (both bounds are exact).  A
refused pair leaves its components apart, so whatever else may link them is still compared.

Buckets with more than ``most`` blocks of others are split by a second and a third band key first.
A linked pair shares eleven bands on average; at a similarity of exactly 0.75 it shares fewer than
two with a probability of 4e-5 and fewer than three with 3e-4, and only such pairs of such buckets
are missed, unless something else links them.  What is left at the last level is compared in full.
No candidate is dropped for a bucket's size.

Null and empty texts have an empty set and are linked with nothing.  Rows with a null id are
linked with nothing, have a null component and stay.  Rows that repeat an id are each returned;
where their texts differ, they are linked with one another and their links are those of either text.  An empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.session import cut, discard, freed, prepare, table_bytes

from .components import components

WORDS, ROWS, BANDS, SKETCH = 5, 5, 48, 64
MASK = (1 << 64) - 1
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words; none are kept, as a worker's table of words would cost more than it saves."""
    import xxhash

    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * PRIME + w[j : len(w) - n + 1 + j]
    return np.unique(mix64(h))


def signature(sets: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a set of 64-bit hashes."""
    first = (mix64(sets ^ PRIME) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(first), 512):
        x = first[a : a + 512][None, :] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def odd_sketch(sets: np.ndarray) -> np.ndarray:
    """``SKETCH`` bytes: bit k is the parity of how many of a set's 64-bit hashes fall to k.

    Two sketches differ in at most as many bits as there are hashes in one of the sets only."""
    at = (sets >> np.uint64(64 - (8 * SKETCH - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=8 * SKETCH) & 1)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * PRIME + part[:, j])
    return key.view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digests(sets: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets apart."""
    with np.errstate(over="ignore"):
        return _signed(int(sets.sum(dtype=np.uint64)) & MASK), _signed(int(np.bitwise_xor.reduce(mix64(sets * PRIME))) if len(sets) else 0)


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, n (size of the set), two digests of the set, its band keys, and a byte of each coordinate followed by the odd sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n, d1, d2, keys, bytes_ = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text or "", words)
                    n.append(len(s))
                    for d, x in zip((d1, d2), digests(s), strict=True):
                        d.append(x)
                    sig = signature(s, bands * rows)
                    keys.append(band_keys(sig, bands, rows) if len(s) else np.zeros(0, np.int64))
                    bytes_.append((sig >> np.uint32(24) ^ sig & np.uint32(255)).astype(np.uint8).tobytes() + odd_sketch(s).tobytes())
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, pa.array(bytes_, pa.binary())], names=["doc_id", "n", "d1", "d2", "bands", "sig"])

    return docs.mapInArrow(freed(sign), "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary")


def set_table(rows: DataFrame, words: int) -> DataFrame:
    """Rows (node, d1, d2, text) as node and its whole set: rows whose set has other digests are of
    another text of a repeated id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                nodes, sets = [], []
                for node, d1, d2, text in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    s = shingles(text or "", words)
                    if digests(s) == (d1, d2):
                        nodes.append(node)
                        sets.append(s.view(np.int64))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else [], pa.int64()))], names=["node", "hashes"])

    return rows.select("node", "d1", "d2", "text").mapInArrow(freed(build), "node long, hashes array<long>")


#: Of keys of a table (key): the lowest bit of a key says that it is of one of the first bands.
EARLY = "key & 1"


def _some(df: DataFrame, broadcast_bytes: int) -> DataFrame:
    """A written table, marked for broadcast where its files show that it is small."""
    return F.broadcast(df) if table_bytes(df) <= broadcast_bytes else df


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, words: int, broadcast_bytes: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b) that are linked, by comparing whole sets."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = cut(asked.join(nodes, "node").select("node", F.col("rep").alias("doc_id"), "d1", "d2"), "asked")
    sets = cut(set_table(docs.join(_some(asked, broadcast_bytes), "doc_id"), words), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    same = F.size(F.array_intersect("ha", "hb"))
    both = both.select("a", "b", same.alias("same"), (F.size("ha") + F.size("hb")).alias("total"))
    links = cut(both.filter(F.lit(100) * F.col("same") >= F.lit(percent) * (F.col("total") - F.col("same"))).select("a", "b").distinct(), "links")
    discard(asked, sets)
    return links


def agreeing(nodes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sigs: np.ndarray, percent: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a group, of different labels: all that may be linked, or, unless ``every``,
    a spanning forest of them over the labels, the most alike first."""
    names, kind, counts = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    top = kind == counts.argmax()
    order = np.argsort(top, kind="stable")
    others = len(order) - int(counts.max())
    nodes, sizes, kind = nodes[order], sizes[order], kind[order]
    sigs, sketches = sigs[order, :-SKETCH], np.ascontiguousarray(sigs[order, -SKETCH:]).view(np.uint64)
    may = math.floor(0.624 * sigs.shape[1])
    first, second, alike = [], [], []
    for j in range(others):
        rest = slice(j + 1, None)
        fits = (kind[rest] != kind[j]) & (100 * np.minimum(sizes[rest], sizes[j]) >= percent * np.maximum(sizes[rest], sizes[j]))
        at = np.flatnonzero(fits) + j + 1
        if not len(at):
            continue
        apart = np.bitwise_count(sketches[at] ^ sketches[j]).sum(1, dtype=np.int64)
        at = at[(100 + percent) * apart <= (100 - percent) * (sizes[at] + sizes[j])]
        same = (sigs[at] == sigs[j]).sum(1)
        at, same = at[same >= may], same[same >= may]
        if not len(at):
            continue
        if every:
            yield np.full(len(at), nodes[j]), nodes[at]
            continue
        tops = at >= others
        if tops.sum() > 1:  # of the largest component, the most alike
            best = at[tops][same[tops].argmax()]
            keep = ~tops | (at == best)
            at, same = at[keep], same[keep]
        first.append(np.full(len(at), j))
        second.append(at)
        alike.append(same)
    if not first:
        return
    first, second, alike = np.concatenate(first), np.concatenate(second), np.concatenate(alike)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for e in np.argsort(-alike, kind="stable").tolist():
        x, y = find(int(kind[first[e]])), find(int(kind[second[e]]))
        if x != y:
            root[y] = x
            out.append(e)
    yield nodes[first[out]], nodes[second[out]]


def candidates(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of the groups ``g`` of rows (g, node, n, label, sig)."""
    rows = rows.select("g", "node", "n", "label", "sig").repartition("g").sortWithinPartitions("g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            ends = (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()
            if rest and rest[-1].column(0)[0].as_py() != g[0]:
                yield from groups(rest, None)
                rest = []
            if ends:
                yield from groups([*rest, batch.slice(0, ends[0])], None)
                yield from groups([batch.slice(0, ends[-1])], ends)
                rest = []
            rest.append(batch.slice(ends[-1] if ends else 0))
        if rest:
            yield from groups(rest, None)

    def groups(parts: list[pa.RecordBatch], ends: list[int] | None) -> Iterator[pa.RecordBatch]:
        """One group in several parts, or those of one part that begin at ``ends``, without the last end."""
        table = pa.Table.from_batches(parts)
        edges = [0, table.num_rows] if ends is None else ends
        nodes, sizes, labels = (table.column(k).to_numpy() for k in (1, 2, 3))
        raw = table.column(4).to_pylist()
        found, size = [], 0
        for at, end in zip(edges, edges[1:], strict=False):
            if end - at < 2:
                continue
            sigs = np.frombuffer(b"".join(raw[at:end]), np.uint8).reshape(end - at, -1)
            for two in agreeing(nodes[at:end], sizes[at:end], labels[at:end], sigs, percent, every):
                found.append(two)
                size += len(two[0])
                if size >= 1 << 16:
                    yield pairs(found)
                    found, size = [], 0
        if found:
            yield pairs(found)

    def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return rows.mapInArrow(freed(compare), "a long, b long").distinct()


def buckets(cells: DataFrame) -> DataFrame:
    """Keys with their least node and number of nodes; of keys with the same nodes one, an early one if there is."""
    every = cells.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("nodes"), F.bit_xor(F.xxhash64("node")).alias("all"))
    one = every.groupBy("least", "nodes", "all").agg(F.max(F.struct(F.expr(EARLY).alias("early"), "key")).alias("of"))
    return one.select("of.key", "least", "nodes")


def dealt(live: DataFrame, block: int, wide: int) -> DataFrame:
    """The nodes of mixed buckets, with the groups ``g`` in which they meet.

    A bucket's nodes are those of its largest component (``top``, ``top_nodes`` of them), dealt to
    blocks of ``wide``, and the others, dealt to blocks of ``block``.  Any two nodes meet in some
    group, except two of the largest component: a block of others meets every block of the largest
    component, and every other block of others.  Rows grow with the others' blocks and those of
    ``wide``; in a bucket of a block and ``wide`` nodes at most each node is one row."""
    tops = F.ceil(F.col("top_nodes") / F.lit(wide)).cast("int")
    others = F.ceil((F.col("nodes") - F.col("top_nodes")) / F.lit(block)).cast("int")
    is_top = F.col("label") == F.col("top")
    own = F.pmod(F.xxhash64("key", "node"), F.when(is_top, tops).otherwise(others)).cast("int")
    live = live.withColumn("own", own).withColumn("tops", tops).withColumn("others", others)
    over_tops = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda x: F.xxhash64(F.col("key"), F.lit("top"), F.col("own"), x))
    over_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.xxhash64(F.col("key"), F.lit("top"), x, F.col("own")))
    beside = F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda x: x != F.col("own"))
    beside = F.transform(beside, lambda x: F.xxhash64(F.col("key"), F.lit("others"), F.least(F.col("own"), x), F.greatest(F.col("own"), x)))
    return live.withColumn("g", F.explode(F.when(is_top, over_others).otherwise(F.concat(over_tops, beside))))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, early: int = 6, block: int = 1024, wide: int = 1 << 16, most: int = 32, levels: int = 3, broadcast_bytes: int = 32 << 20, small_bytes: int = 8 << 20) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id, kept.

    ``early`` bands are looked at first; ``block``, ``wide``, ``most`` and ``levels`` bound what meets in
    one task (see above); tables of at most ``broadcast_bytes``, and of keys and labels ``small_bytes``, as
    their files show, are broadcast."""
    prepare(docs.sparkSession)
    small = min(broadcast_bytes, small_bytes)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, bands, rows, words).withColumn("row", F.monotonically_increasing_id()), "signed")
    # a node is the first row of a set; rep is the least id that has it
    sets = cut(signed.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")), "nodes")
    members = cut(signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2", "row").join(sets, ["d1", "d2", "n"]).select("doc_id", "n", "row", "node", "rep"), "members")
    rest = signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    copies = cut(members.filter("row <> node").select("row"), "copies")
    banded = signed.filter("n > 0 and doc_id is not null").join(_some(copies, broadcast_bytes), "row", "left_anti").select(F.col("row").alias("node"), "n", "bands", "sig")

    ids = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    twins = members.join(ids.select("doc_id", "a"), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    twins, labels = cut(twins.distinct(), "twins"), None

    def join(more: DataFrame) -> bool:
        """Bring the labels up to date; whether there was a link."""
        nonlocal labels
        some = not more.isEmpty()
        if some:
            # what was reached so far is as good as the links that it came from
            every = more if labels is None else more.union(labels.filter("node <> label").select("label", "node"))
            old, labels = labels, cut(components(every), "labels")
            discard(*([] if old is None else [old]))
        discard(more)
        return some

    def link(pairs: DataFrame) -> bool:
        """Confirm candidates; whether there was a link."""
        pairs = cut(pairs, "pairs")
        some = not pairs.isEmpty() and join(verified(docs, sets, pairs, percent, words, broadcast_bytes))
        discard(pairs)
        return some

    def labelled(cells: DataFrame) -> DataFrame:
        if labels is None:
            return cells.withColumn("label", F.col("node"))
        return cells.join(_some(labels, small), "node", "left").withColumn("label", F.coalesce("label", "node"))

    join(twins)
    keyed = F.transform("bands", lambda k, i: F.when(i < early, k.bitwiseOR(F.lit(1))).otherwise(k.bitwiseAND(F.lit(-2))))
    banded = banded.withColumn("bands", keyed)
    spread = banded.select("node", F.explode("bands").alias("key"))  # later levels' also have the band keys of the bucket
    sigs = None
    for level in range(levels):
        shared = spread.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key")
        shared = cut(shared, "shared")
        cells = cut(spread.join(_some(shared, small), "key"), "cells")
        kept = cut(buckets(cells), "kept")
        discard(shared, spread)
        every, cells = cells, cut(cells.join(_some(kept, small), "key"), "cells")
        discard(every, kept)
        if sigs is None:  # of nodes that share a bucket
            met = cut(cells.select("node").distinct(), "met")
            sigs = cut(banded.select("node", "n", "sig").join(_some(met, broadcast_bytes), "node", "left_semi"), "sigs")
            discard(met)
        if level == 0:
            # the least node is in every block, so that what is like it meets over the blocks
            blocks = F.ceil(F.col("nodes") / F.lit(block)).cast("int")
            salt = F.array(F.pmod(F.xxhash64("key", "node"), blocks).cast("int"))
            first = labelled(cells.filter(f"{EARLY} = 1"))
            first = first.withColumn("block", F.explode(F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), blocks - 1)).otherwise(salt)))
            link(candidates(first.join(sigs, "node").withColumn("g", F.xxhash64("key", "block")), percent, False))
        last, many, every, rounds = level == levels - 1, None, False, 0
        while True:
            named = labelled(cells.select("key", "node"))
            per_label = named.groupBy("key", "label").agg(F.count("*").alias("own"))
            per_key = per_label.groupBy("key").agg(F.max(F.struct("own", "label")).alias("top"), F.sum("own").alias("nodes"))
            mixed = per_key.select("key", F.col("top.label").alias("top"), F.col("top.own").alias("top_nodes"), "nodes").filter("top_nodes < nodes")
            mixed = cut(mixed, "mixed")
            live = cut(named.join(_some(mixed, small), "key"), "live")
            too_many = F.col("nodes") - F.col("top_nodes") > block * most
            few = live if last else live.filter(~too_many)
            some = link(candidates(dealt(few, block, wide).join(sigs, "node"), percent, every))
            rounds += 1
            if every:
                many = None if last else cut(live.filter(too_many).select("key", "node"), "many")
                if many is not None and level:
                    many = many.join(cells.select("key", "node", "used"), ["key", "node"])
            discard(mixed, live)
            if every:
                break
            every = not some or rounds == 3
        if many is None or many.isEmpty():
            break
        # another band key beside those of the bucket splits the buckets that are still too large
        used = F.col("used") if level else F.array("key")
        again = many.join(banded.select("node", "bands"), "node").select("node", used.alias("used"), F.explode("bands").alias("other"))
        again = again.filter(~F.array_contains("used", F.col("other"))).select("node", F.array_sort(F.array_append("used", F.col("other"))).alias("used")).distinct()
        spread = cut(again.select("node", F.xxhash64("used").alias("key"), "used"), "again")
        discard(cells)

    comp = members.select("doc_id", F.col("n").alias("n_shingles"), "node", "rep")
    if labels is None:
        comp = comp.withColumn("component_id", F.col("rep"))
    else:
        reached = labels.join(sets.select("node", "rep"), "node")
        least = reached.groupBy("label").agg(F.min("rep").alias("least"))
        reached = cut(labels.join(least, "label").select("node", "least"), "reached")
        comp = comp.join(_some(reached, broadcast_bytes), "node", "left").withColumn("component_id", F.coalesce("least", "rep"))
    out = comp.select("doc_id", "n_shingles", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_keep(docs: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of documents of which each component keeps its least doc_id."""
    gone = cut(near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(_some(gone, broadcast_bytes), docs.doc_id == gone["__gone"], "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
