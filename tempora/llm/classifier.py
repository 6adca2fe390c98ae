"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins (quantiles of the training rows).  Training goes round the features
in turn, and in each turn boosts the log-odds by a small step of a shallow tree on that feature
alone, so each feature ends as a lookup table over its bins.  Then the pairs of features whose
joint residuals gain most are boosted the same way, with trees that cut both.  A score is the sum
of table entries, found for a whole batch by one index each.

The model learns from at most ``train_rows`` labelled rows outside the held-out fold: those with
the least xxhash64(doc_id), a fixed sample; scores cover every row.  A row is held out if
crc32(doc_id as text) mod 5 is 0.  Inputs are counts of the text alone.

Null and empty texts get the score of their (zero) counts; null ids count as the empty string in
the fold; documents with several labels take part with each; rows without a label (or a null one)
only in scoring.  Without any label, or with one class only, all scores are that class's rate
(0.5 without rows).  Repeated rows are each scored; further columns are not looked at.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.session import cut, discard, freed, prepare

from .textstats import base_counts

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "exclaim", "digits", "line_words", "marks", "commas", "pipes", "others")


def features(text: str) -> list[float]:
    """Counts of a text as shares, so that a text's length is one feature only."""
    c = base_counts(text)
    chars, words, lines = max(1, len(text)), max(1, c["n_words"]), max(1, c["n_lines"])
    lower = text.lower()
    letters = sum(a != b for a, b in zip(text, lower, strict=True)) if len(lower) == len(text) and not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        float(np.log1p(c["n_words"])), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_distinct"] / words, letters / chars, text.count("!") / chars,
        sum(map(text.count, "0123456789")) / chars, min(1000.0, words / lines), text.count(".") / words,
        text.count(",") / words, text.count("|") / words, sum(map(text.count, "{}[]()=_;:@/\\")) / chars,
    ]


@dataclasses.dataclass
class Model:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by additions of table entries."""
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            z += g[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """The gain and place of the best cut of bins with gradient and curvature sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return -np.inf, 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 1.0) -> np.ndarray:
    """The leaf values, for each bin, of a tree of cuts over ordered bins."""
    gain, k = _split(g, h, least) if depth else (-np.inf, 0)
    if gain <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, least), _tree(g[k:], h[k:], depth - 1, least)])


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of one cut on the first feature and one on the second below each side."""
    best, out = -np.inf, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        gain, k = _split(a.sum(1), b.sum(1), 1.0)
        if not np.isfinite(gain):
            continue
        total, tree = 0.0, np.zeros_like(a)
        for part in (slice(0, k), slice(k, None)):
            ga, hb = a[part].sum(0), b[part].sum(0)
            leaf = _tree(ga, hb, 1)
            tree[part] = leaf
            total += float((leaf * (2 * ga - leaf * (hb + 1))).sum())
        if total > best:
            best, out = total, tree.T if turn else tree
    return best, out


def train(x: np.ndarray, y: np.ndarray, *, max_bins: int = 48, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_bins: int = 48, pair_rounds: int = 40) -> Model:
    """Cyclic boosting of the main tables, then of the chosen pairs' grids."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y) or y.min() == y.max():
        rate1 = float(y.mean()) if len(y) else 0.5
        rate1 = min(max(rate1, 1e-6), 1 - 1e-6)
        return Model([np.zeros(0)] * width, float(np.log(rate1 / (1 - rate1))), [np.zeros(1)] * width, [], [])
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, max_bins) / max_bins)) for j in range(width)]
    p = y.mean()
    model = Model(cuts, float(np.log(p / (1 - p))), [np.zeros(len(c) + 1) for c in cuts], [], [])
    b = model.bins(x)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            q = 1 / (1 + np.exp(-z))
            size = len(table)
            step = rate * _tree(np.bincount(b[:, j], y - q, size), np.bincount(b[:, j], q * (1 - q), size))
            table += step
            z += step[b[:, j]]
    q = 1 / (1 + np.exp(-z))

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(cuts[i]) + 1, len(cuts[j]) + 1
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(at, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_grid(*sums(i, j))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:n_pairs] if np.isfinite(gain)]
    model.grids = [np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            q = 1 / (1 + np.exp(-z))
            step = rate * _grid(*sums(i, j))[1]
            grid += step
            z += step[b[:, i], b[:, j]]
    return model


def _featured(docs: DataFrame) -> DataFrame:
    """Training rows: y and the features of the text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = [features(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    return docs.mapInArrow(freed(build), "y int, x array<double>")


def fold(ident):
    """Whether a row is held out."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, *, train_rows: int = 12_000) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    known = known.filter(~fold(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    known = cut(known, "sample")
    # train_rows rows of two numbers: a bounded broadcast
    joined = docs.select(F.col("doc_id").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("y", "text")
    rows = _featured(joined).collect()  # train_rows rows of features (times an id's repeats)
    discard(known)
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    order = np.lexsort([*x.T, y])  # the same model however rows arrive
    return train(x[order], np.clip(y[order], 0, 1))


def scored(docs: DataFrame, model: Model, *, cut_off: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                s = model.score(np.array([features(t or "") for t in part.column(2).to_pylist()], float))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= cut_off).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, model: Model, *, cut_off: float = 0.3) -> DataFrame:
    """The rows of documents that the model doesn't reject, all columns as they were."""
    prepare(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for a in range(0, batch.num_rows, 512):
                x = [features(t or "") for t in batch.column(at).slice(a, 512).to_pylist()]
                mask.extend((model.score(np.array(x, float)) >= cut_off).tolist())
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.select(*names).mapInArrow(freed(keep), docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, learn(docs, labels))
