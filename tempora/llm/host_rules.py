"""Quality rules with verdicts by host.

Each text is checked against rules of its own; failures are counted by host (a source, or the
host of a URL), and each host's failure rate is shrunk towards the others' by a beta prior whose
two parameters come from all hosts: their pooled rate, and the spread of their rates beyond what
counting so few documents gives by chance (moments of the beta-binomial distribution).  A host
whose shrunk rate reaches ``host_limit`` for any rule is rejected, and the verdict is joined back to
its documents: a document stays if it passes the base rules and its host isn't rejected.  A host
with few documents is thus judged by what is usual, not by one bad text.

Null texts count as empty (they fail the base rule).  Null hosts are one host.  Repeated rows
count as often as they occur and each is returned; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.session import cut, prepare, table_bytes

from .textstats import base_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [base_counts(t or "") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([x[c] for x in found], pa.int64()) for c in COUNTS)], names=["doc_id", "host", *COUNTS])

    return docs.mapInArrow(count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, object]:
    """Rules that a document can fail; the first is the base rule."""
    words = F.col("n_words")
    return {
        "base": (words < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * words),
        "symbols": F.lit(10) * F.col("n_symbols") > F.greatest(words, F.lit(1)),
        "lines": F.lit(10) * F.col("n_dup_lines") > F.lit(3) * F.greatest("n_lines", F.lit(1)),
        "length": (F.col("word_chars") < F.lit(3) * words) | (F.col("word_chars") > F.lit(12) * words),
    }


def host_verdicts(failed: DataFrame, names: list[str], host_limit: float, least_strength: float) -> DataFrame:
    """A row for each host: its documents, each rule's shrunk rate, and whether it is rejected.

    Of H hosts with n documents and k failures each, N and K in all, the pooled rate is m = K / N and
    the hosts' weighted spread S = sum of n (k / n - m)^2.  By chance alone S is m (1 - m) (H - 1); a
    correlation r of a host's documents adds r m (1 - m) (N - sum of n^2 / N - (H - 1)).  The prior
    has mean m and the strength 1 / r - 1 documents: at least ``least_strength``, at most 1e6, and so
    much where S is no more than chance or can't tell (all hosts of one document, one host)."""
    hosts = cut(failed.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"f_{r}").cast("long")).alias(f"k_{r}") for r in names)), "hosts")
    n = F.col("n").cast("double")
    sums = [F.count("*").alias("h"), F.sum(n).alias("all"), F.sum(n * n).alias("squares")]
    for r in names:
        k = F.col(f"k_{r}").cast("double")
        sums += [(F.sum(k) / F.sum(n)).alias(f"m_{r}"), F.sum(k * k / n).alias(f"q_{r}")]
    out = hosts.join(F.broadcast(hosts.agg(*sums)), how="inner")  # one row of sums
    chance = F.col("h") - 1
    room = F.col("all") - F.col("squares") / F.col("all") - chance
    shrunk = []
    for r in names:
        m = F.col(f"m_{r}")
        spread = F.col(f"q_{r}") - F.col("all") * m * m
        alike = F.when((room > 1e-9) & (m > 0) & (m < 1), (spread / (m * (1 - m)) - chance) / room)
        strength = F.greatest(F.when(alike > 1e-6, 1 / alike - 1).otherwise(1e6), F.lit(least_strength))
        shrunk.append(((F.col(f"k_{r}") + strength * m) / (n + strength)).alias(f"rate_{r}"))
    out = out.select("host", F.col("n").alias("host_docs"), *shrunk)
    return out.withColumn("host_rejected", F.greatest(*(F.col(f"rate_{r}") for r in names), F.lit(0.0)) >= host_limit)


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5, least_strength: float = 2.0, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Every row with its counts, base_failed, kept, its own failures and its host's verdict."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    tests = rules()
    failed = cut(counted(docs).select("*", *(x.alias(f"f_{r}") for r, x in tests.items())), "failed")
    hosts = cut(host_verdicts(failed, list(tests), host_limit, least_strength), "verdicts")
    size, hosts = table_bytes(hosts), hosts.withColumnRenamed("host", "of_host")
    if size <= broadcast_bytes:
        hosts = F.broadcast(hosts)
    out = failed.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    soft = F.array_compact(F.array(*(F.when(F.col(f"f_{r}"), F.lit(r)) for r in tests)))
    return out.select(
        "doc_id", *(c for c in COUNTS if c != "n_lines"), F.col("f_base").alias("base_failed"),
        (~F.col("f_base") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
        F.concat_ws(",", soft).alias("failures"), "host", "host_docs", *(f"rate_{r}" for r in tests), "host_rejected",
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
