"""Ordered operators on spans: islands, merge, complement, difference, runs and layouts.

Every operator is keyed by ``by``: it partitions on the key and orders within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(by: list[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def islands(df: DataFrame, by: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a row for which ``begins`` holds starts a new one."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__new", F.when(F.coalesce(begins, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("__new").over(upto)).drop("__new")


def gaps(df: DataFrame, by: list[str], at: str, tie: str, least) -> DataFrame:
    """Pauses of at least ``least`` between a row and the next: from, to, gap."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    return df.select(*by, F.col(at).alias("gap_from"), F.lead(at).over(w).alias("gap_to")).filter(F.col("gap_to") - F.col("gap_from") >= least).withColumn("gap", F.col("gap_to") - F.col("gap_from"))


def merge(df: DataFrame, by: list[str], start: str, end: str, gap=0, strict: bool = False) -> DataFrame:
    """Unite spans that overlap or lie nearer than ``gap`` (``strict``: below it; else up to it)."""
    reach = F.max(end).over(_before(by, start, end))
    near = F.col(start) - reach < gap if strict else F.col(start) - reach <= gap
    found = islands(df, by, [start, end], ~near)
    return found.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("island")


def complement(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What lies between the united spans of a key."""
    united = merge(df, by, start, end)
    w = Window.partitionBy(*by).orderBy(start)
    return united.select(*by, F.col(end).alias("free_from"), F.lead(start).over(w).alias("free_to")).filter("free_to is not null")


def difference(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Parts of the united spans of ``a`` that no span of ``b`` covers: a sweep over the edges."""
    def edges(df: DataFrame, side: str) -> DataFrame:
        u = merge(df, by, start, end)
        other = "b" if side == "a" else "a"
        up = u.select(*by, F.col(start).alias("at"), F.lit(1).alias(f"d{side}"), F.lit(0).alias(f"d{other}"))
        down = u.select(*by, F.col(end).alias("at"), F.lit(-1).alias(f"d{side}"), F.lit(0).alias(f"d{other}"))
        return up.union(down).select(*by, "at", "da", "db")

    sums = edges(a, "a").union(edges(b, "b")).groupBy(*by, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*by).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select(*by, F.col("at").alias(start), F.lead("at").over(w).alias(end), F.sum("da").over(upto).alias("in_a"), F.sum("db").over(upto).alias("in_b"))
    return merge(cut.filter("in_a > 0 and in_b = 0").select(*by, start, end), by, start, end).drop("n_spans")


def runs(df: DataFrame, by: list[str], order: list[str], flag: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows for which ``flag`` holds, of at least ``least`` rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    found = islands(marked, by, order, F.col("__flag") != F.lag("__flag").over(w))
    at = order[0]
    return found.filter("__flag").groupBy(*by, "island").agg(F.min(at).alias("run_from"), F.max(at).alias("run_to"), F.count("*").alias("n_rows")).filter(F.col("n_rows") >= least).drop("island")


def step_runs(df: DataFrame, by: list[str], at: str, value: str, step) -> DataFrame:
    """Runs of rows that are exactly ``step`` apart, with the largest value and where it was first."""
    w = Window.partitionBy(*by).orderBy(at)
    found = islands(df, by, [at], F.col(at) - F.lag(at).over(w) != step)
    top = F.max(F.struct(F.col(value), (-F.col(at)).alias("neg"))).alias("top")
    out = found.groupBy(*by, "island").agg(F.min(at).alias("run_from"), F.max(at).alias("run_to"), F.count("*").alias("n_rows"), top)
    return out.select(*by, "run_from", "run_to", "n_rows", F.col(f"top.{value}").alias("max_value"), (-F.col("top.neg")).alias("max_at"))


def bursts(df: DataFrame, by: list[str], at: str, tie: str, k: int, within) -> DataFrame:
    """Rows from which the k-th following row is at most ``within`` away."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    return df.withColumn("burst_to", F.lead(at, k - 1).over(w)).filter(F.col("burst_to") - F.col(at) <= within)


def layout(df: DataFrame, by: list[str], order: str, duration: Column, gap, head) -> DataFrame:
    """Lay rows one after another: running start and end with a gap between and a head before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(duration + F.lit(gap)).over(w), F.lit(0)) + F.lit(head)
    return df.withColumn("start", start).withColumn("end", F.col("start") + duration)


def slots(df: DataFrame, by: list[str], start: str, stop: Column) -> DataFrame:
    """A row's slot goes to the next row's start, the last one's to ``stop``."""
    w = Window.partitionBy(*by).orderBy(start)
    return df.withColumn("slot_end", F.coalesce(F.lead(start).over(w), stop))
