"""Exact values by rank in groups of any size: a histogram first, then the ranks inside one of its bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """Each group's values at given ranks (from 0, as functions of the group's size) of its sorted finite values.

    Values are counted in ``bins`` bins between a group's least and greatest; only those of the bins that
    hold a wanted rank are ordered.  No task orders a group."""
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != float("inf")))
    ends = rows.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins).otherwise(F.lit(1.0))
    rows = _both(rows, F.broadcast(ends), by).withColumn("__bin", F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int"))
    hist = rows.groupBy(*by, "__bin", "__n").agg(F.count("*").alias("__c"))
    hist = hist.withColumn("__before", F.sum("__c").over(Window.partitionBy(*by).orderBy("__bin")) - F.col("__c"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("__n")).cast("long").alias("k")) for name, f in ranks.items()))
    wanted = hist.select(*by, "__bin", "__before", "__c", F.explode(wanted).alias("__w")).filter("__w.k >= __before and __w.k < __before + __c")
    wanted = wanted.select(*by, "__bin", F.col("__w.name").alias("__name"), (F.col("__w.k") - F.col("__before")).alias("__k"))
    inside = rows.join(F.broadcast(wanted.select(*by, "__bin").distinct()), [*by, "__bin"]).groupBy(*by, "__bin", "__v").agg(F.count("*").alias("__c"))
    inside = inside.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*by, "__bin").orderBy("__v")))
    found = inside.join(F.broadcast(wanted), [*by, "__bin"]).filter("__upto > __k")
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))


def _both(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by) if by else a.crossJoin(b)


def rank_rule(p: float, rule: str) -> Callable[[Column], Column]:
    """The rank of a percentile: ``lower`` floor(p (n-1)), ``count`` floor(p n) (the last at most), ``upper_median`` floor(n/2)."""
    return {"lower": lambda n: F.floor(p * (n - 1)), "count": lambda n: F.least(F.floor(p * n), n - 1), "upper_median": lambda n: F.floor(n / 2), "lower_median": lambda n: F.floor((n - 1) / 2)}[rule]


def plausible(rates: DataFrame, by: list[str], rate: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Whether all of a group's rates lie within a band around their upper median."""
    mid = at_ranks(rates, by, rate, {"mid": rank_rule(0.5, "upper_median")})
    ok = (F.col(rate) >= low * F.col("mid")) & (F.col(rate) <= high * F.col("mid"))
    return rates.join(F.broadcast(mid), by).groupBy(*by).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("plausible"))
