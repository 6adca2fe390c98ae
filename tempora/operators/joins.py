"""Ordered joins: as-of, nearest, range and keyed difference, without inequality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, value: str, forward: bool = False) -> DataFrame:
    """Each left row with the last (first) right row at or before (after) it: one union, one window."""
    kind = dict(right.dtypes)[at]
    rows = left.select(*by, at, tie, F.lit(1).alias("__left"), F.lit(None).cast(kind).alias("__at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__value"))
    other = right.select(*by, at, tie, F.lit(0).alias("__left"), F.col(at).alias("__at"), F.col(value).alias("__value"))
    if forward:
        order = [F.col(at).desc(), F.col("__left").asc(), F.col(tie).desc()]
    else:
        order = [F.col(at).asc(), F.col("__left").asc(), F.col(tie).asc()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__left") == 0, F.struct("__at", "__value")), ignorenulls=True).over(w)
    return rows.union(other).withColumn("__seen", seen).filter("__left = 1").select(*by, at, tie, F.col("__seen.__at").alias("match_at"), F.col("__seen.__value").alias(f"match_{value}"))


def near(left: DataFrame, right: DataFrame, by: list[str], at: str, within: int) -> DataFrame:
    """All pairs (right columns as r_*) at most ``within`` apart: an equi-join on buckets of that
    width, each left row looking into its bucket and the two beside it."""
    r = right.select(*by, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in by)).withColumn("__b", F.floor(F.col(f"r_{at}") / within))
    l3 = left.withColumn("__b", F.explode(F.array(*(F.floor(F.col(at) / within) + k for k in (-1, 0, 1)))))
    return l3.join(r, [*by, "__b"]).filter(F.abs(F.col(at) - F.col(f"r_{at}")) <= within).drop("__b")


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, within=None) -> DataFrame:
    """Each left row that has one with its nearest right row, ``within`` reach if given; of equals the
    smallest ``tie``.  All left rows and columns stay, then distance and match (the right row's tie).

    The last right row before and the first behind, by two windows over one union: rows grow with
    neither side's density."""
    ends = right.groupBy(*by, at).agg(F.min(tie).alias("__tie"))
    kinds = dict(left.dtypes)
    rest = [c for c in left.columns if c not in (*by, at)]
    none = F.lit(None)
    found = F.struct(F.col(at).alias("at"), F.col("__tie").alias("tie"))
    r = ends.select(*by, at, *(none.cast(kinds[c]).alias(c) for c in rest), F.lit(0).alias("__left"), found.alias("__seen"))
    l1 = left.select(*by, at, *rest, F.lit(1).alias("__left"), none.cast(r.schema["__seen"].dataType).alias("__seen"))
    rows = l1.unionByName(r)
    for name, order in (("__back", F.asc(at)), ("__ahead", F.desc(at))):
        w = Window.partitionBy(*by).orderBy(order, "__left").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, F.last("__seen", ignorenulls=True).over(w))
    pick = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(at) - F.col(f"{c}.at")).alias("distance"), F.col(f"{c}.tie").alias("match")))
    rows = rows.filter("__left = 1").withColumn("__best", F.least(pick("__back"), pick("__ahead"))).filter("__best is not null")
    rows = rows if within is None else rows.filter(F.col("__best.distance") <= within)
    return rows.select(*left.columns, F.col("__best.distance").alias("distance"), F.col("__best.match").alias("match"))


def in_tile(points: DataFrame, tiles: DataFrame, by: list[str], at: str, start: str, end: str, ident: str) -> DataFrame:
    """Each point with the tile [start, end) that holds it: the last that starts by then.  Points behind
    the last tile's end keep the last tile; points before the first or in a gap have none."""
    t = tiles.select(*by, F.col(start).alias(at), F.col(end).alias("__end"), F.col(ident).alias("__tile"))
    t = t.withColumn("__last", F.lead(at).over(Window.partitionBy(*by).orderBy(at)).isNull())
    kinds, rest = dict(points.dtypes), [c for c in points.columns if c not in (*by, at)]
    r = t.select(*by, at, *(F.lit(None).cast(kinds[c]).alias(c) for c in rest), F.lit(0).alias("__side"), F.struct("__end", "__tile", "__last").alias("__seen"))
    p = points.select(*by, at, *rest, F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__seen"].dataType).alias("__seen"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = r.unionByName(p).withColumn("__seen", F.last("__seen", ignorenulls=True).over(w)).filter("__side = 1")
    held = F.col("__seen.__last") | (F.col(at) < F.col("__seen.__end"))
    return rows.select(*points.columns, F.when(held, F.col("__seen.__tile")).alias("tile"))


def covered(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside any span (both ends included): spans are dealt to the buckets they touch."""
    s = spans.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__b"))
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    same = [p[c] == s[c] for c in [*by, "__b"]]
    cond = (p[at] >= s["__s"]) & (p[at] <= s["__e"])
    for x in same:
        cond = cond & x
    return p.join(s, cond, "left_semi").drop("__b")


def keyed_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each key of either table as keep, changed, added or removed, comparing nulls as values."""
    o = old.select(F.col(key).alias("__o"), F.struct(*columns).alias("__before"))
    n = new.select(F.col(key).alias("__n"), F.struct(*columns).alias("__after"))
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__before").eqNullSafe(F.col("__after")), "keep").otherwise("changed")
    return o.join(n, F.col("__o") == F.col("__n"), "full_outer").select(F.coalesce("__o", "__n").alias(key), state.alias("state"))
