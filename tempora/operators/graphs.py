"""Dependency graphs and trees as tables of edges (node, needs), for any depth and with cycles.

Rounds double what is known about paths, so that their number grows with the logarithm of the depth;
every round is a join and an aggregation of edges, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.session import cut, discard


def ancestors(edges: DataFrame) -> DataFrame:
    """All (node, ancestor) pairs: what a node needs, directly or not.  On a cycle a node is its own ancestor."""
    reach = cut(edges.select("node", F.col("needs").alias("ancestor")).filter("node is not null and ancestor is not null").distinct(), "reach")
    size = reach.count()
    while True:
        far = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor")
        new = cut(reach.union(far).distinct(), "reach")
        discard(reach)
        reach, before, size = new, size, new.count()
        if size == before:
            return reach


def dependents(edges: DataFrame, names: DataFrame) -> DataFrame:
    """What needs the given nodes, directly or not, without these: rounds from the frontier."""
    e = cut(edges.select("node", "needs").distinct(), "edges")
    seen = cut(names.select("node").distinct(), "seen")
    front = seen
    while True:
        nxt = cut(e.join(front.select(F.col("node").alias("needs")), "needs").select("node").distinct().join(seen, "node", "left_anti"), "front")
        if nxt.isEmpty():
            return seen.join(names.select("node").distinct(), "node", "left_anti")
        seen, front = cut(seen.union(nxt), "seen"), nxt


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's level (0: needs nothing; else one more than the highest level it needs), null on or
    behind a cycle.

    Longest paths by doubling: after k rounds ``far`` holds, for pairs joined by a path of at most 2^k
    steps, the longest of these; a pair (node, node) is a cycle."""
    e = edges.filter("node is not null and needs is not null").join(nodes.select(F.col("node").alias("needs")), "needs").select("node", "needs").distinct()
    far = cut(e.withColumn("steps", F.lit(1).cast("long")), "far")
    looped = F.col("node") == F.col("needs")
    before = None
    while True:
        two = far.alias("a").join(far.alias("b"), F.col("a.needs") == F.col("b.node")).filter("a.node <> a.needs and b.node <> b.needs")
        two = two.select(F.col("a.node").alias("node"), F.col("b.needs").alias("needs"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        # a path that comes back to its start goes on for ever: its length doesn't count
        new = far.union(two).groupBy("node", "needs").agg(F.max("steps").alias("steps")).withColumn("steps", F.when(looped, 1).otherwise(F.col("steps")))
        cyclic = new.filter(looped).select("node").distinct()
        new = cut(new.join(cyclic.withColumnRenamed("node", "needs").withColumn("__c", F.lit(True)), "needs", "left").join(cyclic.withColumn("__d", F.lit(True)), "node", "left").withColumn("steps", F.when(F.col("__c") | F.col("__d"), 1).otherwise(F.col("steps"))).select("node", "needs", "steps"), "far")
        state = new.agg(F.count("*"), F.sum("steps")).first()
        discard(far)
        far = new
        if before == state:
            break
        before = state
    stuck = far.filter(looped).select("node")
    behind = far.join(stuck.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node").union(stuck).distinct().withColumn("__stuck", F.lit(True))
    level = far.groupBy("node").agg(F.max("steps").alias("level"))
    out = nodes.join(level, "node", "left").join(behind, "node", "left")
    return out.select(*nodes.columns, F.when(F.col("__stuck").isNull(), F.coalesce("level", F.lit(0))).alias("level"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that need themselves, directly or not."""
    return ancestors(edges).filter("node = ancestor").select("node")


def unordered_owners(owns: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of stages of which neither needs the other, one of whose paths is the other's or lies inside it.

    Each path names the folders that it lies in; equal names meet in an equi-join."""
    parts = F.filter(F.split(F.regexp_replace("path", "/+", "/"), "/"), lambda x: x != "")
    whole = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(F.col("__p"), F.lit(1), n), "/"))
    rows = owns.select("node", parts.alias("__p"))
    inner = rows.select(F.col("node").alias("a"), whole(F.size("__p")).alias("path_a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("__p")), whole)).alias("path"))
    outer = rows.select(F.col("node").alias("b"), whole(F.size("__p")).alias("path"))
    pairs = inner.join(outer, "path").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("path", "path_a").alias("path"), F.greatest("path", "path_a").alias("inside")).distinct()
    reach = ancestors(edges)
    ordered = reach.select(F.least("node", "ancestor").alias("a"), F.greatest("node", "ancestor").alias("b")).distinct()
    return pairs.join(ordered, ["a", "b"], "left_anti")


def subtree_sums(nodes: DataFrame, value: str) -> DataFrame:
    """Nodes (node, parent, value) of a forest with their depth and the sum over their subtree, by doubling
    over ancestors."""
    up = ancestors(nodes.filter("parent is not null").select("node", F.col("parent").alias("needs")))
    depth = up.groupBy("node").agg(F.count("*").alias("depth"))
    below = up.join(nodes.select("node", F.col(value).alias("__v")), "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("__v").alias("__below"))
    out = nodes.join(depth, "node", "left").join(below, "node", "left")
    return out.select(*nodes.columns, F.coalesce("depth", F.lit(0)).alias("depth"), (F.col(value) + F.coalesce("__below", F.lit(0))).alias("total"))


def name_collisions(nodes: DataFrame, by: list[str], name: str) -> DataFrame:
    return nodes.filter(F.trim(F.col(name)) != "").groupBy(*by, name).agg(F.count("*").alias("n")).filter("n > 1")


# affine 3 x 4 matrices as arrays, row by row


def mul(a: Column, b: Column) -> Column:
    """The map that first does b, then a."""
    cell = lambda r, c: sum((a[r * 4 + k] * b[k * 4 + c] for k in range(3)), F.lit(0.0)) + (a[r * 4 + 3] if c == 3 else F.lit(0.0))
    return F.array(*(cell(r, c) for r in range(3) for c in range(4)))


def moved(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [m[r * 4] * x + m[r * 4 + 1] * y + m[r * 4 + 2] * z + m[r * 4 + 3] for r in range(3)]


def transform_bounds(m: Column, box: Column) -> Column:
    """The axis-parallel box (x0, y0, z0, x1, y1, z1) around a moved box."""
    corners = [moved(m, box[i], box[j], box[k]) for i in (0, 3) for j in (1, 4) for k in (2, 5)]
    return F.array(*(F.least(*(c[d] for c in corners)) for d in range(3)), *(F.greatest(*(c[d] for c in corners)) for d in range(3)))


def placed_parts(refs: DataFrame, root: str, deepest: int = 16) -> DataFrame:
    """Leaves of a tree of references (parent, child, m) from ``root``, each with its whole matrix: level by
    level, an error where a reference comes back to a model above it or the tree is deeper than ``deepest``."""
    identity = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)))
    parents = refs.select(F.col("parent").alias("node")).distinct()
    here = refs.filter(F.col("parent") == root).select("child", mul(identity, F.col("m")).alias("m"), F.array(F.lit(root), F.col("child")).alias("path"))
    leaves = None
    for _ in range(deepest):
        here = cut(here, "level")
        own = here.join(parents, F.col("child") == F.col("node"), "left_anti")
        leaves = own if leaves is None else leaves.union(own)
        inner = here.join(parents, F.col("child") == F.col("node"), "left_semi")
        if inner.isEmpty():
            return leaves.select(F.col("child").alias("part"), "m", "path")
        again = F.array_contains(F.col("path"), F.col("r.child"))
        step = inner.alias("h").join(refs.alias("r"), F.col("h.child") == F.col("r.parent"))
        path = F.when(again, F.raise_error(F.concat(F.lit("refers to itself: "), F.col("r.child"))).cast("array<string>")).otherwise(F.concat("h.path", F.array("r.child")))
        here = step.select(F.col("r.child").alias("child"), mul(F.col("h.m"), F.col("r.m")).alias("m"), path.alias("path"))
    raise ValueError(f"deeper than {deepest} levels")


def vanishing_point(lines: DataFrame, by: list[str]) -> DataFrame:
    """The point nearest to lines a x + b y = c (a^2 + b^2 = 1), by least squares over sums; null for parallel ones."""
    s = lines.groupBy(*by).agg(*(F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "ab", "bb", "ac", "bc")))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ok = F.abs(det) > 1e-12
    return s.select(*by, F.when(ok, (F.col("ac") * F.col("bb") - F.col("bc") * F.col("ab")) / det).alias("x"), F.when(ok, (F.col("aa") * F.col("bc") - F.col("ab") * F.col("ac")) / det).alias("y"))


def framing(points: DataFrame, by: list[str], margin: float = 0.05, center: float | None = None) -> DataFrame:
    """How projected points (x, y in -1..1, z before the eye) lie in a picture: the least distance from an
    edge, which edge that is, and whether they keep the margin and the centre."""
    p = points.filter("z > 0").withColumn("px", F.col("x") / F.col("z")).withColumn("py", F.col("y") / F.col("z"))
    out = p.groupBy(*by).agg((F.min("px") + 1).alias("left"), (1 - F.max("px")).alias("right"), (F.min("py") + 1).alias("bottom"), (1 - F.max("py")).alias("top"), ((F.min("px") + F.max("px")) / 2).alias("middle"))
    edges = F.array(*(F.struct((F.col(s) / 2).alias("d"), F.lit(s).alias("side")) for s in ("left", "right", "bottom", "top")))
    out = out.withColumn("__e", F.array_min(edges))
    centred = F.lit(True) if center is None else F.abs(F.col("middle")) <= center
    return out.select(*by, F.col("__e.d").alias("least"), F.col("__e.side").alias("side"), ((F.col("__e.d") >= margin) & centred).alias("ok"))


def fit_camera(points: DataFrame, by: list[str], margin: float = 0.05, most: float = 8.0, step: float = 1.05) -> DataFrame:
    """The least scale step^k of the distance at which all points keep the margin; null if none up to ``most`` does."""
    import math

    n = math.floor(math.log(most) / math.log(step))
    tried = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("z", F.col("z") * F.pow(F.lit(step), F.col("k")))
    fits = framing(tried, [*by, "k"], margin).filter("ok").groupBy(*by).agg(F.min("k").alias("k"))
    return points.select(*by).distinct().join(fits, by, "left").select(*by, F.pow(F.lit(step), F.col("k")).alias("scale"))
