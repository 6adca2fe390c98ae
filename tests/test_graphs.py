import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import graphs as gr


def closure(edges):
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            return reach
        reach = more


def levels(nodes, edges):
    level = {}
    while True:
        new = {n: 1 + max((level[b] for a, b in edges if a == n), default=-1) for n in nodes if n not in level and all(b in level for a, b in edges if a == n)}
        if not new:
            return {n: level.get(n) for n in nodes}
        level |= new


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(18)]
    edges = {(nodes[i], nodes[j]) for i, j in ((r.randrange(18), r.randrange(18)) for _ in range(22)) if i > j or r.random() < 0.08}
    e = spark.createDataFrame(sorted(edges) or [("x", "y")], "node string, needs string")
    assert {tuple(x) for x in gr.ancestors(e).collect()} == closure(edges)
    assert {x.node for x in gr.cycle_members(e).collect()} == {a for a, b in closure(edges) if a == b}
    got = {x.node: x.level for x in gr.topological(spark.createDataFrame([(n,) for n in nodes], "node string"), e).collect()}
    assert got == levels(nodes, edges)
    seeds = spark.createDataFrame([("n3",), ("n5",)], "node string")
    assert {x.node for x in gr.dependents(e, seeds).collect()} == {a for a, b in closure(edges) if b in ("n3", "n5")} - {"n3", "n5"}


def test_a_long_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(150)], "node int, needs int")
    got = {x.node: x.level for x in gr.topological(spark.range(151).select(F.col("id").cast("int").alias("node")), e).collect()}
    assert got == {i: i for i in range(151)}


def test_owners(spark):
    owns = spark.createDataFrame([("a", "/x/y"), ("b", "/x"), ("c", "/x/yy"), ("d", "/x/y/z/"), ("a", "/q")], "node string, path string")
    e = spark.createDataFrame([("a", "b"), ("d", "c")], "node string, needs string")
    got = {(x.a, x.b) for x in gr.unordered_owners(owns, e).collect()}
    assert got == {("a", "d"), ("b", "c"), ("b", "d")}


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None, "r", 5), (2, 1, "a", 7), (3, 1, "a", 1), (4, 3, " ", 2)], "node int, parent int, name string, value int")
    assert sorted((x.node, x.depth, x.total) for x in gr.subtree_sums(nodes, "value").collect()) == [(1, 0, 15), (2, 1, 7), (3, 1, 3), (4, 2, 2)]
    assert [(x.name, x.n) for x in gr.name_collisions(nodes, [], "name").collect()] == [("a", 2)]


def full(m):
    return np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]])


def test_matrices(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=12).tolist(), r.normal(size=12).tolist()
    df = spark.createDataFrame([(a, b, [-1.0, -2.0, -3.0, 4.0, 5.0, 6.0])], "a array<double>, b array<double>, box array<double>")
    row = df.select(gr.mul(F.col("a"), F.col("b")).alias("m"), gr.transform_bounds(F.col("a"), F.col("box")).alias("t")).first()
    assert np.allclose(row.m, (full(a) @ full(b))[:3].ravel())
    corners = np.array([full(a) @ [x, y, z, 1] for x, y, z in itertools.product((-1, 4), (-2, 5), (-3, 6))])[:, :3]
    assert np.allclose(row.t, [*corners.min(0), *corners.max(0)])
    refs = spark.createDataFrame([("root", "sub", a), ("sub", "leaf", b), ("root", "leaf", b)], "parent string, child string, m array<double>")
    got = sorted((tuple(x.path), x.m) for x in gr.placed_parts(refs, "root").collect())
    assert [p for p, _ in got] == [("root", "leaf"), ("root", "sub", "leaf")] and np.allclose(got[1][1], (full(a) @ full(b))[:3].ravel())
    with pytest.raises(Exception, match="refers to itself"):
        gr.placed_parts(refs.union(spark.createDataFrame([("sub", "root", a)], refs.schema)), "root").collect()


def test_pictures(spark):
    lines = [("p", np.cos(t), np.sin(t), np.cos(t) * 3 + np.sin(t) * 4) for t in (0.1, 0.9, 2.0)] + [("q", 1.0, 0.0, 1.0), ("q", 1.0, 0.0, 2.0)]
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, a, b, c in lines], "k string, a double, b double, c double")
    got = {x.k: x for x in gr.vanishing_point(df, ["k"]).collect()}
    assert abs(got["p"].x - 3) < 1e-9 and abs(got["p"].y - 4) < 1e-9 and got["q"].x is None
    pts = spark.createDataFrame([("a", 0.5, 0.0, 1.0), ("a", -0.2, 0.3, 1.0), ("b", 1.2, 0.0, 1.0)], "s string, x double, y double, z double")
    got = {x.s: x for x in gr.framing(pts, ["s"], 0.05, 0.2).collect()}
    assert (got["a"].side, round(got["a"].least, 9), got["a"].ok) == ("right", 0.25, True) and not got["b"].ok
    scale = {x.s: x.scale for x in gr.fit_camera(pts, ["s"]).collect()}
    assert scale["a"] == 1 and 1.2 / scale["b"] <= 0.9 < 1.2 / (scale["b"] / 1.05)
