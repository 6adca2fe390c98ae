"""Queries on keyed tables: differences, aggregates, quantiles, reuse and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions.sem import six
from tempora.operators import graphs as gr
from tempora.operators import joins as jo
from tempora.operators.quantiles import at_ranks, rank_rule

from .catalog import query


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice THEN 'keep' ELSE 'changed' END AS state
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def keyed_diff(spark, sf):
    o = t(spark, sf, "orders")
    new = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return jo.keyed_diff(o.filter("o_orderkey % 10 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_pending(spark, sf):
    return t(spark, sf, "part").select("p_partkey").join(t(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS sel, lag(o_orderstatus = 'F') OVER w AS p, lead(o_orderstatus = 'F') OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey FROM s WHERE NOT sel AND (coalesce(p, false) OR coalesce(q, false))")
def neighbours(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    sel = F.col("o_orderstatus") == "F"
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", sel.alias("sel"), F.lag(sel).over(w).alias("p"), F.lead(sel).over(w).alias("q"))
    return o.filter("not sel and (coalesce(p, false) or coalesce(q, false))").select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, floor(sum(l_quantity)) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, min(n) = max(n) AS equal_counts, count(*) AS tracks, max(q) - min(q) AS max_delta FROM c GROUP BY l_orderkey""")
def n_way_track_compare(spark, sf):
    c = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.floor(F.sum("l_quantity")).cast("double").alias("q"))
    return c.groupBy("l_orderkey").agg((F.min("n") == F.max("n")).alias("equal_counts"), F.count("*").alias("tracks"), (F.max("q") - F.min("q")).alias("max_delta"))


@query("""SELECT coalesce(o_orderpriority, 'total') AS stage, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS cost, count(DISTINCT o_orderstatus) AS flags, count(*) FILTER (WHERE o_totalprice > 200000) AS dear FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def stage_cost_report(spark, sf):
    out = t(spark, sf, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), (F.floor(F.sum("o_totalprice") * 100 + 0.5) / 100).alias("cost"), F.count_distinct("o_orderstatus").alias("flags"), F.count_if(F.col("o_totalprice") > 200000).alias("dear"))
    return out.select(F.coalesce("o_orderpriority", F.lit("total")).alias("stage"), "n", "cost", "flags", "dear")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS no_cost, floor(coalesce(sum(CASE WHEN l_discount <> 0 THEN l_extendedprice END), 0) * 100 + 0.5) / 100 AS cost FROM lineitem GROUP BY ALL")
def usage_rollup(spark, sf):
    cost = F.when(F.col("l_discount") != 0, F.col("l_extendedprice"))
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") == 0).alias("no_cost"), (F.floor(F.coalesce(F.sum(cost), F.lit(0.0)) * 100 + 0.5) / 100).alias("cost"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, max((props::JSON->>'k')::BIGINT) AS most FROM events GROUP BY ALL")
def props_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("""WITH a AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY ALL), n AS (SELECT *, len(x) AS n FROM a)
SELECT l_returnflag, x[floor(0.95 * (n - 1))::BIGINT + 1] AS lower95, x[least(floor(0.95 * n)::BIGINT, n - 1) + 1] AS count95, x[n // 2 + 1] AS upper_median, floor(median * 1e6 + 0.5) / 1e6 AS true_median FROM n JOIN (SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL) USING (l_returnflag)""")
def nearest_rank_rules(spark, sf):
    ranks = {"lower95": rank_rule(0.95, "lower"), "count95": rank_rule(0.95, "count"), "upper_median": rank_rule(0.5, "upper_median"), "low": rank_rule(0.5, "lower_median")}
    out = at_ranks(t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", ranks)
    return out.select("l_returnflag", "lower95", "count95", "upper_median", six((F.col("low") + F.col("upper_median")) / 2).alias("true_median"))


@query("""WITH h AS (SELECT l_quantity::BIGINT AS bin, count(*) AS c FROM lineitem GROUP BY 1), u AS (SELECT bin, c, sum(c) OVER (ORDER BY bin) AS upto, sum(c) OVER () AS n FROM h)
SELECT share, min(bin) AS bin FROM u, (VALUES (0.1::DOUBLE), (0.5), (0.9)) s(share) WHERE upto >= share * n GROUP BY share""")
def hist_quantile(spark, sf):
    h = t(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("bin")).agg(F.count("*").alias("c"))
    u = h.select("bin", F.sum("c").over(Window.orderBy("bin")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))  # a row for each bin
    return u.select("*", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("share")).filter("upto >= share * n").groupBy("share").agg(F.min("bin").alias("bin"))


@query("""WITH e AS (SELECT user_id, value, 10 * log10(value * value + 1e-9) - 30 AS l FROM events), a AS (SELECT * FROM e WHERE l > -20),
m AS (SELECT user_id, 10 * log10(avg(pow(10, l / 10))) - 10 AS gate FROM a GROUP BY user_id)
SELECT user_id, floor(10 * log10(avg(pow(10, l / 10))) * 1e6 + 0.5) / 1e6 AS level, count(*) AS n FROM a JOIN m USING (user_id) WHERE l > gate GROUP BY user_id""")
def gated_energy_mean(spark, sf):
    level = lambda: 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("l") / 10)))
    e = t(spark, sf, "events").select("user_id", (10 * F.log10(F.col("value") * F.col("value") + 1e-9) - 30).alias("l")).filter("l > -20")
    gate = e.groupBy("user_id").agg((level() - 10).alias("gate"))
    return e.join(gate, "user_id").filter("l > gate").groupBy("user_id").agg(six(level()).alias("level"), F.count("*").alias("n"))


@query("SELECT s_nationkey, floor((max(s_acctbal) - min(s_acctbal)) * 1e6 + 0.5) / 1e6 AS spread, max(s_acctbal) - min(s_acctbal) > 5000 AS warn FROM supplier WHERE isfinite(s_acctbal) GROUP BY ALL")
def spread_finite(spark, sf):
    x = F.col("s_acctbal")
    s = t(spark, sf, "supplier").filter(~F.isnan(x) & (F.abs(x) != float("inf")))
    return s.groupBy("s_nationkey").agg(six(F.max(x) - F.min(x)).alias("spread"), (F.max(x) - F.min(x) > 5000).alias("warn"))


@query("SELECT source, count(*) AS n, floor(avg(quality) * 1e6 + 0.5) / 1e6 AS mean, min(quality) < 1 AND max(quality) >= 1 AS straddles FROM documents JOIN labels USING (doc_id) GROUP BY source")
def summarize_near_line(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), six(F.avg("quality")).alias("mean"), ((F.min("quality") < 1) & (F.max("quality") >= 1)).alias("straddles"))


@query("""SELECT o_orderkey, CASE WHEN s.k IS NULL THEN 'render: nothing stored' WHEN s.st IS DISTINCT FROM o_orderstatus THEN 'render: status' WHEN s.price IS DISTINCT FROM o_totalprice THEN 'render: price' ELSE 'reuse' END AS decision
FROM orders LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice - 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 5 <> 0) s ON k = o_orderkey""")
def reuse_decision(spark, sf):
    o = t(spark, sf, "orders")
    stored = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("st"), F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")).alias("price"))
    why = F.when(F.col("k").isNull(), "render: nothing stored").when(~F.col("st").eqNullSafe(F.col("o_orderstatus")), "render: status").when(~F.col("price").eqNullSafe(F.col("o_totalprice")), "render: price").otherwise("reuse")
    return o.join(stored, F.col("k") == F.col("o_orderkey"), "left").select("o_orderkey", why.alias("decision"))


def half_edges(spark, sf):
    """Each nation needs the one of half its number."""
    key = F.col("n_nationkey").cast("long")
    return t(spark, sf, "nation").filter("n_nationkey > 0").select(key.alias("node"), F.floor(key / 2).cast("long").alias("needs"))


EDGES = "SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0"


@query(f"WITH RECURSIVE e AS ({EDGES}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a::BIGINT AS a, b::BIGINT AS b FROM c")
def closure(spark, sf):
    return gr.ancestors(half_edges(spark, sf)).select(F.col("node").alias("a"), F.col("ancestor").alias("b"))


@query(f"WITH RECURSIVE e AS ({EDGES}), l AS (SELECT 0 AS node, 0 AS lvl UNION ALL SELECT e.a, lvl + 1 FROM l JOIN e ON e.b = l.node) SELECT node::BIGINT AS node, max(lvl)::BIGINT AS lvl FROM l GROUP BY node")
def topo_levels(spark, sf):
    nodes = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return gr.topological(nodes, half_edges(spark, sf)).select("node", F.col("level").cast("long").alias("lvl"))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(s_suppkey) AS suppliers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def tree_rollup(spark, sf):
    leaf = t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("c"))
    n = t(spark, sf, "nation").join(leaf, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    r = t(spark, sf, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return r.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("suppliers"))
