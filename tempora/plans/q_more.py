"""Queries of the dubbing, frame, reuse, graph and speech operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions.sem import micros, six
from tempora.operators import checks as ck
from tempora.operators import dubbing as du
from tempora.operators import frames as fr
from tempora.operators import graphs as gr
from tempora.operators import quantiles as qu
from tempora.operators import reuse as ru
from tempora.operators import signal as sg
from tempora.operators import speech as sp

from .catalog import query


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark, sf):
    """Turns of conversations as lines of a film: a second for every 16 characters, a pause of 0.25 between."""
    c = t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").cast("string").alias("id"), (F.length("text") / 16.0).alias("sec"))
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(0.5) + F.coalesce(F.sum(F.col("sec") + 0.25).over(w), F.lit(0.0))
    return c.withColumn("start", start).withColumn("end", F.col("start") + F.col("sec"))


def films(spark, sf):
    return turns(spark, sf).groupBy("conv_id").agg((F.max("end") + 0.5).alias("duration"))


LINES = """l0 AS (SELECT conv_id, turn AS pos, length(text) / 16.0::DOUBLE AS sec FROM conversations),
l AS (SELECT *, 0.5::DOUBLE + coalesce(sum(sec + 0.25::DOUBLE) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l0),
f AS (SELECT conv_id, max(s + sec) + 0.5::DOUBLE AS duration FROM l GROUP BY conv_id)"""
SIX = "floor(({}) * 1e6 + 0.5) / 1e6"


@query(f"WITH {LINES}, d AS (SELECT *, lead(s) OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM l) SELECT conv_id, pos, {SIX.format('n - (s + sec * 1.5::DOUBLE)')} AS gap, {SIX.format('coalesce(greatest(0, 0.5::DOUBLE - (n - (s + sec * 1.5::DOUBLE))), 0)')} AS delta FROM d")
def gap_deltas(spark, sf):
    base = turns(spark, sf)
    placed = base.select("conv_id", "id", (F.col("start") + F.col("sec") * 1.5).alias("end"))
    return du.gap_deltas(base, placed, ["conv_id"], 0.5).select("conv_id", "pos", six(F.col("gap")).alias("gap"), six(F.col("delta")).alias("delta"))


@query(f"""WITH {LINES}, d AS (SELECT l.conv_id, pos, s, coalesce(lead(s) OVER w, duration) AS e, CASE WHEN lead(s) OVER w IS NULL THEN 0 ELSE greatest(0, 0.5::DOUBLE - (lead(s) OVER w - (s + sec * 1.5::DOUBLE))) END AS delta FROM l JOIN f USING (conv_id) WINDOW w AS (PARTITION BY l.conv_id ORDER BY pos)),
m AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT conv_id, pos, {SIX.format('s + before + (e - s) / 2 * ((e - s + delta) / (e - s))')} AS mapped FROM m""")
def middles_remapped(spark, sf):
    base = turns(spark, sf)
    placed = base.select("conv_id", "id", (F.col("start") + F.col("sec") * 1.5).alias("end"))
    pieces = du.time_map(du.gap_deltas(base, placed, ["conv_id"], 0.5), films(spark, sf), ["conv_id"])
    slots = base.join(films(spark, sf), "conv_id").withColumn("e", F.coalesce(du.next_start(["conv_id"]), F.col("duration")))
    points = slots.select("conv_id", "pos", (F.col("start") + (F.col("e") - F.col("start")) / 2).alias("at"))
    return du.remap(points, pieces, ["conv_id"], "at").select("conv_id", "pos", six(F.col("mapped")).alias("mapped"))


@query(f"""WITH {LINES}, d AS (SELECT l.conv_id, pos, sec * 1.2::DOUBLE AS clip, coalesce(lead(s) OVER w, duration) - s AS slot FROM l JOIN f USING (conv_id) WINDOW w AS (PARTITION BY l.conv_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN slot > 0.1 THEN clip / (slot - 0.1::DOUBLE) ELSE 'inf'::DOUBLE END AS eager FROM d)
SELECT conv_id, pos, NOT (clip > slot - 0.1::DOUBLE AND eager > 1.1 + 1e-9 AND clip / slot > 1.1 + 1e-9) AS ok,
CASE WHEN clip > slot - 0.1::DOUBLE AND eager > 1.1 + 1e-9 AND clip / slot > 1.1 + 1e-9 THEN NULL WHEN clip <= slot - 0.1::DOUBLE THEN 1.0 ELSE {SIX.format('least(eager, 1.1::DOUBLE)')} END AS factor FROM k""")
def slot_fits(spark, sf):
    rows = turns(spark, sf).join(films(spark, sf), "conv_id").withColumn("slot", F.coalesce(du.next_start(["conv_id"]), F.col("duration")) - F.col("start"))
    fit = du.fit(F.col("sec") * 1.2, F.col("slot"), 1.1, 0.1)
    return rows.select("conv_id", "pos", fit.alias("f")).select("conv_id", "pos", "f.ok", six(F.col("f.factor")).alias("factor"))


@query(f"""WITH {LINES}, w AS (SELECT conv_id, CASE WHEN pos % 3 = 0 THEN greatest(0, floor(s * 24))::BIGINT END AS a, ceil((s + sec) * 24)::BIGINT AS b FROM l), t AS (SELECT conv_id, floor(duration * 24 + 0.5)::BIGINT AS total FROM f),
c AS (SELECT conv_id, total, least(a, total) AS a, least(b, total) AS b FROM w JOIN t USING (conv_id) WHERE a IS NOT NULL), d AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 24 THEN 0 ELSE 1 END AS n FROM c WHERE b > a),
g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM d), m AS (SELECT conv_id, total, i, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
e AS (SELECT conv_id, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY a) = 1 AND a < 24 THEN 0 ELSE a END AS a, CASE WHEN lead(a) OVER (PARTITION BY conv_id ORDER BY a) IS NULL AND total - b < 24 THEN total ELSE b END AS b FROM m)
SELECT f.conv_id, coalesce(sum(b - a), 0)::BIGINT AS lang_frames, total - coalesce(sum(b - a), 0)::BIGINT AS shared_frames FROM t f LEFT JOIN e USING (conv_id) GROUP BY f.conv_id, total""")
def caption_frames(spark, sf):
    f = films(spark, sf).withColumn("fps", F.lit(24))
    spans = turns(spark, sf).filter("pos % 3 = 0").select("conv_id", "start", "end")
    return du.span_totals(du.caption_spans(spans, f, ["conv_id"]), ["conv_id"]).select("conv_id", F.col("lang_frames").cast("long"), F.col("shared_frames").cast("long"))


BOX = "SELECT vec_id, label, [embedding[1] * 400, embedding[2] * 400, embedding[1] * 400 + abs(embedding[3]) * 300, embedding[2] * 400 + abs(embedding[4]) * 300]::DOUBLE[] AS b FROM embeddings"
W, H = "least(x.b[3], y.b[3]) - greatest(x.b[1], y.b[1])", "least(x.b[4], y.b[4]) - greatest(x.b[2], y.b[2])"


@query(f"""WITH e AS ({BOX}), k AS (SELECT vec_id, label, b, (b[3] - b[1]) * (b[4] - b[2]) AS area FROM e), p AS (SELECT x.label AS frame, x.vec_id AS a, y.vec_id AS b, CASE WHEN {W} > 0 AND {H} > 0 THEN ({W}) * ({H}) ELSE 0 END AS shared, least(x.area, y.area) AS small FROM k x JOIN k y ON x.label = y.label AND x.vec_id < y.vec_id AND x.area > 0 AND y.area > 0)
SELECT frame, array_to_string(list_sort(['t' || a, 't' || b]), ' / ') AS pair, floor(shared + 0.5)::BIGINT AS count FROM p WHERE shared >= 16 AND shared >= 0.1::DOUBLE * small""")
def box_overlap_pairs(spark, sf):
    e = [F.col("embedding")[k].cast("float") for k in range(4)]
    x, y = (e[0] * F.lit(400).cast("float")), (e[1] * F.lit(400).cast("float"))
    x, y = x.cast("double"), y.cast("double")
    box = F.array(x, y, (e[0] * F.lit(400).cast("float") + F.abs(e[2]) * F.lit(300).cast("float")).cast("double"), (e[1] * F.lit(400).cast("float") + F.abs(e[3]) * F.lit(300).cast("float")).cast("double"))
    texts = t(spark, sf, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("i"), F.concat(F.lit("t"), "vec_id").alias("text"), box.alias("box"), F.lit(1.0).alias("alpha"))
    return fr.text_overlaps(texts, [], 64.0)


@query("SELECT part, ('0x' || substr(h, 1, 2))::INT::DOUBLE AS r, ('0x' || substr(h, 3, 2))::INT::DOUBLE AS g, ('0x' || substr(h, 5, 2))::INT::DOUBLE AS b FROM (SELECT p_partkey AS part, substr(md5(p_name), 1, 6) AS h FROM part)")
def colors_read(spark, sf):
    c = fr.css_color(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("part"), c.alias("c")).select("part", "c.r", "c.g", "c.b")


@query("SELECT event_id, greatest(0, ceil(b * 24 - 1e-9) - 1 - ceil(a * 24 - 1e-9) + 1)::BIGINT AS half_open, greatest(0, floor(b * 24 + 1e-9) - ceil(a * 24 - 1e-9) + 1)::BIGINT AS closed FROM (SELECT event_id, value AS a, value + (event_id % 5) * 0.125::DOUBLE AS b FROM events)")
def frames_between(spark, sf):
    a = F.col("value")
    b = a + (F.col("event_id") % 5) * 0.125
    return t(spark, sf, "events").select("event_id", fr.frames_in(a, b, 24).alias("half_open"), fr.frames_in(a, b, 24, True).alias("closed"))


@query("""WITH e AS (SELECT user_id, event_id, value, event_type <> 'error' AS fits FROM events) SELECT user_id, arg_min(event_id, (abs(value - 50), event_id)) AS take FROM e WHERE fits GROUP BY user_id""")
def best_takes(spark, sf):
    takes = t(spark, sf, "events").select("user_id", F.col("event_id").alias("k"), "value", (F.col("event_type") != "error").alias("fits"))
    return ru.choose_take(takes, ["user_id"], F.abs(F.col("value") - 50)).select("user_id", F.col("k").alias("take"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unstamped' WHEN o_orderkey % 3 = 0 THEN 'current' WHEN o_orderkey % 5 = 0 THEN 'stamp moved' WHEN o_orderkey % 2 = 0 THEN 'slot unchanged' ELSE 'stale' END AS state FROM orders""")
def draft_states(spark, sf):
    k = F.col("o_orderkey")
    stamp = F.when(k % 7 != 0, F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("old"))
    probes = F.when(k % 5 != 0, F.array(F.col("o_orderpriority")))
    now = F.array(F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("x"))
    return t(spark, sf, "orders").select("o_orderkey", ru.draft_state(stamp, F.col("o_orderstatus"), probes, now).alias("state"))


RING = "SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation WHERE n_nationkey % 4 <> 1"


def ring(spark, sf):
    n = F.col("n_nationkey").cast("long")
    return t(spark, sf, "nation").filter("n_nationkey % 4 <> 1").select(n.alias("node"), ((n * 7 + 3) % 25).alias("needs"))


@query(f"WITH RECURSIVE e AS ({RING}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a::BIGINT AS node FROM c WHERE a = b")
def cycle_members(spark, sf):
    return gr.cycle_members(ring(spark, sf))


@query(f"WITH RECURSIVE e AS ({RING}), c AS (SELECT a FROM e WHERE b IN (3, 10) UNION SELECT e.a FROM c JOIN e ON e.b = c.a) SELECT a::BIGINT AS node FROM c WHERE a NOT IN (3, 10)")
def dependents(spark, sf):
    return gr.dependents(ring(spark, sf), spark.createDataFrame([(3,), (10,)], "node long"))


@query("""WITH RECURSIVE n AS (SELECT n_nationkey::BIGINT AS node, CASE WHEN n_nationkey > 0 THEN (n_nationkey // 2)::BIGINT END AS parent, n_regionkey::BIGINT AS v FROM nation), u AS (SELECT node, node AS top, 0 AS d FROM n UNION ALL SELECT u.node, n.parent, d + 1 FROM u JOIN n ON n.node = u.top WHERE n.parent IS NOT NULL)
SELECT top AS node, sum(v)::BIGINT AS total, (SELECT max(d) FROM u x WHERE x.node = u.top)::BIGINT AS depth FROM u JOIN n ON n.node = u.node GROUP BY top""")
def subtree_totals(spark, sf):
    n = F.col("n_nationkey").cast("long")
    nodes = t(spark, sf, "nation").select(n.alias("node"), F.when(n > 0, F.floor(n / 2)).cast("long").alias("parent"), F.col("n_regionkey").cast("long").alias("v"))
    return gr.subtree_sums(nodes, "v").select("node", "total", F.col("depth").cast("long").alias("depth"))


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS p FROM lineitem), m AS (SELECT l_suppkey, list_sort(list(p)) AS x FROM r GROUP BY ALL)
SELECT l_suppkey, bool_and(p >= 0.05 * x[len(x) // 2 + 1] AND p <= 2 * x[len(x) // 2 + 1]) AS plausible FROM r JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def plausible_rates(spark, sf):
    return qu.plausible(t(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 0.05, 2.0)


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\{[^{}]*\}|\[[^\[\]]*\]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[ \t\n\x0B\f\r]+([,.;:!?…。、，！？])', '\1', 'g')) AS plain FROM documents""")
def marks_stripped(spark, sf):
    return t(spark, sf, "documents").select("doc_id", sp.strip_marks(F.col("text")).alias("plain"))


@query(r"""SELECT conv_id, turn, lower(regexp_extract(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+$', ''), '([\p{L}\p{N}''’]+)$', 1)) AS ending FROM conversations""")
def line_endings(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", sp.line_ending(F.col("text")).alias("ending"))


@query("SELECT event_id, ((props::JSON->>'k')::BIGINT > 50)::INT + (event_type NOT IN ('click', 'view'))::INT AS n FROM events")
def schema_findings(spark, sf):
    schema = {"type": "object", "required": ["kind"], "properties": {"k": {"type": "integer", "maximum": 50}, "kind": {"enum": ["click", "view"]}}}
    text = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "kind": "'), "event_type", F.lit('"}'))
    return ck.against_schema(t(spark, sf, "events").select("event_id", text.alias("text")), "text", schema).select("event_id", F.size("problems").alias("n"))


def spoken_pairs(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("heard"), F.lit("en").alias("lang"))
    return c.filter("heard is not null")


@query()
def token_diffs(spark, sf):
    """Differences of each turn and the next, word by word; tested against all alignments of short texts."""
    return sp.token_diffs(spoken_pairs(spark, sf), "text", "heard").select("conv_id", "turn", F.size("diffs").alias("n"), F.get(F.col("diffs"), F.lit(0))["want"].alias("first"))


@query()
def normal_forms(spark, sf):
    """Turns in normal form, numbers read; tested in plain Python."""
    return sp.normalized(spoken_pairs(spark, sf), "text", "lang").select("conv_id", "turn", "normal")


@query()
def pack_by_size(spark, sf):
    """Turns of a conversation in groups of at most 600 characters, in order; tested on fixtures."""
    c = t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), F.length("text").alias("size"))
    return sp.group_by_size(c, ["conv_id"], "size", 600)


@query()
def freeze_runs(spark, sf):
    """Vectors as frames of two clips by parity: runs that stay as they are; tested against a plain scan."""
    e = t(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("clip"), F.floor(F.col("vec_id") / 2).cast("long").alias("frame"), F.transform("embedding", lambda x: F.floor(x * 2)).cast("array<float>").alias("gray"))
    return fr.freezes(e, ["clip"], 10.0)


@query()
def spectral_features(spark, sf):
    """Vectors as clips of 64 samples: peak, attack, centroid, flatness; tested against definitions."""
    e = t(spark, sf, "embeddings").select("vec_id", F.lit(64).alias("rate"), F.col("embedding").alias("samples"))
    out = sg.features(e).select("vec_id", "features.*")
    return out.select("vec_id", *(six(F.col(c)).alias(c) for c in ("peak_db", "attack_ms", "brightness_hz", "noisiness")), "pitch_trend")


@query()
def value_excursions(spark, sf):
    """Excursions of users' values over 60 that reach 90, edges interpolated; tested on series."""
    e = t(spark, sf, "events").groupBy("user_id", micros("ts").alias("us")).agg(F.max("value").alias("v"))
    return fr.events(e.select("user_id", (F.col("us") / 3.6e9).alias("t"), "v"), ["user_id"], 60.0, 90.0)
