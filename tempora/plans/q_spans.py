"""Queries on spans and runs of events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.sem import micros, six
from tempora.operators import intervals as iv
from tempora.operators import joins as jo

from .catalog import query

SEC, MIN, HOUR = 1_000_000, 60_000_000, 3_600_000_000


def events(spark, sf, kind=None):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e if kind is None else e.filter(F.col("event_type") == kind)
    return e.select("user_id", "event_id", "event_type", "value", micros("ts").alias("us"))


def spans(spark, sf, kind=None, scale=60):
    """An event lasts as many minutes as its value says."""
    return events(spark, sf, kind).select("user_id", F.col("us").alias("s"), (F.col("us") + F.floor("value").cast("long") * F.lit(scale * SEC)).alias("e"))


EV = "ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us FROM events)"
SP = "sp AS (SELECT user_id, us AS s, us + floor(value)::BIGINT * 60000000 AS e FROM ev)"


def _merged(op: str, gap: int) -> str:
    return f"""WITH {EV}, {SP}, f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {op} {gap} THEN 0 ELSE 1 END AS n FROM sp),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n_spans FROM g GROUP BY user_id, i"""


@query(f"WITH {EV}, g AS (SELECT user_id, us AS gap_from, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap_to FROM ev) SELECT *, gap_to - gap_from AS gap FROM g WHERE gap_to - gap_from >= {6 * HOUR}")
def silence_gaps(spark, sf):
    return iv.gaps(events(spark, sf), ["user_id"], "us", "event_id", 6 * HOUR)


@query(_merged("<", 90 * MIN))
def merge_windows_strict(spark, sf):
    return iv.merge(spans(spark, sf), ["user_id"], "s", "e", 90 * MIN, strict=True)


@query(_merged("<=", 0))
def merge_windows_touch(spark, sf):
    return iv.merge(spans(spark, sf), ["user_id"], "s", "e")


@query(f"WITH m AS ({_merged('<=', 0)}), c AS (SELECT user_id, e AS free_from, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS free_to FROM m) SELECT * FROM c WHERE free_to IS NOT NULL")
def interval_complement(spark, sf):
    return iv.complement(spans(spark, sf), ["user_id"], "s", "e")


def _of(kind: str, name: str) -> str:
    return _merged("<=", 0).replace("FROM sp)", f"FROM sp WHERE k = '{kind}')").replace("SELECT user_id, us AS s,", "SELECT event_type AS k, user_id, us AS s,")


@query(f"""WITH a AS ({_of('purchase', 'a')}), b AS ({_of('error', 'b')}),
p AS (SELECT user_id, s AS edge FROM a UNION SELECT user_id, e FROM a UNION SELECT user_id, s FROM b UNION SELECT user_id, e FROM b),
q AS (SELECT user_id, edge AS s, lead(edge) OVER (PARTITION BY user_id ORDER BY edge) AS e FROM p),
r AS (SELECT q.* FROM q JOIN a ON a.user_id = q.user_id AND a.s <= q.s AND q.e <= a.e AND q.s < q.e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = q.user_id AND b.s <= q.s AND q.e <= b.e)),
f AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY user_id ORDER BY s) THEN 0 ELSE 1 END AS n FROM r),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i""")
def interval_difference(spark, sf):
    real = lambda k: spans(spark, sf, k).filter("e > s")
    return iv.difference(real("purchase"), real("error"), ["user_id"], "s", "e")


@query(f"WITH {EV} SELECT c.user_id, c.event_id, c.us FROM ev c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND c.us BETWEEN p.us AND p.us + floor(p.value)::BIGINT * 60000000)")
def interval_semi(spark, sf):
    return jo.covered(events(spark, sf, "click"), spans(spark, sf, "purchase"), ["user_id"], "us", "s", "e", 6 * HOUR).select("user_id", "event_id", "us")


@query(f"""WITH {EV}, f AS (SELECT *, event_type IN ('error', 'view') AS k FROM ev),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS i FROM f)
SELECT user_id, min(us) AS run_from, max(us) AS run_to, count(*) AS n_rows FROM g WHERE k GROUP BY user_id, i HAVING count(*) >= 2""")
def flag_runs(spark, sf):
    return iv.runs(events(spark, sf), ["user_id"], ["us", "event_id"], F.col("event_type").isin("error", "view"), 2)


@query(f"""WITH {EV}, f AS (SELECT *, value > 30 AS k, lag(value) OVER w AS v0, lag(us) OVER w AS u0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS i FROM f)
SELECT user_id, floor(min(CASE WHEN v0 <= 30 THEN u0 + (us - u0) * (30 - v0) / (value - v0) ELSE us END) + 0.5)::BIGINT AS edge, max(value) AS peak, count(*) AS n_rows FROM g WHERE k GROUP BY user_id, i HAVING max(value) >= 60""")
def threshold_runs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf).withColumns({"k": F.col("value") > 30, "v0": F.lag("value").over(w), "u0": F.lag("us").over(w)})
    e = iv.islands(e, ["user_id"], ["us", "event_id"], F.col("k") != F.lag("k").over(w))
    edge = F.when(F.col("v0") <= 30, F.col("u0") + (F.col("us") - F.col("u0")) * (30 - F.col("v0")) / (F.col("value") - F.col("v0"))).otherwise(F.col("us").cast("double"))
    out = e.filter("k").groupBy("user_id", "island").agg(F.floor(F.min(edge) + 0.5).cast("long").alias("edge"), F.max("value").alias("peak"), F.count("*").alias("n_rows"))
    return out.filter("peak >= 60").drop("island")


@query(f"WITH {EV}, b AS (SELECT user_id, event_id, us, lead(us, 2) OVER (PARTITION BY user_id ORDER BY us, event_id) AS burst_to FROM ev) SELECT * FROM b WHERE burst_to - us <= {4 * HOUR}")
def burst_k_in_window(spark, sf):
    return iv.bursts(events(spark, sf), ["user_id"], "us", "event_id", 3, 4 * HOUR).select("user_id", "event_id", "us", "burst_to")


HOURLY = f"h AS (SELECT event_type, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY ALL)"


def hourly(spark, sf):
    return events(spark, sf).groupBy("event_type", F.floor(F.col("us") / F.lit(HOUR)).cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, {HOURLY}, f AS (SELECT *, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM h)
SELECT event_type, min(hour) AS run_from, max(hour) AS run_to, count(*) AS n_rows, max(n) AS max_value, arg_min(hour, (-n, hour)) AS max_at FROM f GROUP BY event_type, i""")
def pair_runs_step(spark, sf):
    return iv.step_runs(hourly(spark, sf), ["event_type"], "hour", "n", 1)


@query(f"""WITH {EV}, {HOURLY}, b AS (SELECT event_type, hour, lag(hour) OVER w AS p, lead(hour) OVER w AS q FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, hour FROM b WHERE (p IS NULL OR p < hour - 1) AND (q IS NULL OR q > hour + 1) AND hour > (SELECT min(hour) FROM h) AND hour < (SELECT max(hour) FROM h)""")
def isolated_presence(spark, sf):
    h = hourly(spark, sf)
    ends = h.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    alone = iv.step_runs(h, ["event_type"], "hour", "n", 1).filter("n_rows = 1").select("event_type", F.col("run_from").alias("hour"))
    return alone.join(F.broadcast(ends)).filter("hour > lo and hour < hi").select("event_type", "hour")


CONV = "SELECT conv_id, turn, length(text) AS n FROM conversations"


@query(f"WITH c AS ({CONV}), l AS (SELECT *, 400 + coalesce(sum(n + 250) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c) SELECT conv_id, turn, start, start + n AS \"end\" FROM l")
def layout_running(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return iv.layout(c, ["conv_id"], "turn", F.col("n"), 250, 400).select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH c AS ({CONV}), l AS (SELECT *, 400 + coalesce(sum(n + 250) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c),
s AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), start + n + 400) AS slot_end FROM l)
SELECT conv_id, turn, slot_end, floor(n::DOUBLE / (slot_end - start) * 1e6 + 0.5) / 1e6 AS fill, CASE WHEN n < 0.6 * (slot_end - start) THEN 'loose' WHEN n <= 0.9 * (slot_end - start) THEN 'good' ELSE 'tight' END AS state FROM s""")
def slots_lead(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    s = iv.slots(iv.layout(c, ["conv_id"], "turn", F.col("n"), 250, 400), ["conv_id"], "start", F.col("end") + 400)
    size = F.col("slot_end") - F.col("start")
    state = F.when(F.col("n") < 0.6 * size, "loose").when(F.col("n") <= 0.9 * size, "good").otherwise("tight")
    return s.select("conv_id", "turn", F.col("slot_end").cast("long").alias("slot_end"), six(F.col("n") / size).alias("fill"), state.alias("state"))


@query(f"WITH c AS ({CONV}), s AS (SELECT *, lead(n) OVER (PARTITION BY conv_id ORDER BY turn) AS slot FROM c) SELECT conv_id, turn, CASE WHEN slot IS NULL THEN 'last' WHEN n <= slot THEN 'fits' WHEN n <= 1.25 * slot THEN 'faster' ELSE 'refused' END AS decision, floor(greatest(1.0, n::DOUBLE / slot) * 1e6 + 0.5) / 1e6 AS factor FROM s")
def fit_slot_decision(spark, sf):
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    c = c.withColumn("slot", F.lead("n").over(Window.partitionBy("conv_id").orderBy("turn")))
    d = F.when(F.col("slot").isNull(), "last").when(F.col("n") <= F.col("slot"), "fits").when(F.col("n") <= 1.25 * F.col("slot"), "faster").otherwise("refused")
    return c.select("conv_id", "turn", d.alias("decision"), six(F.greatest(F.lit(1.0), F.col("n") / F.col("slot"))).alias("factor"))


def _asof(sign: str, order: str) -> str:
    return f"""WITH {EV} SELECT p.user_id, p.us, p.event_id, coalesce(m.us, -1) AS match_at, coalesce(m.event_id, -1) AS match_event_id FROM ev p LEFT JOIN LATERAL (
SELECT us, event_id FROM ev v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.us {sign} p.us ORDER BY {order} LIMIT 1) m ON true WHERE p.event_type = 'purchase'"""


@query(_asof("<=", "v.us DESC, v.event_id DESC"))
def asof_backward(spark, sf):
    return jo.asof(events(spark, sf, "purchase"), events(spark, sf, "view"), ["user_id"], "us", "event_id", "event_id").fillna(-1, ["match_at", "match_event_id"])


@query(_asof(">=", "v.us, v.event_id"))
def asof_forward(spark, sf):
    return jo.asof(events(spark, sf, "purchase"), events(spark, sf, "view"), ["user_id"], "us", "event_id", "event_id", forward=True).fillna(-1, ["match_at", "match_event_id"])


@query(f"""WITH {EV} SELECT c.user_id, c.us, c.event_id, min(abs(c.us - e.us)) AS distance, arg_min(e.event_id, (abs(c.us - e.us), e.event_id)) AS "match"
FROM ev c JOIN ev e ON c.event_type = 'click' AND e.event_type = 'error' AND c.user_id = e.user_id AND abs(c.us - e.us) <= {2 * HOUR} GROUP BY ALL""")
def nearest_within(spark, sf):
    found = jo.nearest(events(spark, sf, "click"), events(spark, sf, "error"), ["user_id"], "us", "event_id", 2 * HOUR)
    return found.select("user_id", "us", "event_id", "distance", "match")


@query(f"WITH {EV}, o AS (SELECT min(us) AS z FROM ev) SELECT event_id, least(3, (us - z) // {7 * 24 * HOUR}) AS tile FROM ev, o")
def point_in_tile(spark, sf):
    e = events(spark, sf)
    week = 7 * 24 * HOUR
    tiles = e.agg(F.min("us").alias("z")).select("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("tile"))
    tiles = tiles.select("tile", (F.col("z") + F.col("tile") * week).alias("s"), (F.col("z") + (F.col("tile") + 1) * week).alias("e"))
    # weeks begin on days: a point can only lie in the tile of its day's first or last microsecond
    day = lambda c: F.floor(c / F.lit(24 * HOUR)).cast("long")
    parts = tiles.withColumn("day", F.explode(F.sequence(day(F.col("s")), day(F.col("e"))))).withColumn("s", F.greatest("s", F.col("day") * 24 * HOUR)).withColumn("e", F.least("e", (F.col("day") + 1) * 24 * HOUR)).filter("s < e")
    points = e.withColumn("day", day(F.col("us"))).select("day", "us", "event_id")
    found = jo.in_tile(points, parts, ["day"], "us", "s", "e", "tile")
    return found.select("event_id", F.coalesce("tile", F.lit(3)).cast("long").alias("tile"))


@query(f"""WITH {EV}, d AS (SELECT us // {24 * HOUR} AS day, count(*) AS n FROM ev GROUP BY 1), m AS (SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT - n AS base FROM d)
SELECT event_id, floor((base + n * ((us % {24 * HOUR})::DOUBLE / {24 * HOUR})) * 1e6 + 0.5) / 1e6 AS mapped FROM ev JOIN m ON day = us // {24 * HOUR}""")
def piecewise_remap(spark, sf):
    from pyspark.sql import Window

    day = F.floor(F.col("us") / F.lit(24 * HOUR)).cast("long")
    e = events(spark, sf).withColumn("day", day)
    knots = e.groupBy("day").agg(F.count("*").alias("n"))  # a row for each day
    knots = knots.withColumn("base", F.sum("n").over(Window.orderBy("day")) - F.col("n"))
    return e.join(knots, "day").select("event_id", six(F.col("base") + F.col("n") * ((F.col("us") % F.lit(24 * HOUR)).cast("double") / F.lit(24 * HOUR))).alias("mapped"))
