import math

import pytest
from pyspark.sql import functions as F

from tempora.operators import dubbing as du

W = "array<struct<w:string,start:double,end:double>>"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fit(spark):
    cases = [(1.0, 2.0, 0.0, math.inf), (3.0, 3.2, 0.5, 1.0), (3.0, 3.0, 0.5, 1.0), (4.0, 3.0, 0.5, 1.0), (1.0, 6.0, 0.5, 1.0), (2.0, 0.3, 0.5, 1.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, clip double, slot double, least double, most double")
    got = {}
    for i, (_, _, least, most) in enumerate(cases):
        got[i] = df.filter(F.col("i") == i).select(du.fit(F.col("clip"), F.col("slot"), 1.1, least, most, 0.95).alias("f")).first().f
    assert got[0].ok and got[0].factor == 1 and got[0].breath == 1
    assert got[1].ok and got[1].factor == 1.1 and got[1].breath_short
    assert got[2].ok and got[2].factor == 1.1 and abs(got[2].length - 3 / 1.1) < 1e-12
    assert not got[3].ok and abs(got[3].required - 4 / 3) < 1e-12 and got[3].factor is None
    assert got[4].factor == 0.95 and got[4].long_gap and not got[5].ok


def test_fit_lines_is_all_or_nothing(spark):
    slots = spark.createDataFrame([("a", 0, "x", 0.0, 2.0, None), ("a", 1, "y", 2.0, 5.0, None), ("b", 0, "x", 0.0, 1.0, None), ("b", 1, "y", 1.0, 4.0, None), ("b", 2, "z", 4.0, 6.0, None)], "film string, pos int, id string, start double, end double, planned double")
    dub = spark.createDataFrame([("a", "x", 0.0, "X", 0.1, [("hi", 0.0, 0.5)]), ("a", "y", 0.0, "Y", None, None), ("b", "x", 0.0, "X", None, None), ("b", "y", 0.0, "Y", None, None)], f"film string, id string, start double, text string, lead_trim double, words {W}")
    clips = spark.createDataFrame([("a", "x", 1.2), ("a", "y", 2.0), ("b", "x", 3.0), ("b", "y", 1.0)], "film string, id string, duration double")
    got = {(r.film, r.id): r for r in du.fit_lines(slots, dub, clips, ["film"]).collect()}
    assert got["a", "x"].state == "placed" and abs(got["a", "x"].start - 0.1) < 1e-12 and [w.w for w in got["a", "x"].words] == ["hi"]
    assert got["a", "y"].state == "placed" and got["a", "y"].end == 4.0
    assert [got["b", i].state for i in "xyz"] == ["failed", "held", "failed"] and got["b", "y"].start is None
    assert got["b", "x"].required == 3.0 and got["b", "z"].reason == "no dub line"


def test_frozen(spark):
    frozen = spark.createDataFrame([("a", 0, "x", "X", 0.0, 2.0, 9.0), ("a", 1, "y", "Y", 2.0, 5.0, 9.0), ("b", 0, "x", "X", 0.0, 2.0, 9.0), ("b", 1, "y", "Y", 1.5, 5.0, 9.0)], "film string, pos int, id string, text string, start double, end double, film_end double")
    dub = spark.createDataFrame([("a", 0, "x", "X", 0.0, None), ("a", 1, "y", "Y", 0.0, None), ("b", 0, "x", "other", 0.0, None), ("b", 1, "y", "Y", 0.0, None)], f"film string, pos int, id string, text string, start double, words {W}")
    clips = spark.createDataFrame([(f, i, 1.5) for f in "ab" for i in "xy"], "film string, id string, duration double")
    got = {(r.film, r.pos): r for r in du.fit_frozen(frozen, dub, clips, ["film"]).collect()}
    assert got["a", 0].problem is None and got["a", 1].end == 3.5
    assert got["b", 0].problem == "caption differs" and got["b", 1].problem == "bad window" and got["b", 1].start is None


def test_clock(spark):
    base = spark.createDataFrame([("f", 0, "x", 1.0, 2.0), ("f", 1, "y", 3.0, 4.0), ("f", 2, "z", 5.0, 6.0)], "film string, pos int, id string, start double, end double")
    placed = spark.createDataFrame([("f", "x", 2.9), ("f", "z", 6.0)], "film string, id string, end double")
    films = spark.createDataFrame([("f", 8.0)], "film string, duration double")
    deltas = du.gap_deltas(base, placed, ["film"], 0.5)
    assert [(r.id, r.gap and round(r.gap, 9), round(r.delta, 9)) for r in deltas.orderBy("pos").collect()] == [("x", 0.1, 0.4), ("y", None, 0.0), ("z", None, 0.0)]
    pieces = du.time_map(deltas, films, ["film"])
    got = [(r.old_from, r.old_to, round(r.new_from, 9), round(r.new_to, 9)) for r in pieces.orderBy("old_from").collect()]
    assert got == [(0.0, 1.0, 0.0, 1.0), (1.0, 3.0, 1.0, 3.4), (3.0, 5.0, 3.4, 5.4), (5.0, 8.0, 5.4, 8.4)]
    points = spark.createDataFrame([("f", t, "n") for t in (-1.0, 0.5, 2.0, 5.0, 9.0)], "film string, t double, note string")
    assert [round(r.mapped, 9) for r in du.remap(points, pieces, ["film"], "t").orderBy("t").collect()] == [-1.0, 0.5, 2.2, 5.4, 9.4]
    lines = spark.createDataFrame([("f", "x", 1.0, 2.0, [("w", 1.0, 1.5)]), ("f", "y", 3.0, 4.0, None)], f"film string, id string, start double, end double, words {W}")
    moved = {r.id: r for r in du.remap_lines(lines, pieces, ["film"]).collect()}
    assert round(moved["x"].end, 9) == 2.2 and round(moved["x"].words[0].end, 9) == 1.6 and moved["y"].words is None and round(moved["y"].start, 9) == 3.4


def test_caption_spans(spark):
    films = spark.createDataFrame([("f", 10.0, 10), ("g", 4.0, 10)], "film string, duration double, fps int")
    spans = spark.createDataFrame([("f", 2.0, 3.0), ("f", 3.5, 4.04), ("f", 7.0, 8.0), ("g", 0.5, 1.0)], "film string, start double, end double")
    found = du.caption_spans(spans, films, ["film"])
    assert rows(found, "film", "from") == [("f", 0, 20, "shared"), ("f", 20, 41, "lang"), ("f", 41, 70, "shared"), ("f", 70, 80, "lang"), ("f", 80, 100, "shared"), ("g", 0, 10, "lang"), ("g", 10, 40, "shared")]
    up = du.promote(found.filter("film = 'f'"), ["film"], F.col("from") == 41)
    assert rows(up, "from") == [("f", 0, 20, "shared"), ("f", 20, 80, "lang"), ("f", 80, 100, "shared")]
    assert rows(du.span_totals(up, ["film"]), "film") == [("f", 60, 40)]
    assert du.language_ranges(up).count() == 1


def test_moving(spark):
    lines = spark.createDataFrame([("f", 0, "x", 0.0, 1.0, [("a", 0.0, 0.4), ("b", 0.5, 1.0)]), ("f", 1, "y", 2.0, 3.0, None)], f"film string, pos int, id string, start double, end double, words {W}")
    got = {r.id: r for r in du.shift_placed(lines, 1.5, 2.0).collect()}
    assert (got["x"].start, got["y"].start, got["y"].end) == (0.0, 4.0, 5.0)
    with pytest.raises(Exception, match="insertion point"):
        du.shift_placed(lines, 0.5, 2.0).collect()
    got = {r.id: r for r in du.shift_for_pause(lines, ["film"], "x", 0, 0.5).collect()}
    assert got["x"].end == 1.5 and got["x"].words[1].start == 1.0 and got["x"].words[0].end == 0.4 and got["y"].start == 2.5


def test_fill_and_gaps(spark):
    slots = spark.createDataFrame([("f", 0, "x", 0.0, 2.0, 0.0), ("f", 1, "y", 2.0, 8.0, 0.0), ("f", 2, "z", 8.0, 9.0, 0.0)], "film string, pos int, id string, start double, end double, planned double")
    fitted = spark.createDataFrame([("f", "x", 0.0, 1.9, 1.0), ("f", "y", 2.0, 4.0, 1.0), ("f", "z", 8.0, 9.5, 1.1)], "film string, id string, start double, end double, factor double")
    got = {r.id: r for r in du.line_fill(fitted, slots, ["film"]).collect()}
    assert [got[i].gap_state for i in "xyz"] == ["crammed", "sparse", None] and got["z"].squeezed and got["z"].last and got["y"].gap_max == 1.5
    lines = spark.createDataFrame([("f", "x", 0.0, 1.0), ("f", "y", 2.6, 6.0)], "film string, id string, start double, end double")
    plan = spark.createDataFrame([("f", "x", 1500)], "film string, id string, pause_after_ms int")
    gaps = spark.createDataFrame([("f", 1.1, 2.6), ("f", 3.0, 5.0), ("f", 6.0, 8.0)], "film string, from double, to double")
    got = [(r["from"], r.after_id, r.before_id, r.inside, r.is_planned) for r in du.classify_gaps(gaps, lines, plan, ["film"]).orderBy("from").collect()]
    assert got == [(1.1, "x", "y", False, True), (3.0, "y", "y", True, False), (6.0, "y", None, False, False)]
    order = spark.createDataFrame([("f", 0, "x", 0.0, 1.0), ("f", 1, "y", 2.6, 6.0)], "film string, pos int, id string, start double, end double")
    assert [round(r.pause_after_ms) for r in du.picture_gaps(order, plan, ["film"]).orderBy("pos").collect()] == [1600, 0]


def test_layout_rows(spark):
    lines = spark.createDataFrame([("f", 0, "x", 1.0), ("f", 1, "y", 2.0)], "film string, pos int, id string, duration double")
    got = [(r.seq, r.kind, r.id, r.duration) for r in du.concat_segments(lines, ["film"], 0.25).orderBy("seq").collect()]
    assert got == [(0, "silence", None, 0.4), (1, "line", "x", 1.0), (2, "silence", None, 0.25), (3, "line", "y", 2.0), (4, "silence", None, 0.4)]
    before = spark.createDataFrame([("f", 0, "x", 0.0, 1.0), ("f", 1, "y", 1.5, 3.0)], "film string, pos int, id string, start double, end double")
    plan = spark.createDataFrame([("f", 0, "x", True, 100), ("f", 1, "y", False, None)], "film string, pos int, id string, lead boolean, pause_after_ms int")
    slots = du.previous_slots(before, plan.withColumn("pause_after", F.col("pause_after_ms") / 1000), ["film"], 0.7, 0.5)
    assert [round(r.slot, 9) for r in slots.orderBy("pos").collect()] == [1.5, 2.2]
    assert [r.pause_after_ms for r in du.with_handover(plan, before, ["film"]).orderBy("pos").collect()] == [500, None]


def test_edges_of_clips(spark):
    windows = [(i / 100, (i + 1) / 100, -20.0 if 20 <= i < 60 else -90.0) for i in range(100)]
    df = spark.createDataFrame([(1, windows), (2, [(0.0, 0.01, -90.0)]), (3, [])], "id int, w array<struct<start:double,end:double,db:double>>")
    got = {r.id: r for r in df.select("id", du.trim_edges(F.col("w"), F.lit(1.0)).alias("t"), du.decay_end(F.col("w")).alias("d"), du.voiced_span(F.col("w"), F.lit(1.0)).alias("v")).collect()}
    assert (round(got[1].t["from"], 9), round(got[1].t["to"], 9)) == (0.16, 0.64) and got[1].d == 0.6
    assert round(got[1].v["to"], 9) == 0.9 and got[2].t["to"] == 1.0 and got[2].d is None and got[3].t["from"] == 0.0


def test_levels(spark):
    df = spark.createDataFrame([(-20.0, -2.0), (-40.0, None), (float("-inf"), -9.0)], "lufs double, peak double")
    assert [r[0] for r in df.select(du.line_gain(F.col("lufs"))).collect()] == [4.0, 12.0, 0.0]
    assert [r[0] for r in df.select(du.needs_limiter(F.col("peak"), F.lit(4.0))).collect()] == [True, True, False]
    r = df.filter("lufs = -20").select(du.mix_offset(F.col("lufs"), F.col("peak"), F.lit(-16.0), 10.0).alias("m")).first().m
    assert (r.gap, r.offset, r.peak_after, r.over_peak) == (4.0, -6.0, -8.0, None)
    films = spark.createDataFrame([("f", 10.0)], "film string, duration double")
    page = spark.createDataFrame([("f", 2.0, 4.0)], "film string, start double, end double")
    dub = spark.createDataFrame([("f", 3.0, 5.0), ("f", 5.5, 7.0)], "film string, start double, end double")
    s = du.duck_swing(films, page, dub, ["film"]).first()
    assert abs(s.deepest_db + 12.5) < 1e-6 and 3.0 <= s.deepest_at <= 3.05 and abs(s.page_deepest_db + 10) < 1e-6 and 4.0 < s.stacked < 5.7
