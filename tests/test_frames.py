import random

from pyspark.sql import functions as F

from tempora.operators import frames as fr

BOX = "array<double>"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_overlaps_are_those_of_all_pairs(spark):
    r = random.Random(1)
    texts = []
    for frame in range(4):
        for i in range(25):
            x, y, w, h = (r.uniform(-300, 900) for _ in range(2)), None, r.uniform(0, 400), r.uniform(0, 300)
            x, y = x
            texts.append(("c", frame, i, f"t{r.randrange(12)}", [x, y, x + w, y + h], r.choice([0.04, 0.05, 1.0])))
    df = spark.createDataFrame(texts, f"clip string, frame int, i int, text string, box {BOX}, alpha double")
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    want = []
    for a in texts:
        for b in texts:
            if a[1] == b[1] and a[2] < b[2] and a[3] != b[3] and min(a[5], b[5]) >= 0.05:
                w, h = min(a[4][2], b[4][2]) - max(a[4][0], b[4][0]), min(a[4][3], b[4][3]) - max(a[4][1], b[4][1])
                s = w * h if w > 0 and h > 0 else 0
                if s >= 16 and s >= 0.1 * min(area(a[4]), area(b[4])):
                    want.append(("c", a[1], " / ".join(sorted([a[3], b[3]])), int(s + 0.5)))
    assert rows(fr.text_overlaps(df, ["clip"]), "frame", "pair", "count") == sorted(want, key=lambda x: (x[1], x[2], x[3]))
    spans = fr.text_overlap_spans(spark.createDataFrame([("c", f, i, t, [0.0, 0.0, 50.0, 50.0], 1.0) for f in (0, 3, 6, 12) for i, t in enumerate("ab")], df.schema), ["clip"], 3)
    assert sorted((x.run_from, x.run_to, x.n_rows) for x in spans.collect()) == [(0, 6, 3), (12, 12, 1)]


def test_regions(spark):
    films = spark.createDataFrame([("f", 20.0)], "film string, duration double")
    regions = spark.createDataFrame([
        ("f", "k", "key", [0.0, 0.0, 100.0, 100.0], None, None, None, None), ("f", "l", "label", [90.0, 90.0, 200.0, 200.0], None, 3.0, 12.0, None), ("f", None, "overlay", [0.0, 0.0, 10.0, 10.0], 4.0, None, None, None),
        ("f", "r", "reserve", [300.0, 300.0, 400.0, 400.0], None, 1.0, 2.0, "own"),
    ], f"film string, id string, kind string, box {BOX}, outline double, from double, to double, text string")
    got = {r.label: r for r in fr.region_covers(regions, films, ["film"]).collect()}
    assert (got["l"]["from"], got["l"].to, got["l"].pixels, got["l"].share_of_key, got["l"].always_on) == (3.0, 12.0, 100, 0.01, False)
    assert got["overlay"].pixels == 144 and got["overlay"].always_on and len(got) == 2
    texts = spark.createDataFrame([("f", f, "t", [350.0, 350.0, 390.0, 390.0], 1.0) for f in (29, 30, 45, 59, 60)] + [("f", 40, "own", [310.0, 310.0, 390.0, 390.0], 1.0)], f"film string, frame int, text string, box {BOX}, alpha double")
    assert rows(fr.reserve_intrusions(texts, regions, ["film"], 30)) == [("f", "r", "t", 1.0, 2.0, 3, 1600)]


def test_keys(spark):
    texts = spark.createDataFrame([("c", f, "a", 1.0) for f in (0, 1, 3, 4)] + [("c", 2, "b", 1.0), ("c", 2, "a", 0.01), ("c", 4, " ", 1.0)], "clip string, frame int, text string, alpha double")
    layers = spark.createDataFrame([("c", 0, "x", None), ("c", 1, "x", 0.01)], "clip string, frame int, id string, opacity double")
    keys = fr.visible_keys(texts, layers, ["clip"])
    assert keys.count() == 6
    frames = spark.createDataFrame([("c", f) for f in range(5)], "clip string, frame int")
    assert rows(fr.flicker(keys, frames, ["clip"]), "frame") == [("c", "text b", 2, 1)]
    more = spark.createDataFrame([("c", 1, "ab ", 1.0, "F"), ("c", 2, "xb", 1.0, "F"), ("c", 2, "yz", 1.0, "G")], "clip string, frame int, text string, alpha double, font string")
    covered = spark.createDataFrame([("F", "a", True), ("F", "b", False), ("G", "y", False), ("G", "z", False)], "font string, char string, ok boolean")
    lacks, fonts = fr.glyph_fallbacks(more, covered, ["clip"])
    assert rows(lacks) == [("c", "F", "b", 1, 2, 2, ["ab ", "xb"])] and rows(fonts) == [("c", "G", 2, 2, 2)]
    rec = spark.createDataFrame([("c", "k", 30, 2.0, "t", "l"), ("c", "k", 60, 1.5, "u", "l"), ("c", "j", 90, None, "v", None)], "clip string, key string, frame int, ratio double, text string, line string")
    assert [tuple(r) for r in fr.contrast_findings(rec, ["clip"], 30).collect()] == [("c", "k", 1.5, 1.0, 2.0, 2, 2, 1), ("c", "j", None, 3.0, 3.0, 1, 1, 0)]


def test_colors(spark):
    df = spark.createDataFrame([("#fff",), ("#102030",), ("rgb(1, 2,3)",), ("rgba(9,8,7,0.5)",), ("red",), (None,)], "c string")
    got = [r.x and tuple(r.x) for r in df.select(fr.css_color(F.col("c")).alias("x")).collect()]
    assert got == [(255, 255, 255, 1), (16, 32, 48, 1), (1, 2, 3, 1), (9, 8, 7, 0.5), None, None]
    bins = spark.createDataFrame([("a", 3.0, 80), ("a", 1.0, 5), ("a", 2.0, 15)], "k string, value double, weight int")
    assert rows(fr.worst_tail(bins, ["k"])) == [("a", 2.0)]


def frames_of(spark, plan, fps=30):
    """move n / still n, one grey value a frame of 400 pixels."""
    out, tone = [], 0
    for kind, n in plan:
        for _ in range(n):
            tone = (tone + 41) % 256 if kind == "move" else tone
            out.append(tone)
    return spark.createDataFrame([("c", i, [float(t)] * 400) for i, t in enumerate(out)], "clip string, frame long, gray array<float>"), out


def plain_freezes(tones, fps, least=0.8):
    out, i = [], 0
    while i + 1 < len(tones):
        j = i
        while j + 1 < len(tones) and tones[j + 1] == tones[j]:
            j += 1
        if (j - i) / fps >= least - 1e-9 and j > i:
            out.append((i / fps, (j - i) / fps))
        i = max(j, i + 1)
    return out


def test_freezes(spark):
    for plan in ([("move", 45), ("still", 31), ("move", 45)], [("move", 20), ("still", 16), ("move", 20)], [("move", 9), ("still", 30), ("move", 1), ("still", 40), ("move", 30), ("still", 50)]):
        df, tones = frames_of(spark, plan)
        got = [(r["from"], r["length"]) for r in fr.freezes(df, ["clip"], 30).orderBy("from").collect()]
        assert got == plain_freezes(tones, 30), plan
    runs = fr.freezes(df, ["clip"], 30)
    held = fr.without_holds(runs, F.lit(3.2), 0.8)
    assert held.count() < runs.count()
    m = fr.motion_summary(runs, df, ["clip"]).first()
    assert m.freezes == runs.count() and m.longest == max(r["length"] for r in runs.collect())
    p = fr.picture_scan(df.withColumn("gray", F.when(F.col("frame") < 3, F.transform("gray", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("gray"))), ["clip"], 30, F.lit(5.0)).first()
    assert p.black >= 3 and p.frame_delta == p.frames - 150
    assert fr.sample_clock(30, 0.01, 3) == [0, 1, 2] and fr.sample_clock(30, 0.1, 10) == [0, 3, 6, 9]


def test_events(spark):
    series = [(0.0, 0.0), (0.1, 0.2), (0.2, 0.8), (0.3, 0.0), (0.6, 0.0), (0.7, 0.6), (0.8, 0.0), (1.0, 0.3), (1.1, 0.0), (1.2, 0.9)]
    df = spark.createDataFrame([("n", t, v) for t, v in series], "name string, t double, v double")
    found = fr.events(df, ["name"])
    got = [(r.start, r.peak_at, r.end, r.held) for r in found.orderBy("start").collect()]
    assert got == [(0.05, 0.2, 0.288, 0.0), (0.617, 0.7, 0.783, 0.0), (1.111, 1.2, 1.2, 0.0)]
    flags = sorted((r.at, r.flag) for r in fr.event_flags(found, ["name"]).collect())
    assert flags == [(0.617, "close"), (1.111, "close"), (1.111, "fast")]
    assert sorted(r.flag for r in fr.event_flags(found, ["name"], within=2.0).collect())[-1] == "flutter"


def test_windows(spark):
    db = [-90] * 3 + [-20] * 20 + [-60] * 4 + [-20] * 20 + [-90] * 5
    w = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(db)], "clip string, i int, db double")
    assert rows(fr.dips(w, ["clip"])) == [("c", 23, 26, 4)]
    env = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([0, 1, 1, 0, 1, 0, 0, 0, 1, 0])], "clip string, i int, level double")
    assert rows(fr.level_runs(env, ["clip"], 0.5, 1, 2)) == [("c", 1, 4, 1.0)]
    rms = spark.createDataFrame([("c", i, v) for i, v in enumerate([0.0, 0.1, 0.01, 0.001, 0.2, 0.0])], "clip string, i int, rms double")
    assert rows(fr.quiet_runs(rms, ["clip"], 0.05), "first") == [("c", 0, 0, 0), ("c", 2, 3, 3), ("c", 5, 5, 5)]
    quiet = spark.createDataFrame([("c", 0, 3), ("c", 10, 19), ("c", 30, 35)], "clip string, first int, last int")
    assert rows(fr.silence_cuts(quiet, ["clip"], F.lit(3)), "at") == [("c", 15.0), ("c", 33.0)] and fr.silence_cuts(quiet, ["clip"], F.lit(9)).count() == 0


def test_pcm(spark):
    sound, none = [0.5, -0.5] * 50, [0.0] * 100
    clips = spark.createDataFrame([("a", 1000, none + sound + none * 12 + sound + none * 3), ("b", 1000, none), ("c", 1000, [])], "id string, rate int, samples array<float>")
    assert [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in fr.pcm_gaps(clips, ["id"]).collect()] == [("a", 0.2, 1.4)]
    got = {r.id: (round(r.longest, 6), r.first_sound and round(r.first_sound, 6), r.trailing and round(r.trailing, 6)) for r in fr.longest_silence(clips, ["id"]).collect()}
    assert got == {"a": (1.2, 0.1, 0.3), "b": (0.0, None, None), "c": (0.0, None, None)}


def test_small_rules(spark):
    lines = spark.createDataFrame([("f", "x", 0.0, 10.0), ("f", "y", 20.0, 20.3)], "film string, id string, start double, end double")
    assert rows(fr.sample_times(lines, ["film"], 10), "frame") == [("f", "x", 20), ("f", "x", 50), ("f", "x", 80), ("f", "y", 202)]
    s = fr.steady_spans(spark.createDataFrame([("f", 0.0, 0.5)], "film string, start double, end double"), ["film"], 5)
    assert [(round(r["from"], 3), round(r.to, 3)) for r in s.orderBy("from").collect()] == [(0.0, 0.1), (0.2, 0.3), (0.4, 0.5)]
    one = spark.range(1)
    v = one.select(
        fr.frames_in(F.lit(0.0), F.lit(1.0), 10).alias("a"), fr.frames_in(F.lit(0.0), F.lit(1.0), 10, True).alias("b"), fr.probe_frames(F.lit(0), F.lit(10)).alias("c"),
        fr.max_step(F.array(*map(F.lit, [0.0, 1.0, 0.5, 3.0])), F.lit(0), F.lit(3)).alias("d"), fr.typical_step(F.array(*map(F.lit, [0.0, 9.0, 9.5, 9.0, 0.0])), F.lit(0), F.lit(5), 1).alias("e"),
        fr.join_click(F.lit(1.0), F.lit(0.0)).alias("f"), fr.join_window(F.lit(1000), F.lit(0.01)).alias("g"), fr.part_spans(F.array(*map(F.lit, [5.0, -1.0, 2.0, 9.0])), F.lit(9.0)).alias("h"),
        fr.is_black(F.array(*[F.lit(0)] * 98, F.lit(99), F.lit(99))).alias("i"), fr.is_black(F.array(*[F.lit(0)] * 97, *[F.lit(99)] * 3)).alias("j"),
    ).first()
    assert (v.a, v.b, v.c, v.d, v.e, v.f.click, v.g.first, v.g.last) == (10, 11, [0, 4, 9], 1.0, 0.5, True, 0, 30)
    assert [tuple(x) for x in v.h] == [(0.0, 2.0), (2.0, 5.0), (5.0, 9.0)] and v.i and not v.j
