import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import reuse as ru

SEG = "struct<frame_start:long,frame_end:long,fps:int,width:int,height:int,encoder:string,probes:array<string>,mismatch:boolean,reads:array<string>,reads_all:boolean>"


def seg(**more):
    base = {"frame_start": 0, "frame_end": 30, "fps": 30, "width": 10, "height": 20, "encoder": "h", "probes": ["a", "b"], "mismatch": None, "reads": ["k"], "reads_all": None}
    return tuple((base | more).values())


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_segments(spark):
    cases = [
        (seg(), seg(), True, None), (seg(), seg(), False, "no file"), (None, seg(), True, "not stored"), (seg(mismatch=True), seg(), True, "differs from the page"), (seg(frame_end=31), seg(), True, "frame range"),
        (seg(fps=25), seg(), True, "frame rate"), (seg(height=1), seg(), True, "size"), (seg(encoder=None), seg(), True, "encoder"), (seg(encoder=None), seg(encoder="libx264"), True, None), (seg(), seg(encoder=None), True, None),
        (seg(probes=None), seg(), True, "number of probes"), (seg(probes=["a"]), seg(), True, "number of probes"), (seg(probes=["a", "c"]), seg(), True, "probe"),
    ]
    df = spark.createDataFrame([(i, s, c, e) for i, (s, c, e, _) in enumerate(cases)], f"i int, s {SEG}, c {SEG}, e boolean")
    got = df.select("i", ru.segment_reuse(F.col("s"), F.col("c"), F.col("e")).alias("d")).orderBy("i").collect()
    assert [(r.d.reuse, r.d.reason) for r in got] == [(w is None, w) for *_, w in cases]


def test_stamps_and_languages(spark):
    b = "struct<size:long,mtime:long>"
    cases = [(True, (1, 2), True, (1, 2), None), (True, (1, 2), True, (1, 3), "the base changed"), (True, (1, 2), True, None, "the base is gone"), (True, None, True, (1, 2), "the base is new"), (False, None, True, (1, 2), "no record of the base"), (False, None, True, None, None), (True, (1, 2), False, None, None)]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], f"i int, k boolean, r {b}, nk boolean, n {b}")
    assert [r[0] for r in df.orderBy("i").select(ru.stamp_matches(F.col("k"), F.col("r"), F.col("nk"), F.col("n"))).collect()] == [c[4] for c in cases]
    d = "struct<reuse:boolean,reason:string>"
    df = spark.createDataFrame([((True, None), (True, None), None), ((True, None), (True, None), "x"), ((False, "y"), (False, "z"), None), ((True, None), (False, "z"), "x")], f"o {d}, b {d}, s string")
    assert [tuple(r[0]) for r in df.select(ru.language_segment(F.col("o"), F.col("b"), F.col("s"))).collect()] == [("REUSE", None), ("COPY", None), ("RENDER", "y"), ("RENDER", "x")]
    df = spark.createDataFrame([(seg(), seg(), seg(), {"k": "new"}, None), (seg(), seg(), seg(), {"k": "", "z": "t"}, None), (seg(), seg(), seg(), None, "stamp"), (seg(), None, seg(), None, None), (seg(reads=None), seg(), seg(), None, None), (None, seg(), seg(), None, None)], f"b {SEG}, o {SEG}, c {SEG}, t map<string,string>, s string")
    got = [r[0] for r in df.select(ru.unprobed_segment(F.col("b"), F.col("o"), F.col("c"), F.col("t"), F.lit(True), F.lit(True), F.col("s"))).collect()]
    assert got == [None, "REUSE", "COPY", "COPY", None, None]


def test_selection(spark):
    segs = spark.createDataFrame([("f", i, f"s{i}", i * 10, i * 10 + 10) for i in range(5)], "film string, pos int, id string, frame_start long, frame_end long")
    stored = spark.createDataFrame([("s0", 0, 10), ("s1", 10, 21), ("s2", 0, 0)], "id string, frame_start long, frame_end long")
    assert rows(ru.outside_selection(segs, stored, ["s2"]), "id") == [("s1",), ("s3",), ("s4",)]
    assert rows(ru.unknown_ids(segs, spark.createDataFrame([("s1",), ("q",)], "id string"))) == [("q",)]
    assert [r.id for r in ru.neighbours(segs, ["film"], ["s1", "s2"], ["s3"]).collect()] == ["s0"]


def test_states(spark):
    df = spark.createDataFrame([(None, "n", None, None), ("n", "n", None, None), ("o", "n", None, ["a"]), ("o", "n", ["a"], ["a"]), ("o", "n", ["a"], ["b"])], "s string, n string, p array<string>, c array<string>")
    assert [r[0] for r in df.select(ru.draft_state(F.col("s"), F.col("n"), F.col("p"), F.col("c"))).collect()] == ["unstamped", "current", "stamp moved", "slot unchanged", "stale"]
    df = spark.createDataFrame([(False, None, "t"), (True, None, "t"), (True, "x", "t")], "e boolean, r string, t string")
    assert [r[0] for r in df.select(ru.take_state(F.col("e"), F.col("r"), F.col("t"))).collect()] == ["missing", "unrecorded", "stale"]
    df = spark.createDataFrame([("{}", True, None, None), ("{", True, None, None), ("ab", None, "b", "^a"), ("ab", False, "c", None), ("ab", None, None, "^b")], "t string, j boolean, c string, m string")
    df = df.withColumn("w", ru.verify_content(F.col("t"), F.col("j"), F.col("c"), F.col("m")))
    assert [r.w for r in df.collect()] == [None, "no JSON", None, "text missing", "pattern missing"]
    df = spark.createDataFrame([(None, 1.0, 1.0), (0, 1.0, 1.0), (5, 1.0, 9.0), (5, 8.0, 9.0)], "s long, m double, a double")
    assert [r[0] for r in df.select(ru.verify_done(F.col("s"), F.col("m"), F.col("a"), F.lit(None).cast("long"), F.lit(None).cast("string"))).collect()] == ["missing", "too small", "older than the run", None]


def test_takes_and_queues(spark):
    takes = spark.createDataFrame([("l", 1, 2.0, True), ("l", 2, 1.0, False), ("l", 3, 2.0, True), ("m", 1, float("nan"), True)], "id string, k int, score double, fits boolean")
    assert rows(ru.choose_take(takes, ["id"], F.col("score"))) == [("l", 1, 2.0, True)]
    t = spark.createDataFrame([("b", 1, 5, True), ("a", 1, 5, True), ("c", 2, 9, True), ("d", 3, 1, False)], "id string, priority int, arrived int, alive boolean")
    assert [r.id for r in ru.waiting_order(t).collect()] == ["c", "a", "b"]
    assert sorted(r.id for r in ru.shuffled(t, "s", "id").collect()) == list("abcd") and ru.shuffled(t, "s", "id").collect() == ru.shuffled(t.repartition(3), "s", "id").collect()
    cards = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos int, id string")
    m, e = spark.createDataFrame([("y", 1.0)], "id string, fit double"), spark.createDataFrame([("x", 0.5), ("y", 0.1)], "id string, fit double")
    assert rows(ru.with_manual(cards, m, e)) == [(0, "x", 0.5, False), (1, "y", 1.0, True), (2, "z", None, False)] and ru.scores_template(cards).count() == 3
    f = spark.createDataFrame([(1, [("a", 3.0), ("b", 1.0), ("c", 1.0)]), (2, [])], "i int, regions array<struct<id:string,ratio:double>>")
    assert [r.poorest and r.poorest.id for r in ru.with_poorest(f).orderBy("i").collect()] == ["b", None]
    q = spark.createDataFrame([("a", False, 9.0, "o", False), ("b", True, 1.0, None, None)], "id string, alive boolean, age double, output string, output_present boolean")
    assert [r.reasons for r in ru.list_entries(q, 5.0).orderBy("id").collect()] == [["owner gone", "old", "output missing"], []]
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.id for r in ru.remove_entries(q, one("a")).collect()] == ["b"] and ru.remove_entries(q, one("a", "b"), force=True).count() == 0
    for bad in (one("b"), one("zz")):
        with pytest.raises(ValueError):
            ru.remove_entries(q, bad)
    files = spark.createDataFrame([("p", 1, 2), ("q", 3, 4)], "path string, size long, mtime long")
    assert ru.cache_key(files, {"a": 1}) == ru.cache_key(files.repartition(2), {"a": 1}) != ru.cache_key(files.filter("path = 'p'"), {"a": 1})


def test_spans(spark):
    segs = spark.createDataFrame([("f", "a", 0, 100), ("f", "b", 100, 5000), ("f", "c", 5000, 5100)], "film string, id string, frame_start long, frame_end long")
    spans = spark.createDataFrame([("f", 90, 110), ("f", 105, 130), ("f", 4000, 5000)], "film string, from long, to long")
    assert rows(ru.splice_plan(segs, spans, ["film"]), "from") == [("f", "a", 0, 90, "keep"), ("f", "a", 90, 100, "new"), ("f", "b", 100, 130, "new"), ("f", "b", 130, 4000, "keep"), ("f", "b", 4000, 5000, "new"), ("f", "c", 5000, 5100, "keep")]
    assert rows(ru.insert_plan(segs, ["film"], F.lit(50), F.lit(7)), "from") == [("f", "a", 0, 50, 0), ("f", "a", 57, 107, 50), ("f", "b", 107, 5007, 100), ("f", "c", 5007, 5107, 5000)]
    cuts = spark.createDataFrame([("f", 5, 95, 100), ("f", 41, 59, 100), ("f", 20, 100, 100)], "film string, from long, to long, total long")
    keys = spark.createDataFrame([("f", k) for k in (0, 20, 40, 60, 80)], "film string, frame long")
    got = sorted(tuple(r)[2:] for r in ru.cut_plan(cuts, keys, ["film"]).collect())
    assert got == sorted([(5, 20, "encode"), (20, 80, "copy"), (80, 95, "encode"), (41, 59, "encode"), (20, 100, "copy")])
    p = spark.createDataFrame([("e", 0, 20, "copy"), ("e", 20, 30, "encode")], "entry string, from long, to long, kind string")
    assert rows(ru.entry_check_ranges(p, ["entry"]), "from") == [("e", 0, 2), ("e", 18, 30)]
    g = spark.createDataFrame([("v", 0, 0), ("v", 1, 2), ("v", 2, 1), ("v", 3, 2)], "clip string, n int, pts long")
    assert [(r.frame, r.problem, r.delay) for r in ru.frame_grid(g, ["clip"], 30, 1 / 30).orderBy("n").collect()] == [(0, None, 1), (2, "doubled", 1), (1, None, 1), (2, "doubled", 1)]


def test_timelines(spark):
    films = spark.createDataFrame([("f", 10, 6.0)], "film string, fps int, duration double")
    items = lambda *x: spark.createDataFrame([("f", i, s, t, "h") for i, s, t in x], "film string, id string, start double, text string, hash string")
    old = ru.owned_ranges(items(("a", 0.0, "A"), ("b", 2.0, "B"), ("c", 4.0, "C")), films, ["film"])
    new = ru.owned_ranges(items(("a", 0.0, "A"), ("x", 2.0, "X"), ("b", 3.0, "B2"), ("c", 4.0, "C")), films, ["film"])
    runs = ru.timeline_diff(old, new, ["film"])
    assert [(r.state, r.shift, r["from"], r.to, r["items"]) for r in runs.orderBy("from").collect()] == [("keep", 0, 0, 20, 1), ("added", None, 20, 30, 1), ("changed", None, 30, 40, 1), ("keep", 0, 40, 60, 1)]
    assert rows(ru.diff_totals(runs, ["film"])) == [("f", 40, 20, 0)] and rows(ru.span_flag(runs, ["film"], 10)) == [("f", "2.000-3.000,3.000-4.000")]
    assert [(r.src, r.src_from, r.fresh) for r in ru.edit_list(runs, "old.mp4").orderBy("from").collect()] == [("old.mp4", 0, False), (None, None, True), (None, None, True), ("old.mp4", 40, False)]


def plain_cover(clips, start, end):
    at, out = start, []
    while at < end:
        best = max((c for c in clips if c[0] <= at < c[1]), key=lambda c: c[1], default=None)
        if best is None:
            return None
        out.append(best)
        at = best[1]
    return out


def test_cover_is_greedy(spark):
    r = random.Random(5)
    data, want = [], {}
    for k in range(60):
        clips = sorted({(a, a + r.randint(1, 40)) for a in (r.randint(0, 90) for _ in range(r.randint(1, 14)))})
        data += [(k, 0, 100, a, b, f"{a}-{b}") for a, b in clips]
        found = plain_cover(clips, 0, 100)
        want[k] = None if found is None else [b for _, b in found]
    got = ru.cover(spark.createDataFrame(data, "run int, start long, end long, from long, to long, id string"), ["run"])
    for x in got.collect():
        assert x.gap == (want[x.run] is None), x
        if want[x.run] is not None:
            assert [int(c.split("-")[1]) for c in x.clips] == want[x.run], x
