from pyspark.sql import functions as F

from tempora.operators import films as fi

W = "array<struct<w:string,start:double,end:double>>"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_carried_and_heard(spark):
    before = spark.createDataFrame([("a", "x", 1.0, [("x", 1.0, 1.5)]), ("b", "y", 2.0, [("y", 2.0, 2.5)])], f"id string, text string, start double, words {W}")
    now = spark.createDataFrame([("a", "x", 3.0), ("b", "z", 4.0), ("c", "q", 5.0)], "id string, text string, start double")
    got = {r.id: r.words for r in fi.carried_words(before, now, []).collect()}
    assert got["a"][0].end == 3.5 and got["b"] is None and got["c"] is None
    lines = spark.createDataFrame([("a", "old", None), ("b", None, ("h", 0.5, "text"))], "id string, flag string, stt struct<heard:string,rate:double,against:string>")
    heard = spark.createDataFrame([("a", "x", 0.0, "text"), ("b", "y", 0.2, "say")], "id string, heard string, rate double, against string")
    got = {r.id: r for r in fi.with_heard(lines, heard, []).collect()}
    assert got["a"].flag == "old" and got["a"].stt.heard == "x" and got["b"].flag == "doubtful" and got["b"].stt.against == "say"
    yes, no = fi.split_by_audio(now, before, [])
    assert sorted(r.id for r in yes.collect()) == ["a", "b"] and [r.id for r in no.collect()] == ["c"]


def test_voices(spark):
    want = spark.createDataFrame([("s", "en-US"), ("s", "fr"), ("s", "de"), ("t", "en")], "speaker string, lang string")
    have = spark.createDataFrame([("s", "en-US", "v1"), ("s", "en-GB", "v2"), ("s", "fr-FR", "v3"), ("t", "en-US", "v4"), ("t", "en-GB", "v5")], "speaker string, lang string, voice string")
    assert rows(fi.cast_voices(want, have), "speaker", "lang") == [("s", "de", None, "no voice"), ("s", "en-US", "v1", None), ("s", "fr", "v3", None), ("t", "en", None, "several voices")]


def test_segments(spark):
    films = spark.createDataFrame([("f", 10, 6.04)], "film string, fps int, duration double")
    shots = spark.createDataFrame([("f", 0, "a", 0.2, 1.0), ("f", 1, "b", 1.0, 3.0), ("f", 2, "c", 2.5, 2.8), ("f", 3, "d", 3.0, 4.0), ("f", 4, "e", 4.5, 5.0), ("f", 5, "g", 5.0, 6.0)], "film string, pos int, id string, start double, end double")
    got = rows(fi.segments(shots, films, ["film"]).select("id", "frame_start", "frame_end", "merged"), "frame_start")
    assert got == [("a", 0, 10, False), ("b+c", 10, 30, True), ("d+e", 30, 50, True), ("g", 50, 60, False)]
    probes = [r.t for r in fi.probe_times(shots.filter("id = 'a'"), films, ["film"], 0.5).orderBy("t").collect()]
    assert probes == [0.2, 0.6, 1.007, 3.02, 5.033]


def test_tempo(spark):
    df = spark.createDataFrame([([10.0, 2.0, 1.0], [1.0], 8.0), ([1.0], [], 50.0)], "d array<double>, p array<double>, goal double")
    got = [r.speed for r in fi.fit_tempo(df, "d", "p", F.col("goal"), 1.5).collect()]
    s = got[0]
    assert abs(max(1.5, 10 / s) + max(1.5, 2 / s) + max(1.5, 1 / s) + 1 / s - 8) < 1e-9 and abs(got[1] - 0.25) < 1e-9


def test_texts(spark):
    rules = [("en", "  ", "two blanks", "warn"), ("*", r"\?\?", "repeated", "error"), ("fr", "\\S!", "no blank", "warn")]
    df = spark.createDataFrame([(1, "a  b??", "en-US"), (2, "ok", "en"), (3, "oh!", "fr"), (4, "??", "xx"), (5, None, "en")], "i int, t string, lang string")
    got = {r.i: r.findings and [(f.rule, f.severity) for f in r.findings] for r in fi.text_findings(df, "t", "lang", rules).collect()}
    assert got == {1: [("two blanks", "warn"), ("repeated", "error")], 2: [], 3: [("no blank", "warn")], 4: None, 5: []}
    c = spark.createDataFrame([("#000", ["#fff", "#777777"], 1.0), ("#000", ["#ffffff"], 0.0), ("red?", ["#fff"], 1.0)], "c string, g array<string>, a double")
    got = [r.j for r in c.select(fi.judge_text(F.col("c"), F.col("g"), F.col("a")).alias("j")).collect()]
    assert abs(got[0].ratio - 4.689) < 0.01 and got[0].grade == "pass" and got[1].ratio == 1 and got[1].grade == "fail" and got[2].grade is None
