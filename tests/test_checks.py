import pytest
from pyspark.sql import functions as F

from tempora.functions import schema as sc
from tempora.operators import checks as ck
from tempora.operators import joins as jo
from tempora.operators import quantiles as qu

CUES = "array<struct<asset:string,at:string,offset_ms:int,play:string>>"
SCHEMA = {
    "type": "object", "required": ["a", "b"], "additionalProperties": False, "definitions": {"pos": {"type": "number", "exclusiveMinimum": 0}},
    "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/pos"}}, "c": {"oneOf": [{"type": "string", "pattern": "^x"}, {"enum": [True, 1]}]}, "d": {"type": ["string", "null"], "minLength": 2}, "e": {"type": "object", "additionalProperties": {"type": "boolean"}}},
}


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_schemas(spark):
    cases = {
        '{"a": 1, "b": [1]}': 0, '{"a": 1.0, "b": [1, 2.5], "c": "xy", "d": null, "e": {"q": true}}': 0, '{"a": 1.5, "b": []}': 2, '{"a": 9, "b": [0, -1]}': 3, '{"b": "x"}': 2, '{"a": 2, "b": [1], "c": "y"}': 1,
        '{"a": 2, "b": [1], "c": true}': 0, '{"a": 2, "b": [1], "c": 1.0}': 0, '{"a": true, "b": [1], "z": 1, "d": "x"}': 3, '{"a": 1, "b": [1], "e": {"q": 1}}': 1, "[]": 1, "{": 1, "null": 1,
    }
    assert {k: len(sc.problems(k, SCHEMA)) for k in cases} == cases
    assert sc.problems('{"a": 1, "b": [-3]}', SCHEMA) == ["$.b[0]: -3 is not over 0"] and isinstance(sc.problems("[" * 300_000 + "]" * 300_000, {"items": {"type": "array"}}), list)
    with pytest.raises(ValueError):
        sc.problems("1", {"$ref": "#/definitions/no"})
    df = spark.createDataFrame([("{}",), (None,)], "t string")
    assert [len(r.problems) for r in ck.against_schema(df, "t", SCHEMA).collect()] == [2, 1]


def test_rows(spark):
    cards = spark.createDataFrame([("f", 0, "a", 1.0, "e", "k"), ("f", 1, "a", -1.0, " ", "z"), ("f", 2, None, None, "e", None)], "film string, pos int, id string, at double, event string, kind string")
    got = [r.problems for r in ck.card_problems(cards, ["film"], ["k"]).orderBy("pos").collect()]
    assert got == [[], ["id given before", "no time from zero on", "no event", "unknown kind"], ["no id", "no time from zero on", "unknown kind"]]
    items = spark.createDataFrame([("f", 0, "a", 0.0, 1.0), ("f", 1, "b", 0.9, 2.0), ("f", 2, "a", 0.5, 0.5)], "film string, pos int, id string, start double, end double")
    assert [r.problems for r in ck.clock_problems(items, ["film"]).orderBy("pos").collect()] == [[], ["overlaps the one before"], ["empty", "out of order", "overlaps the one before", "id given before"]]
    facts = spark.createDataFrame([("f", 0, "a", 0.5, 1.0), ("f", 1, "b", 1.25, 2.03)], "film string, pos int, id string, start double, end double")
    assert [(r.gap, r.off_grid) for r in ck.clock_facts(facts, ["film"], 4).orderBy("pos").collect()] == [(0.5, False), (0.25, True)]
    it = "array<struct<id:string,start:double,end:double>>"
    tl = spark.createDataFrame([("f", None, [("x", 0.0, 1.0)]), ("g", [("y", 0.0, 2.0), ("z", 2.0, 3.0)], [("x", 0.0, 1.0)])], f"film string, stages {it}, shots {it}")
    assert [(r.film, r.kind, r.pos, r.id) for r in ck.clock_items(tl, ["film"]).orderBy("film", "pos").collect()] == [("f", "shots", 0, "x"), ("g", "stages", 0, "y"), ("g", "stages", 1, "z")]
    foot = spark.createDataFrame([("f", 0, "a", "s", 0.0, 1.0, 1.0, None), ("f", 1, "b", "", 0.0, 1.0, None, None), ("f", 2, "c", "s", 1.0, 1.0, -1.0, True)], "film string, pos int, id string, src string, in double, out double, speed double, freeze boolean")
    assert [r.problem for r in ck.footage_problems(foot, ["film"]).orderBy("pos").collect()] == [None, "no source", "empty"]
    v = spark.range(1).select(ck.source_frame(F.lit(10), F.lit(1.5), F.lit(None).cast("boolean")).alias("a"), ck.source_frame(F.lit(10), F.lit(1.5), F.lit(True)).alias("b"), ck.span_frame(F.lit(1.5), F.lit(1.0), 30).alias("c")).first()
    assert (v.a, v.b, v.c) == (15, 0, 15)
    audio = spark.createDataFrame([("a", "s", 0.0, None, 2.0, 1.0, None, None, None), ("b", "s", 0.0, 1.0, None, 0.0, False, None, None), ("c", "s", 0.0, 1.0, None, 0.0, None, True, None), ("d", "s", 0.0, 1.0, None, 0.0, None, None, 2.0)], "id string, src string, in double, out double, dur double, at double, audio boolean, freeze boolean, speed double")
    assert rows(ck.field_audio(audio, 30)) == [("a", "s", 0.0, 2.0, 30)]


def test_plan_lines(spark):
    lines = spark.createDataFrame([
        ("f", 0, "a", "Hi | there", 100, True, [("s", "word:ther", 0, None), ("s", "word:zz", 0, None), ("t", "start", None, None)]), ("f", 1, "b", "|x||y|", 900, False, None), ("f", 2, "c", "end", 100, True, []),
        ("g", 0, "a", "x", None, None, []), ("h", 0, "a", "x", None, True, []), ("i", 0, "a", "x", None, False, [("s", "start", -100, None)]),
    ], f"film string, pos int, id string, text string, pause_after_ms int, lead boolean, cues {CUES}")
    assert rows(ck.cue_word_errors(lines, ["film"])) == [("f", "a", "s", "zz")]
    assert sorted(rows(ck.break_errors(lines, ["film"]))) == [("f", "b", "leads"), ("f", "b", "repeats"), ("f", "b", "trails")]
    assert rows(ck.breath_facts(lines, ["film"])) == [("f", "a", 100)]
    films = spark.createDataFrame([("f", 3.0, False, False), ("g", 3.0, False, False), ("h", 3.0, True, None), ("i", 3.0, None, None)], "film string, lead double, bed boolean, page boolean")
    assert sorted(map(str, rows(ck.lead_errors(lines, films, ["film"])))) == sorted(map(str, [("f", "c", "lead lines come first"), ("g", None, "the lead has no sound"), ("h", None, "every line is a lead line")]))
    none = spark.createDataFrame([("f", 0.0, False, False)], films.schema)
    assert rows(ck.lead_errors(lines.filter("film = 'f'"), none, ["film"])) == [("f", "a", "a lead line needs a lead")]
    t = spark.createDataFrame([("f", 0, "a", 0.0), ("f", 1, "b", 2.0), ("f", 2, "c", 20.0)], "film string, pos int, id string, start double")
    p = spark.createDataFrame([("f", "a", 1500), ("f", "b", 1500)], "film string, id string, pause_after_ms int")
    assert rows(ck.pause_facts(t, p, ["film"])) == [("f", "a", 1.5, 2.0)]
    keys, strings = spark.createDataFrame([("k",), ("m",)], "key string"), spark.createDataFrame([("fr", "k", "t"), ("fr", "m", " "), ("de", "k", "t"), ("de", "m", "u")], "lang string, key string, text string")
    assert rows(ck.missing_keys(keys, strings)) == [("fr", ["m"])]
    dub = spark.createDataFrame([("f", "a", "A", "A0", None), ("f", "b", "B", "B0", True), ("f", "x", "X", "X0", None), ("f", "c", "C", "C0", None)], "film string, id string, text string, base_text string, same boolean")
    base = spark.createDataFrame([("f", "a", "A1"), ("f", "b", "B0"), ("f", "c", "C0"), ("f", "d", "D0")], "film string, id string, text string")
    assert rows(ck.stale_dubs(dub, base, ["film"]), "id") == [("f", "a", "base changed"), ("f", "b", "texts differ"), ("f", "d", "not dubbed"), ("f", "x", "not in base")]


def test_cues(spark):
    lines = spark.createDataFrame([("f", 0, "a", [("s", "start", None, None), ("t", "word:b", 5, None)])], f"film string, pos int, id string, cues {CUES}")
    assert [r.key for r in ck.flat_cues(lines, ["film"]).orderBy("n").collect()] == ["a\x00s\x00start\x000", "a\x00t\x00word:b\x005"]
    fades = spark.createDataFrame([("f", 1, 0.0, 5.0), ("f", 1, 3.0, 4.0), ("f", 1, 9.0, 1.0)], "film string, track int, at double, length double")
    assert [(r.fade_in, r.fade_out) for r in ck.cue_fades(fades, ["film"]).orderBy("at").collect()] == [(0.0, 1.5), (1.5, 0.0), (0.0, 0.0)]
    cues = spark.createDataFrame([("f", "a", "s", "word:bc"), ("f", "a", "s", "word:zz"), ("f", "q", "s", "word:x"), ("f", "a", "s", "end")], "film string, line string, asset string, at string")
    w = "array<struct<w:string,start:double,end:double>>"
    t = spark.createDataFrame([("f", "a", "a | bcd", "a xyz", [("a", 0.0, 1.0), ("bcd", 1.0, 2.0)], 1)], f"film string, id string, text string, heard string, words {w}, measured int")
    o = spark.createDataFrame([("f", "a", 1, "off")], "film string, line string, index int, status string")
    got = sorted((r.line, r.word, r.warning) for r in ck.word_cues(cues, t, o, ["film"]).collect())
    assert got == [("a", "bc", "not all words measured"), ("a", "bc", "not heard"), ("a", "bc", "sound elsewhere"), ("a", "zz", "no such word"), ("q", "x", "no line")]
    marks = spark.createDataFrame([("f", 0.5, "m1"), ("f", 2.0, "m2"), ("f", 2.5, "m3"), ("f", 9.0, "m4")], "film string, at double, kind string")
    ln = spark.createDataFrame([("f", "a", 0.0, 2.0), ("f", "b", 3.0, 4.0)], "film string, id string, start double, end double")
    wd = spark.createDataFrame([("f", "a", 0.45, 0), ("f", "a", 1.5, 1)], "film string, line string, start double, index int")
    got = {r.kind: r for r in ck.page_marks(marks, ln, wd, ["film"]).collect()}
    assert (got["m1"].line, got["m1"]["index"], got["m1"].off) == ("a", 0, False) and (got["m2"].line, got["m2"]["index"], got["m2"].off) == ("a", 1, True)
    assert got["m3"].line is None and got["m4"].line is None


def test_stages_and_entries(spark):
    st = spark.createDataFrame([("a", "job", ["b"], ["/x"], "/d", None, ["c"]), ("b", "session", [], ["rel"], "/d", None, None), ("b", "job", ["zz"], [], "rel", None, None), ("c d", "what", [], [], "/d", "/p", None)], "name string, kind string, needs array<string>, owns array<string>, done string, prompt string, cmd array<string>")
    got = rows(ck.stage_problems(st))
    assert sorted(got) == sorted([("b", "name used twice"), ("b", "a session needs a prompt"), ("b", "owns no absolute path"), ("b", "name used twice"), ("b", "done is no absolute path"), ("b", "a job needs a command"), ("b", "needs unknown zz"), ("c d", "bad name"), ("c d", "unknown kind")])
    d = ck.with_defaults(st.withColumn("priority", F.lit(None).cast("int")).withColumn("heavy", F.lit(None).cast("boolean"))).first()
    assert d.priority == 0 and d.heavy
    e = spark.createDataFrame([("out/drafts/a.mp4", None, None, None, None), (None, "s", 3, 2, None), ("a", "b", -1, None, True)], "src string, segment string, from int, to int, new boolean")
    assert [(r.problems, r.fresh) for r in ck.edit_entries(e).collect()] == [([], True), (["empty"], False), (["one of src and segment", "starts before the clip"], True)]
    s = spark.createDataFrame([("f", 1.0, 2.0), ("f", 2.05, 3.0), ("f", 9.0, 30.0)], "film string, from double, to double")
    assert rows(ck.span_frames(s, ["film"], 10, 0, 100, 0.1), "s") == [("f", 9, 31), ("f", 89, 100)]
    with pytest.raises(Exception, match="no part of the film"):
        ck.span_frames(s, ["film"], 10, 0, 50).collect()


def test_sources(spark):
    pages = spark.createDataFrame([(1, "<canvas></canvas> setTimeout(x) setTimeout(y)"), (2, "plain")], "id int, html string")
    assert rows(ck.html_findings(pages, "id", "html", [("timer", r"setTimeout\(", 1), ("date", "Date", 0)])) == [(1, 45, "timer", 2, 1)]
    code = spark.createDataFrame([(1, "label('a'); label(\"b\"); label(x); label('a'); relabel('q')")], "id int, code string")
    assert [(r["keys"], r.others) for r in ck.literal_keys(code, "id", "code").collect()] == [(["a", "b"], 1)]


def test_joins(spark):
    left = spark.createDataFrame([("a", 1.5, 1, "n"), ("a", 9.0, 2, "m"), ("b", 1.0, 3, "k"), ("a", 1.5, 1, "n")], "k string, at double, tie int, note string")
    right = spark.createDataFrame([("a", 1.0, 7), ("a", 2.0, 5), ("a", 2.0, 6), ("a", 7.0, 1)], "k string, at double, tie int")
    assert rows(jo.nearest(left, right, ["k"], "at", "tie"), "at") == [("a", 1.5, 1, "n", 0.5, 5), ("a", 1.5, 1, "n", 0.5, 5), ("a", 9.0, 2, "m", 2.0, 1)]
    assert jo.nearest(left, right, ["k"], "at", "tie", 1.0).count() == 2
    assert [r.match_at for r in jo.asof(left.filter("tie = 2"), right, ["k"], "at", "tie", "tie").collect()] == [7.0]
    tiles = spark.createDataFrame([("a", 0.0, 1.0, "x"), ("a", 2.0, 3.0, "y")], "k string, s double, e double, id string")
    pts = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 1.0), ("a", 2.5), ("a", 8.0), ("b", 1.0)], "k string, at double")
    assert rows(jo.in_tile(pts, tiles, ["k"], "at", "s", "e", "id"), "k", "at") == [("a", -1.0, None), ("a", 0.0, "x"), ("a", 1.0, None), ("a", 2.5, "y"), ("a", 8.0, "y"), ("b", 1.0, None)]


def test_ranks(spark):
    import random

    r = random.Random(1)
    data = [(k, r.choice([r.gauss(0, 1), 5.0, -1e9])) for k in "aab" for _ in range(150)] + [("c", 4.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    rules = {f"p{p}{rule}": qu.rank_rule(p, rule) for p in (0.05, 0.5, 0.95) for rule in ("lower", "count", "upper_median")}
    got = {x.k: x for x in qu.at_ranks(df, ["k"], "v", rules, bins=16).collect()}
    assert set(got) == {"a", "b", "c"}
    for k in "abc":
        v = sorted(x for q, x in data if q == k)
        n = len(v)
        for p in (0.05, 0.5, 0.95):
            assert got[k][f"p{p}lower"] == v[int(p * (n - 1))] and got[k][f"p{p}count"] == v[min(int(p * n), n - 1)] and got[k][f"p{p}upper_median"] == v[n // 2]
    rates = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("b", 1.0), ("b", 9.0), ("b", 1.1)], "k string, r double")
    assert sorted(rows(qu.plausible(rates, ["k"], "r"))) == [("a", True), ("b", False)]
