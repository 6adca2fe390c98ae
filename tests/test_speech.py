import itertools
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import speech
from tempora.operators import speech as sp


def test_numbers():
    cases = {
        "forty two": "42", "Seven hundred and six thousand eleven": "706011", "two hundred three": "203", "thirty five percent": "35%", "zero point five": "0.5",
        "one, two": "1, 2", "sixty seventy": "60 70", "the hundred": "the hundred", "one million two": "1000002", "stone tenant": "stone tenant", "nineteen ninety": "19 90", "five and six": "5 and 6", "": "",
    }
    assert {k: speech.english_digits(k) for k in cases} == cases
    for n in (0, 7, 10, 19, 20, 45, 100, 111, 999, 1000, 1001, 20020, 999_999):
        words = []
        for part, name in ((n // 1000, "thousand"), (n % 1000, "")):
            if part >= 100:
                words += [speech.ONES[part // 100], "hundred"]
            rest = part % 100
            words += [] if not rest else [speech.ONES[rest]] if rest < 20 else [speech.TENS[rest // 10 - 2]] + ([speech.ONES[rest % 10]] if rest % 10 else [])
            words += [name] if part and name else []
        assert speech.english_digits(" ".join(words) or "zero") == str(n)
    assert speech.read_numbers("이십사 시간, 천구백 년, 일", "ko-KR") == "24 시간, 1900 년, 일"
    assert speech.read_numbers("三百零五万", "zh") == "3050000" and speech.read_numbers("二千二十", "ja") == "2020" and speech.read_numbers("一人", "zh") == "一人"
    assert [speech.spell_number(n, "ko") for n in (0, 21, 105, 1000, 30000, 10001)] == ["영", "이십일", "백오", "천", "삼만", "일만일"]
    assert speech.spell_number(310_004, "en") == "threehundredtenthousandfour" and speech.spell_number(5, "fr") is None


def test_folds():
    names = speech.name_folds({"API": "a p i", "X": "X"}, {"GPU": "g p u", "API": "ay pee eye"}, None)
    assert names == [("API", "ay pee eye"), ("GPU", "g p u")]
    assert speech.normal_form("The Ay Pee Eye: ＡＢ twenty!", "en", names) == "theapiab20"
    assert speech.normal_form("カタカナ", "ja") == "かたかな" and speech.normal_form("學", "zh", han={"學": "学"}) == "学"
    assert speech.normal_form(None) == "" and speech.strip_marks("a {sigh} b [x] , c") == "a b, c"


def brute_diffs(a, b):
    """The least number of differing words over all alignments."""
    if not a or not b:
        return len(a) + len(b)
    return min(brute_diffs(a[1:], b[1:]) + (a[0] != b[0]), brute_diffs(a[1:], b) + 1, brute_diffs(a, b[1:]) + 1)


def test_token_diffs_are_least():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 5))] for _ in range(2))
        diffs = speech.token_diffs(" ".join(a), " ".join(b))
        assert sum(max(len(d["want"].split()), len(d["heard"].split())) for d in diffs) == brute_diffs(a, b)
        assert all(d["want"] or d["heard"] for d in diffs)
    assert speech.token_diffs("the cat sat", "the big cat sad") == [{"want": "", "heard": "big"}, {"want": "sat", "heard": "sad"}]
    assert speech.token_diffs("Hi, you!", "hi you") == [] and speech.token_diffs(None, None) == []


def test_common_pairs_are_longest():
    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 7))) for _ in range(2))
        subs = lambda s: {"".join(c) for n in range(len(s) + 1) for c in itertools.combinations(s, n)}
        pairs = speech.common_pairs(a, b)
        assert len(pairs) == max(map(len, subs(a) & subs(b))) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_sentences_and_lines():
    ends = speech.sentence_ends("We went home. Did you? Yes", "we went home did yes")
    assert [(e["final"], e["heard"]) for e in ends] == [("e", True), ("u", False), ("s", True)]
    assert speech.sentence_ends("", "x") == [] and speech.sentence_ends("3.5 is fine.", "3.5 is fine")[0]["final"] == "e"
    got = speech.compare_line("Call 911", "call nine one one", "call nine one one")
    assert got["against"] == "say" and got["rate"] == 0 and got["diffs"] == []
    assert speech.compare_line("a", "a", "a")["against"] == "text"


def test_alignment():
    heard = [("it", 0.0, 0.2), ("is", 0.2, 0.4), ("nine", 0.5, 0.8), ("thirty", 0.8, 1.2), ("now", 1.3, 1.6)]
    words, measured = speech.align_words("It is 9:30 now.", heard, "en")
    assert [w[0] for w in words] == ["It", "is", "9:30", "now."] and measured == 4
    assert words[2][1:] == (0.5, 1.2) and words[3][1:] == (1.3, 1.6)
    words, measured = speech.align_words("hello strange world", [("hello", 0.0, 1.0), ("world", 3.0, 4.0)], "en")
    assert measured == 2 and words[1] == ("strange", 1.0, 3.0)
    assert speech.align_words("", heard) == ([], 0) and speech.align_words("x", []) == ([], 0)
    for (_, _, b), (_, c, _) in itertools.pairwise(speech.align_words("qq it zz is yy nine", heard, "en")[0]):
        assert b <= c + 1e-9
    lines, low = speech.align_script([("a", "it is"), ("b", "xqxq zzz"), ("c", "nine thirty | now")], heard, "en")
    assert [x["id"] for x in lines] == ["a", "c"] and [x["id"] for x in low] == ["b"] and lines[1]["end"] == 1.6


def test_times_by_letters():
    assert speech.words_on_caption("a b", [("x", 1.0, 2.0), ("y", 2.0, 4.0)], 0.5) == [("a", 1.5, 2.5), ("b", 2.5, 4.5)]
    got = speech.words_on_caption("abcd ef", [("abc", 0.0, 3.0), ("d", 3.0, 4.0), ("ef", 5.0, 7.0)])
    assert got == [("abcd", 0.0, 4.0), ("ef", 5.0, 7.0)]
    assert speech.words_from_letters("ab c", [0.0, 0.1, 0.2, 0.3], [0.1, 0.2, 0.3, None], 1.0) == [("ab", 1.0, 1.2)]


def test_captions():
    assert speech.pack_by_size([3, 4, 9, 1, 2], 7) == [0, 0, 1, 2, 2]
    assert speech.words_to_lines(["a", "bc", "d."], ["A bc", "D"]) == [(0, 2), (2, 3)] and speech.words_to_lines(["ab"], ["a", "b"]) is None
    assert speech.caption_pieces("one two|three four", 8) == ["one two", "three", "four"]
    assert speech.caption_breaks("a b", 9) == [{"before": None, "after": None}] and speech.caption_breaks("a b | c", 9, 1) == [{"before": "b", "after": "c"}]
    cues = speech.build_cues([("aaaa", 0.0, 0.2), ("bbbb", 0.3, 0.4), ("cccc", 1.0, 1.1)], row=4, rows=2)
    assert cues == [{"lines": ["aaaa", "bbbb"], "start": 0.0, "end": 0.8}, {"lines": ["cccc"], "start": 1.0, "end": 1.8}]


def test_columns(spark):
    df = spark.createDataFrame([(1, "It's {soft} a  'test' , “ok” [x]", "en-US", "film"), (2, "한국어 가", "zh_TW", ""), (3, None, "bad-tag-xxxxxx", None)], "id int, t string, tag string, own string")
    got = df.select(
        "id", sp.strip_marks(F.col("t")).alias("m"), sp.strip_quotes(F.col("t")).alias("q"), sp.unknown_marks(F.col("t"), ["sigh"]).alias("u"), sp.for_engine(F.col("t"), {"soft": "<soft/>"}).alias("e"),
        sp.parse_lang(F.col("tag")).alias("l"), sp.same_language(F.col("tag"), F.lit("zh-Hant")).alias("s"), sp.line_lang(F.col("own"), F.lit("fr")).alias("f"), sp.line_ending(F.col("t")).alias("end"), sp.spoken_units(F.col("t")).alias("n"),
        sp.first_word_containing(F.col("t"), F.lit("test")).alias("at"), sp.with_delivery(F.col("t"), F.lit("calm")).alias("d"),
    ).orderBy("id").collect()
    assert got[0].m == "It's a 'test', “ok”" and got[0].q == "It's {soft} a  test , ok [x]" and got[0].u == ["soft"] and got[0].e.startswith("It's <soft/> a")
    assert tuple(got[0].l) == ("en", None) and tuple(got[1].l) == ("zh", "Hant") and got[2].l is None
    assert [r.s for r in got] == [False, True, None] and [r.f for r in got] == ["film", "fr", "fr"]
    assert got[0].at == 3 and got[1].end == "가" and got[1].n == 4 and got[0].d.startswith("{calm} It")
    units = spark.createDataFrame([("make",), ("table",), ("the",), ("café 12",), ("rhythm",)], "t string").select(sp.spoken_units(F.col("t"))).collect()
    assert [r[0] for r in units] == [1, 2, 1, 4, 1]


def test_programs_on_columns(spark):
    w = "array<struct<w:string,start:double,end:double>>"
    df = spark.createDataFrame([(1, "Two cats.", None, "2 cats", "en", [("two", 0.0, 0.5), ("cats", 0.5, 1.0)]), (2, None, None, None, None, None)], f"id int, text string, say string, heard string, lang string, words {w}")
    got = {r.id: r for r in sp.compared(df, "text", "say", "heard", "lang").collect()}
    assert got[1].compare.rate == 0 and got[2].compare.rate == 0 and got[1].heard == "2 cats"
    assert {r.id: r.normal for r in sp.normalized(df, "text", "lang").collect()} == {1: "2cats", 2: ""}
    aligned = {r.id: r.aligned for r in sp.aligned_words(df, "text", "words", "lang").collect()}
    assert aligned[1].measured == 2 and aligned[1].words[1].end == 1.0 and aligned[2].words == []
    assert [r.diffs for r in sp.token_diffs(df, "text", "heard").orderBy("id").collect()][0][0].want == "Two"
    assert sp.sentence_ends(df, "text", "heard", "lang").filter("id = 1").first().ends[0].heard
    assert sp.words_on_caption(df, "text", "words").filter("id = 1").first().timed[0].w == "Two"
    cues = sp.cues(df, "words").filter("id = 1").first().cues
    assert cues[0].lines == ["two cats"] and sp.spoken_text(df, "say", "text", {"cats": "katz"}).filter("id = 1").first().spoken == "Two katz."
    c = spark.createDataFrame([(1, 0, ["x" * 50], 0.0, 2.0), (1, 1, ["a", "b", "c"], 1.0, 1.0)], "id int, pos int, lines array<string>, start double, end double")
    assert sorted((r.pos, r.finding) for r in sp.check_cues(c, ["id"]).collect()) == [(0, "overlap"), (0, "row too long"), (1, "no duration"), (1, "too many rows")]
    sizes = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 4, 9, 1, 2])], "k string, pos int, size int")
    assert [r.group for r in sp.group_by_size(sizes, ["k"], "size", 7).orderBy("pos").collect()] == [0, 0, 1, 2, 2]
    assert sp.stale_say(df.withColumn("say", F.lit("something else")).withColumn("why", F.lit(None).cast("string")).filter("id = 1"), "text", "say", "why", "lang").count() == 1
    flags = df.select(sp.is_doubtful(F.col("text"), F.col("heard"), F.lit(0.2)).alias("a"), sp.keeps_retake(F.lit(0.1), F.lit(0.2), F.lit(None).cast("string"), F.lit("x")).alias("b")).collect()
    assert [r.a for r in flags] == [True, False] and flags[0].b
    langs = spark.createDataFrame([(1, 0, "x", "fr"), (1, 1, "y", None), (1, 2, "z", "fr")], "f int, pos int, id string, lang string")
    assert [(r.lang, r.ids) for r in sp.by_language(langs, ["f"], "en").collect()] == [("fr", ["x", "z"]), ("en", ["y"])]
    fonts = spark.createDataFrame([("ko", {"*": " ", "ko": "K"}, {"body": "B"}), ("ja", {}, {"body": "B"}), ("ja", None, None)], "lang string, page map<string,string>, plan map<string,string>")
    assert [r[0] for r in fonts.select(sp.font_for_lang(F.col("lang"), F.col("page"), F.col("plan"))).collect()] == ["K", "B", None]
