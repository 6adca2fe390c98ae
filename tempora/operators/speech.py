"""Spoken text in columns: marks, languages, units, error rates, alignment and captions.

Column expressions where built-in functions say it; what needs a program (``tempora.functions.speech``)
runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tempora.functions import speech
from tempora.functions.session import prepare

HANGUL, HAN, KANA = "가-힣", "一-鿿", "぀-ヿ"
DIFFS = "array<struct<want:string,heard:string>>"
WORDS = "array<struct<w:string,start:double,end:double>>"


def _mapped(df: DataFrame, columns: list[str], f: Callable, name: str, kind: str) -> DataFrame:
    """``df`` with f(of the columns) as a column, a new one or in place of its own, row by row in Arrow batches."""
    prepare(df.sparkSession)
    kept = [k for k, c in enumerate(df.columns) if c != name]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != name) + f", `{name}` {kind}"
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [f(*x) for x in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(values, arrow)], names=[*(batch.schema.names[k] for k in kept), name])

    arrow = to_arrow_type(StructType.fromDDL(f"`{name}` {kind}")[0].dataType)
    return df.mapInArrow(run, schema)


# marks and languages, as expressions


def strip_breaks(x: Column) -> Column:
    return F.array_join(caption_words(x), " ")


def caption_words(x: Column) -> Column:
    return F.filter(F.split(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(" ")), r"\s+"), lambda w: w != "")


def first_word_containing(x: Column, part: Column) -> Column:
    """Place (from 0) of the first caption word that contains a string, -1 without one."""
    return (F.array_position(F.transform(caption_words(x), lambda w: F.contains(w, part)), True) - 1).cast("int")


def strip_quotes(x: Column) -> Column:
    """Without quotation marks; apostrophes inside words stay."""
    out = F.regexp_replace(x, "[\"“”„«»「」『』]", "")
    return F.regexp_replace(out, r"(?<![\p{L}\p{N}])['‘’]|['‘’](?![\p{L}\p{N}])", "")


def strip_marks(x: Column) -> Column:
    """Without {marks} and [marks], single blanks, none before punctuation."""
    out = F.regexp_replace(F.regexp_replace(x, r"\{[^{}]*\}|\[[^\[\]]*\]", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"\s+([,.;:!?…。、，！？])", "$1"))


def mark_spans(x: Column) -> Column:
    """Names of the {marks} of a text, in order."""
    return F.regexp_extract_all(x, F.lit(r"\{([^{}]*)\}"), 1)


def unknown_marks(x: Column, known: list[str]) -> Column:
    return F.array_except(F.transform(mark_spans(x), lambda m: F.lower(F.trim(m))), F.array(*map(F.lit, known)).cast("array<string>"))


def for_engine(x: Column, marks: dict[str, str]) -> Column:
    """{marks} in the words of an engine; those that it doesn't know are dropped."""
    out = x
    for name, said in sorted(marks.items()):
        out = F.regexp_replace(out, r"(?i)\{\s*" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in name) + r"\s*\}", said.replace("\\", "\\\\").replace("$", "\\$"))
    out = F.regexp_replace(out, r"\{[^{}]*\}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+([,.;:!?…。、，！？])", "$1"))


def with_delivery(x: Column, mark: Column) -> Column:
    """A delivery mark before a text, unless it begins with one."""
    return F.when(mark.isNull() | (mark == "") | x.startswith("{"), x).otherwise(F.concat(F.lit("{"), mark, F.lit("} "), x))


def spoken_text(df: DataFrame, say: str, text: str, words: dict[str, str], name: str = "spoken") -> DataFrame:
    """What is said: ``say`` or else the caption, without breaks and quotation marks, with words respelled, the longest first."""
    pairs = [(s, w) for w, s in sorted(words.items(), key=lambda x: -len(x[0]))]
    plain = df.withColumn(name, strip_quotes(strip_breaks(F.coalesce(F.nullif(F.col(say), F.lit("")), F.col(text)))))
    return _mapped(plain, [name], lambda x: speech.fold_names(x or "", pairs), name, "string")


def line_lang(own: Column, film: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), film)


def parse_lang(tag: Column) -> Column:
    """(lang, script) of a language tag; for Chinese a region tells the script; null if malformed."""
    t = F.regexp_replace(F.trim(tag), "_", "-")
    ok = t.rlike("^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?$")
    lang = F.lower(F.regexp_extract(t, "^([A-Za-z]{2,3})", 1))
    script = F.initcap(F.regexp_extract(t, "^[A-Za-z]{2,3}-([A-Za-z]{4})", 1))
    region = F.upper(F.regexp_extract(t, "-([A-Za-z]{2}|[0-9]{3})$", 1))
    implied = F.when(lang == "zh", F.when(region.isin("TW", "HK", "MO"), "Hant").when(region.isin("CN", "SG"), "Hans"))
    return F.when(ok, F.struct(lang.alias("lang"), F.coalesce(F.nullif(script, F.lit("")), implied).alias("script")))


def same_language(a: Column, b: Column) -> Column:
    """True, false, or null where a tag can't be read; a script that is not given fits any."""
    x, y = parse_lang(a), parse_lang(b)
    script = x["script"].isNull() | y["script"].isNull() | (x["script"] == y["script"])
    return F.when(x.isNotNull() & y.isNotNull(), (x["lang"] == y["lang"]) & script)


def font_for_lang(lang: Column, page: Column, plan: Column) -> Column:
    """The first named font: of the page for the language or any, then of the plan."""
    pick = lambda m, k: F.nullif(F.trim(F.try_element_at(m, k)), F.lit(""))
    return F.coalesce(pick(page, lang), pick(page, F.lit("*")), pick(plan, lang), *(pick(plan, F.lit(k)) for k in ("caption", "body", "default")))


def by_language(rows: DataFrame, by: list[str], default: str) -> DataFrame:
    """Languages in the order in which they are first seen, with the ids of their rows."""
    lang = F.coalesce("lang", F.lit(default))
    return rows.groupBy(*by, lang.alias("lang")).agg(F.min("pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids")).orderBy(*by, "first")


# counts


def spoken_units(x: Column) -> Column:
    """Syllables, about: one for each Han, Hangul or kana character and each digit; a Latin word has one
    for each group of vowels, less a silent e at its end, and one at least."""
    text = F.lower(F.coalesce(x, F.lit("")))
    words = F.regexp_extract_all(text, F.lit(r"\p{IsLatin}+"), 0)
    vowels = "[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ]+"

    def one(w: Column) -> Column:
        n = F.regexp_count(w, F.lit(vowels))
        return F.greatest(F.lit(1), n - F.when((n > 1) & w.rlike("[^aeiouy]e$") & ~w.rlike("[^aeiouy]le$"), 1).otherwise(0))

    latin = F.aggregate(F.transform(words, one), F.lit(0), lambda s, n: s + n)
    return (latin + F.regexp_count(text, F.lit(f"[{HANGUL}{HAN}{KANA}0-9]"))).cast("long")


def line_ending(x: Column) -> Column:
    """How a line ends: its last character in syllabic scripts, else its last word, lower case."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}]+$", "")
    last = F.regexp_extract(bare, r"([\p{L}\p{N}'’]+)$", 1)
    return F.when(bare.rlike(f"[{HANGUL}{HAN}{KANA}]$"), F.right(bare, F.lit(1))).otherwise(F.lower(last))


def base_rate(timings: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Spoken units a second over lines with a length and units."""
    rows = timings.join(plan.select(*by, "id", "text"), [*by, "id"], "left").withColumn("units", spoken_units(F.col("text"))).withColumn("sec", F.col("end") - F.col("start"))
    return rows.filter("sec > 0 and units > 0").groupBy(*by).agg((F.sum("units") / F.sum("sec")).alias("rate"))


def group_by_size(rows: DataFrame, by: list[str], size: str, limit: int) -> DataFrame:
    """Rows (pos, size) in groups of at most ``limit``, in order; a larger row is a group of its own.

    A group's place depends on all before it, so a key's sizes, and nothing else of it, are read in order."""
    prepare(rows.sparkSession)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in by or c == "pos")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        pdf["group"] = speech.pack_by_size(pdf[size].tolist(), limit)
        return pdf[[*by, "pos", "group"]]

    groups = rows.select(*by, "pos", size).groupBy(*by).applyInPandas(pack, fields + ", `group` long")
    return rows.join(groups, [*by, "pos"])


# programs on columns


def normalized(df: DataFrame, text: str, lang: str, name: str = "normal") -> DataFrame:
    return _mapped(df, [text, lang], lambda x, y: speech.normal_form(x, y), name, "string")


def compared(df: DataFrame, text: str, say: str, heard: str, lang: str) -> DataFrame:
    """With ``compare``: the lesser error rate of caption and say text, which one it is, and the differences."""
    return _mapped(df, [text, say, heard, lang], speech.compare_line, "compare", f"struct<rate:double,against:string,diffs:{DIFFS}>")


def token_diffs(df: DataFrame, target: str, heard: str) -> DataFrame:
    return _mapped(df, [target, heard], speech.token_diffs, "diffs", DIFFS)


def sentence_ends(df: DataFrame, target: str, heard: str, lang: str) -> DataFrame:
    return _mapped(df, [target, heard, lang], speech.sentence_ends, "ends", "array<struct<sentence:int,final:string,heard:boolean>>")


def _tuples(words: list[dict] | None) -> list[tuple]:
    return [(w["w"], w["start"], w["end"]) for w in words or []]


def aligned_words(df: DataFrame, text: str, words: str, lang: str) -> DataFrame:
    """With ``aligned`` words in time and how many are ``measured``."""

    def run(t: str | None, w: list[dict] | None, x: str | None) -> dict:
        found, measured = speech.align_words(t, _tuples(w), x)
        return {"words": [dict(zip(("w", "start", "end"), f, strict=True)) for f in found], "measured": measured}

    return _mapped(df, [text, words, lang], run, "aligned", f"struct<words:{WORDS},measured:int>")


def words_on_caption(df: DataFrame, text: str, words: str) -> DataFrame:
    return _mapped(df, [text, words], lambda t, w: [dict(zip(("w", "start", "end"), f, strict=True)) for f in speech.words_on_caption(t, _tuples(w))], "timed", WORDS)


def cues(df: DataFrame, words: str, row: int = 42, rows: int = 2) -> DataFrame:
    return _mapped(df, [words], lambda w: speech.build_cues(_tuples(w), row, rows), "cues", "array<struct<lines:array<string>,start:double,end:double>>")


def check_cues(found: DataFrame, by: list[str], row: int = 42, rows: int = 2) -> DataFrame:
    """Findings on cues (pos, lines, start, end): too many rows, too long a row, overlap, no duration."""
    nxt = F.lead("start").over(Window.partitionBy(*by).orderBy("pos"))
    rules = F.array(
        F.when(F.size("lines") > rows, "too many rows"), F.when(F.exists("lines", lambda x: F.length(x) > row), "row too long"),
        F.when(nxt < F.col("end") - 1e-9, "overlap"), F.when(F.col("end") <= F.col("start"), "no duration"),
    )
    return found.select(*by, "pos", F.array_compact(rules).alias("found")).select(*by, "pos", F.explode("found").alias("finding"))


def is_doubtful(target: Column, heard: Column, rate: Column, above: float = 0.15) -> Column:
    """Whether a line should be heard again: nothing heard or a high error rate; not without a target."""
    return F.coalesce(F.length(F.trim(target)) > 0, F.lit(False)) & (F.coalesce(F.trim(heard), F.lit("")).eqNullSafe("") | F.coalesce(rate > above, F.lit(False)))


def keeps_retake(new_rate: Column, old_rate: Column, new_flag: Column, old_flag: Column) -> Column:
    """A new take stays if it is no worse heard, and isn't flagged where the old one wasn't."""
    worse = new_rate > old_rate
    return ~F.coalesce(worse, F.lit(False)) & ~(new_flag.isNotNull() & old_flag.isNull())


def stale_say(df: DataFrame, text: str, say: str, why: str, lang: str, above: float = 0.3) -> DataFrame:
    """Lines whose say text is far from the caption, without a reason given."""
    out = _mapped(df.filter(F.col(say).isNotNull() & F.coalesce(F.trim(why), F.lit("")).eqNullSafe("")), [text, say, lang], lambda a, b, c: speech.error_rate(a, b, c), "rate", "double")
    return out.filter(F.col("rate") > above)
