"""Lines, shots and voices of films: what is carried over, segments, tempo, findings on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.sem import contrast, luminance

from .frames import css_color
from .intervals import islands
from .speech import parse_lang


def carried_words(before: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """Words of lines (id, text, start, words) whose text stayed, moved with their line; others have none."""
    old = before.select(*by, "id", F.col("text").alias("__t"), F.col("start").alias("__s"), "words")
    rows = now.join(old, [*by, "id"], "left")
    move = F.col("start") - F.col("__s")
    words = F.transform("words", lambda w: F.struct(w["w"].alias("w"), (w["start"] + move).alias("start"), (w["end"] + move).alias("end")))
    return rows.withColumn("words", F.when(F.col("text") == F.col("__t"), words)).drop("__t", "__s")


def cast_voices(wanted: DataFrame, voices: DataFrame) -> DataFrame:
    """The voice of each speaker and language (speaker, lang): of that tag, else the only one of the language.

    ``problem`` tells of none, or of several that fit as well."""
    v = voices.select("speaker", F.col("lang").alias("__tag"), "voice", parse_lang(F.col("lang"))["lang"].alias("__l"))
    rows = wanted.withColumn("__l", parse_lang(F.col("lang"))["lang"]).join(v, ["speaker", "__l"], "left")
    exact = F.col("__tag") == F.col("lang")
    out = rows.groupBy("speaker", "lang").agg(F.array_sort(F.collect_set(F.when(exact, F.col("voice")))).alias("e"), F.array_sort(F.collect_set("voice")).alias("s"))
    best = F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("s"))
    return out.select("speaker", "lang", F.when(F.size(best) == 1, best[0]).alias("voice"), F.when(F.size(best) == 0, "no voice").when(F.size(best) > 1, "several voices").alias("problem"))


def segments(shots: DataFrame, films: DataFrame, by: list[str]) -> DataFrame:
    """Shots (pos, id, start, end) as segments of frames: a shot that doesn't begin where all before it end
    belongs to the segment before (``merged``).  The first begins at 0, the last ends with the film."""
    f = films.select(*by, "fps", F.floor(F.col("duration") * F.col("fps") + 0.5).cast("long").alias("total"))
    w = Window.partitionBy(*by).orderBy("pos")
    frame = lambda c: F.floor(F.col(c) * F.col("fps") + 0.5).cast("long")
    rows = shots.join(f, by).withColumn("s", F.when(F.lag("pos").over(w).isNull(), 0).otherwise(frame("start"))).withColumn("e", F.when(F.lead("pos").over(w).isNull(), F.col("total")).otherwise(frame("end")))
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = islands(rows, by, ["pos"], F.col("s") == reach)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    out = found.groupBy(*by, "island").agg(F.min("s").alias("frame_start"), F.max("e").alias("frame_end"), ids.alias("shots"))
    return out.select(*by, F.array_join("shots", "+").alias("id"), "frame_start", "frame_end", "shots", (F.size("shots") > 1).alias("merged"))


def fit_tempo(films: DataFrame, durations: str, pauses: str, target: Column, floor: float, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """The speed at which a film's stages (arrays of seconds), none shorter than ``floor``, and its pauses
    last as long as wanted: 80 halvings on the geometric mean, nearer of the bounds if none does."""

    def length(speed: Column) -> Column:
        own = F.aggregate(durations, F.lit(0.0), lambda s, d: s + F.greatest(F.lit(floor), d / speed))
        return own + F.aggregate(pauses, F.lit(0.0), lambda s, p: s + p) / speed

    def halve(b: Column, _: Column) -> Column:
        mid = F.sqrt(b["lo"] * b["hi"])
        slow = length(mid) > target
        return F.struct(F.when(slow, mid).otherwise(b["lo"]).alias("lo"), F.when(slow, b["hi"]).otherwise(mid).alias("hi"))

    bounds = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")), halve)
    return films.withColumn("speed", F.sqrt(bounds["lo"] * bounds["hi"]))


def text_findings(rows: DataFrame, text: str, lang: str, rules: list[tuple[str, str, str, str]], context: int = 8) -> DataFrame:
    """Findings of rules (language or ``*``, pattern, name, severity) with an excerpt; null for a language without rules."""
    kind = F.lower(F.regexp_extract(F.col(lang), "^([A-Za-z]+)", 1))
    known = sorted({r[0] for r in rules} - {"*"})
    one = lambda p, n, s: F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_extract(F.col(text), f"(.{{0,{context}}}(?:{p}).{{0,{context}}})", 1).alias("excerpt"))
    found = F.array_compact(F.array(*(F.when((F.lit(k == "*") | (kind == k)) & F.col(text).rlike(p), one(p, n, s)) for k, p, n, s in rules)))
    return rows.withColumn("findings", F.when(kind.isin(known), found))


def judge_text(color: Column, grounds: Column, alpha: Column) -> Column:
    """The lowest contrast of a text's colour, laid over them by its alpha, with the colours behind it, and its grade;
    null where a colour can't be read."""
    channel = lambda c, g, k: (css_color(c)[k] * alpha + css_color(g)[k] * (1 - alpha)) / 255
    own = lambda g: luminance(*(channel(color, g, k) for k in "rgb"))
    behind = lambda g: luminance(*(css_color(g)[k] / 255 for k in "rgb"))
    read = css_color(color).isNotNull() & ~F.exists(grounds, lambda g: css_color(g).isNull())
    ratio = F.when(read, F.array_min(F.transform(grounds, lambda g: contrast(own(g), behind(g)))))
    return F.struct(ratio.alias("ratio"), F.when(ratio < 3, "fail").when(ratio < 4.5, "large only").when(ratio.isNotNull(), "pass").alias("grade"))


def split_by_audio(lines: DataFrame, clips: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines that have a clip and lines that have none."""
    key = [*by, "id"]
    have = clips.select(*key).distinct()
    return lines.join(have, key, "left_semi"), lines.join(have, key, "left_anti")


def with_heard(lines: DataFrame, heard: DataFrame, by: list[str], doubtful: float = 0.15) -> DataFrame:
    """Lines with what was heard of them (id, heard, rate, against): a struct, and a flag that, once set, stays."""
    h = heard.select(*by, "id", F.struct("heard", "rate", "against").alias("__h"))
    rows = lines.join(h, [*by, "id"], "left")
    return rows.withColumn("flag", F.coalesce("flag", F.when(F.col("__h.rate") > doubtful, "doubtful"))).withColumn("stt", F.coalesce("__h", "stt")).drop("__h")


def probe_times(shots: DataFrame, films: DataFrame, by: list[str], rate: float, least: int = 12) -> DataFrame:
    """Times to look at: shots' starts and middles, and the middles of the film's periods up to ``least`` times."""
    own = shots.select(*by, F.explode(F.array("start", (F.col("start") + F.col("end")) / 2)).alias("t"))
    n = F.least(F.lit(least), F.greatest(F.lit(1), F.floor(F.col("duration") * rate))).cast("int")
    even = films.select(*by, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k + 0.5) * F.col("duration") / n)).alias("t"))
    return own.union(even).select(*by, (F.floor(F.col("t") * 1000 + 0.5) / 1000).alias("t")).distinct()
