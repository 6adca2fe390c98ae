"""What is on sampled frames: boxes and regions, runs without change, series and their events.

Range joins are equi-joins on buckets of time or on the frame; boxes are arrays (left, top, right,
bottom).  ``by`` names the key of a clip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.sem import changed_fraction

from .intervals import islands, merge, step_runs

VISIBLE, SHARE, PIXELS = 0.05, 0.1, 16  # least alpha, share of the smaller box, and shared area
EPS = 1e-9


# boxes


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def shared_area(a: Column, b: Column) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def text_overlaps(texts: DataFrame, by: list[str], cell: float = 256.0) -> DataFrame:
    """Pairs of different visible texts of a frame whose boxes overlap: pair, shared area.

    Boxes meet in the cells of a grid that both touch, in the first such cell only, so a frame with
    many texts isn't paired with itself."""
    live = texts.filter((F.col("alpha") >= VISIBLE) & (area(F.col("box")) > 0))
    index = lambda x: F.floor(x / F.lit(cell)).cast("long")
    spots = live.select(*by, "frame", "i", "text", "box", F.explode(F.sequence(index(F.col("box")[0]), index(F.col("box")[2]))).alias("cx"))
    spots = spots.select("*", F.explode(F.sequence(index(F.col("box")[1]), index(F.col("box")[3]))).alias("cy"))
    a, b = spots.alias("a"), spots.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "frame", "cx", "cy"]]
    pairs = a.join(b, [*same, F.col("a.i") < F.col("b.i")] and _all([*same, F.col("a.i") < F.col("b.i"), F.col("a.text") != F.col("b.text")]))
    first = (F.col("a.cx") == F.greatest(index(F.col("a.box")[0]), index(F.col("b.box")[0]))) & (F.col("a.cy") == F.greatest(index(F.col("a.box")[1]), index(F.col("b.box")[1])))
    shared = shared_area(F.col("a.box"), F.col("b.box"))
    pairs = pairs.filter(first & (shared >= PIXELS) & (shared >= SHARE * F.least(area(F.col("a.box")), area(F.col("b.box")))))
    name = F.concat_ws(" / ", F.array_sort(F.array("a.text", "b.text")))
    return pairs.select(*(F.col(f"a.{c}").alias(c) for c in [*by, "frame"]), name.alias("pair"), F.floor(shared + 0.5).cast("long").alias("count"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def text_overlap_spans(texts: DataFrame, by: list[str], step: int) -> DataFrame:
    """Runs of sampled frames on which two texts overlap, with the largest shared area."""
    found = text_overlaps(texts, by).groupBy(*by, "pair", "frame").agg(F.max("count").alias("count"))
    return step_runs(found, [*by, "pair"], "frame", "count", step)


def visible_keys(texts: DataFrame, layers: DataFrame, by: list[str]) -> DataFrame:
    """What a frame shows: texts, and layers whose opacity isn't known or is large enough."""
    t = texts.filter((F.col("alpha") >= VISIBLE) & (F.trim("text") != "")).select(*by, "frame", F.concat(F.lit("text "), F.col("text")).alias("key"))
    shown = layers.filter(F.coalesce("opacity", F.lit(1.0)) >= VISIBLE).select(*by, "frame", F.concat(F.lit("layer "), F.col("id")).alias("key"))
    return t.union(shown).distinct()


def flicker(keys: DataFrame, frames: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Keys on fewer than ``least`` sampled frames in a row, with frames without them on both sides."""
    w = Window.partitionBy(*by).orderBy("frame")
    order = frames.select(*by, "frame", F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy(*by)).alias("all"))
    rows = keys.select(*by, "key", "frame").distinct().join(order, [*by, "frame"])
    own = Window.partitionBy(*by, "key").orderBy("n")
    found = islands(rows, [*by, "key"], ["n"], F.col("n") - F.lag("n").over(own) != 1)
    runs = found.groupBy(*by, "key", "island", "all").agg(F.min("frame").alias("frame"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    size = F.col("hi") - F.col("lo") + 1
    return runs.filter((size < least) & (F.col("lo") > 1) & (F.col("hi") < F.col("all"))).select(*by, "key", "frame", size.alias("frames"))


def region_covers(regions: DataFrame, films: DataFrame, by: list[str], width: float = 5.0) -> DataFrame:
    """Labels, overlays and reserves over key regions: both in time (bucketed) and in place."""
    r = regions.filter(F.size("box") == 4).join(films.select(*by, "duration"), by)
    r = r.withColumn("s", F.coalesce("from", F.lit(0.0))).withColumn("e", F.coalesce("to", "duration")).filter("e > s")
    pad = F.greatest(F.coalesce("outline", F.lit(0.0)), F.lit(0.0)) / 2
    wide = F.array(F.col("box")[0] - pad, F.col("box")[1] - pad, F.col("box")[2] + pad, F.col("box")[3] + pad)
    r = r.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long"))))
    cover = r.filter(F.col("kind").isin("label", "overlay", "reserve")).select(*by, "b", F.coalesce("id", "kind").alias("label"), "kind", wide.alias("cb"), F.col("s").alias("cs"), F.col("e").alias("ce"), "duration")
    key = r.filter("kind = 'key'").select(*by, "b", F.coalesce("id", F.lit("key")).alias("key"), F.col("box").alias("kb"), F.col("s").alias("ks"), F.col("e").alias("ke"))
    both = cover.join(key, [*by, "b"]).withColumn("from", F.greatest("cs", "ks")).withColumn("to", F.least("ce", "ke"))
    shared = shared_area(F.col("cb"), F.col("kb"))
    both = both.filter((F.col("to") > F.col("from")) & (F.col("b") == F.floor(F.col("from") / width)) & (shared > 0))
    return both.select(*by, "label", "key", "from", "to", F.floor(shared + 0.5).cast("long").alias("pixels"), F.when(area(F.col("kb")) > 0, shared / area(F.col("kb"))).otherwise(0.0).alias("share_of_key"), ((F.col("kind") == "overlay") & (F.col("cs") == 0) & (F.col("ce") == F.col("duration"))).alias("always_on"))


def reserve_intrusions(texts: DataFrame, regions: DataFrame, by: list[str], fps: int, width: int = 150) -> DataFrame:
    """Texts inside reserved regions: first and last time, frames and the largest shared area."""
    first, last = F.ceil(F.coalesce("from", F.lit(0.0)) * fps - EPS).cast("long"), F.ceil(F.col("to") * fps - EPS).cast("long") - 1
    r = regions.filter((F.col("kind") == "reserve") & (F.size("box") == 4)).select(*by, F.col("id").alias("reserve"), F.col("box").alias("rb"), F.col("text").alias("own"), first.alias("lo"), last.alias("hi"))
    r = r.filter("hi >= lo").withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))))
    t = texts.filter((F.col("alpha") >= VISIBLE) & (F.trim("text") != "") & (area(F.col("box")) > 0)).withColumn("b", F.floor(F.col("frame") / width).cast("long"))
    shared = shared_area(F.col("box"), F.col("rb"))
    both = t.join(r, [*by, "b"]).filter((F.col("frame") >= F.col("lo")) & (F.col("frame") <= F.col("hi")) & ~F.col("text").eqNullSafe(F.col("own")) & (shared >= PIXELS) & (shared >= SHARE * area(F.col("box"))))
    out = both.groupBy(*by, "reserve", "text").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("frames"), F.max(F.floor(shared + 0.5)).cast("long").alias("pixels"))
    sec = lambda c: F.floor(c / fps * 1000 + 0.5) / 1000
    return out.select(*by, "reserve", "text", sec(F.col("lo")).alias("from"), sec(F.col("hi") + 1).alias("to"), "frames", "pixels")


def glyph_fallbacks(texts: DataFrame, covered: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Characters that a text's font lacks, and fonts that lack all of theirs (two at least).

    texts: frame, text, alpha, font; covered: font, char, ok (null: can't be told)."""
    chars = texts.filter(F.col("alpha") >= VISIBLE).select(*by, "frame", "font", "text", F.explode(F.array_distinct(F.split("text", ""))).alias("char")).filter(F.col("char").rlike(r"^[^\p{Z}\p{C}]+$"))
    seen = chars.groupBy(*by, "font", "char").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames"), F.array_sort(F.collect_set("text")).alias("strings"))
    seen = seen.join(covered, ["font", "char"], "left").withColumn("lacks", ~F.coalesce("ok", F.lit(True)))
    font = Window.partitionBy(*by, "font")
    seen = seen.withColumn("whole", (F.count("*").over(font) >= 2) & F.min("lacks").over(font))
    fonts = seen.filter("whole").groupBy(*by, "font").agg(F.count("*").alias("chars"), F.min("first").alias("first"), F.max("last").alias("last"))
    return seen.filter("lacks and not whole").select(*by, "font", "char", "first", "last", "frames", "strings"), fonts


def contrast_findings(records: DataFrame, by: list[str], fps: float) -> DataFrame:
    """Low-contrast records (key, frame, ratio, text, line) by key, the lowest ratio first, unknown ones last."""
    sec = lambda c: F.floor(c / fps * 1000 + 0.5) / 1000
    out = records.groupBy(*by, "key").agg(F.min("ratio").alias("ratio"), sec(F.min("frame")).alias("from"), sec(F.max("frame")).alias("to"), F.count_distinct("frame").alias("frames"), F.count_distinct("text").alias("texts"), F.count_distinct("line").alias("lines"))
    return out.orderBy(F.asc_nulls_last("ratio"), *by, "key")


def css_color(css: Column) -> Column:
    """#rgb, #rrggbb, rgb() and rgba() as (r, g, b, alpha); null for anything else."""
    s = F.lower(F.trim(css))
    long = F.regexp_extract(s, "^#([0-9a-f]{6})$", 1)
    short = F.regexp_replace(F.regexp_extract(s, "^#([0-9a-f]{3})$", 1), "(.)", "$1$1")
    digits = F.when(long != "", long).when(short != "", short)
    number = r"\s*([0-9.]+)\s*"
    call = rf"^rgba?\({number},{number},{number}(?:,{number})?\)$"
    part = lambda k: F.regexp_extract(s, call, k)
    hexed = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double")
    found = F.when(digits.isNotNull(), F.struct(*(hexed(k).alias(n) for k, n in enumerate("rgb")), F.lit(1.0).alias("alpha")))
    called = F.when(s.rlike(call), F.struct(*(part(k + 1).cast("double").alias(n) for k, n in enumerate("rgb")), F.when(part(4) == "", F.lit(1.0)).otherwise(part(4).cast("double")).alias("alpha")))
    return F.coalesce(found, called)


def worst_tail(bins: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """The value at the lowest ``share`` of a weighted distribution (value, weight)."""
    w = Window.partitionBy(*by).orderBy("value")
    rows = bins.groupBy(*by, "value").agg(F.sum("weight").alias("weight"))
    rows = rows.withColumn("upto", F.sum("weight").over(w)).withColumn("all", F.sum("weight").over(Window.partitionBy(*by)))
    return rows.filter(F.col("upto") >= F.col("all") * share).groupBy(*by).agg(F.min("value").alias("value"))


# frames without change


def is_black(gray: Column, most: int = 25, share: float = 0.98) -> Column:
    n = F.size(gray)
    return (n > 0) & (F.size(F.filter(gray, lambda x: x <= most)) >= F.lit(share) * n)


def unchanged(a: Column, b: Column, above: float = 6, share: float = 0.002) -> Column:
    return changed_fraction(a, b, above) < share


def sample_clock(fps: float, step: float, frames: int) -> list[int]:
    """Sampled frames: every ``step`` seconds, half up, without repeats."""
    out, k = [], 0
    while (f := math.floor(k * step * fps + 0.5)) < frames:
        if not out or f > out[-1]:
            out.append(f)
        k += 1
    return out


def could_freeze(before: Column, after: Column, fps: float, least: float = 0.8) -> Column:
    return (after - before - 1) / fps >= least - EPS


def recheck_span(first: Column, last: Column, fps: float, recheck: float = 1.0) -> Column:
    pad = math.floor(recheck * fps + 0.5)
    return F.struct(F.greatest(F.lit(0), first - pad).alias("from"), (last + 1 + pad).alias("to"))


def pair_runs(pairs: DataFrame, by: list[str], fps: float, least: float = 0.8) -> DataFrame:
    """Runs of pairs (p, still) without change of at least ``least`` seconds: from and length in seconds."""
    w = Window.partitionBy(*by).orderBy("p")
    still = F.coalesce("still", F.lit(False))
    found = islands(pairs.withColumn("still", still), by, ["p"], (F.col("still") != F.lag("still").over(w)) | (F.col("p") - F.lag("p").over(w) != 1)).filter("still")
    n = F.col("__n")
    out = found.groupBy(*by, "island").agg(F.min("p").alias("p"), F.count("*").alias("__n"))
    return out.filter(n / fps >= least - EPS).select(*by, (F.col("p") / fps).alias("from"), (n / fps).alias("length"))


def suspects(samples: DataFrame, by: list[str], fps: float, least: float = 0.8, recheck: float = 1.0) -> DataFrame:
    """Spans of pairs to look at closely: runs of still samples (p, still, pairs) with room enough for a
    freeze between the changes around them, widened and merged on touch."""
    w = Window.partitionBy(*by).orderBy("p")
    found = islands(samples, by, ["p"], F.col("still") != F.lag("still").over(w))
    found = found.withColumn("__prev", F.lag("p").over(w)).withColumn("__next", F.lead("p").over(w))
    runs = found.filter("still").groupBy(*by, "island", "pairs").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.min_by("__prev", "p").alias("before"), F.max_by("__next", "p").alias("after"))
    runs = runs.filter(could_freeze(F.coalesce("before", F.lit(-1)), F.coalesce("after", "pairs"), fps, least))
    span = recheck_span(F.col("first"), F.col("last"), fps, recheck)
    spans = runs.select(*by, span["from"].alias("from"), F.least(span["to"], F.col("pairs")).alias("to"))
    return merge(spans, by, "from", "to").drop("n_spans")


def freezes(frames: DataFrame, by: list[str], fps: float, step: float = 0.1, least: float = 0.8, recheck: float = 1.0) -> DataFrame:
    """Freezes of a clip (frame, gray): samples first, then every pair within the suspect spans.

    Only sampled pairs are compared at first; the dense comparison reads the frames of suspect
    spans, joined by their buckets."""
    f = frames.select(*by, "frame", "gray")
    size = f.groupBy(*by).agg((F.max("frame")).alias("pairs"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor(F.col("pairs") / (step * fps))).cast("long")))
    wanted = size.select(*by, "pairs", k.alias("k")).select(*by, "pairs", F.floor(F.col("k") * step * fps + 0.5).cast("long").alias("p")).distinct().filter("p < pairs")

    def compared(want: DataFrame) -> DataFrame:
        a = want.join(f.withColumnRenamed("frame", "p").withColumnRenamed("gray", "a"), [*by, "p"])
        b = f.select(*by, (F.col("frame") - 1).alias("p"), F.col("gray").alias("b"))
        return a.join(b, [*by, "p"]).withColumn("still", unchanged(F.col("a"), F.col("b"))).drop("a", "b")

    spans = suspects(compared(wanted), by, fps, least, recheck)
    dense = spans.select(*by, F.explode(F.sequence(F.col("from").cast("long"), F.col("to").cast("long") - 1)).alias("p"))
    return pair_runs(compared(dense), by, fps, least)


def without_holds(runs: DataFrame, hold_start: Column, least: float) -> DataFrame:
    """Runs (from, length) cut at a film's end hold; what is still long enough."""
    length = F.least(F.col("from") + F.col("length"), hold_start) - F.col("from")
    return runs.withColumn("length", length).filter(F.col("length") >= least - EPS)


def motion_summary(runs: DataFrame, clips: DataFrame, by: list[str]) -> DataFrame:
    """A row for each clip: its freezes, the longest, and their sum."""
    found = runs.groupBy(*by).agg(F.count("*").alias("freezes"), F.max("length").alias("longest"), F.sum("length").alias("total"))
    return clips.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("freezes", F.lit(0)).alias("freezes"), F.coalesce("longest", F.lit(0.0)).alias("longest"), F.coalesce("total", F.lit(0.0)).alias("total"))


def picture_scan(frames: DataFrame, by: list[str], fps: float, expected: Column) -> DataFrame:
    """One look at a clip's frames: black frames, neighbours that are equal, and frames too many or few."""
    w = Window.partitionBy(*by).orderBy("frame")
    rows = frames.withColumn("__black", is_black(F.col("gray"))).withColumn("__same", F.coalesce(F.lag("gray").over(w) == F.col("gray"), F.lit(False)))
    out = rows.groupBy(*by).agg(F.count("*").alias("frames"), F.count_if("__black").alias("black"), F.count_if("__same").alias("equal_neighbours"))
    return out.withColumn("frame_delta", F.col("frames") - F.floor(expected * fps + 0.5))


# series and windows of levels


def events(series: DataFrame, by: list[str], opened: float = 0.1, peak: float = 0.5) -> DataFrame:
    """Excursions of a series (t, v) over ``opened`` that reach ``peak``: edges interpolated, milliseconds half up."""
    w = Window.partitionBy(*by).orderBy("t")
    rows = series.withColumn("__up", F.col("v") > opened)
    for c in ("t", "v"):
        rows = rows.withColumn(f"__p{c}", F.lag(c).over(w)).withColumn(f"__n{c}", F.lead(c).over(w))
    found = islands(rows, by, ["t"], F.col("__up") != F.lag("__up").over(w)).filter("__up")
    at = lambda t0, v0, t1, v1: F.when(F.col(v1) == F.col(v0), F.col(t1)).otherwise(F.col(t0) + (opened - F.col(v0)) / (F.col(v1) - F.col(v0)) * (F.col(t1) - F.col(t0)))
    found = found.withColumn("__s", F.when(F.col("__pt").isNotNull(), at("__pt", "__pv", "t", "v")).otherwise(F.col("t"))).withColumn("__e", F.when(F.col("__nt").isNotNull(), at("t", "v", "__nt", "__nv")).otherwise(F.col("t")))
    held = F.when(F.col("v") >= peak, F.col("t"))
    out = found.groupBy(*by, "island").agg(F.min_by("__s", "t").alias("s"), F.max_by("__e", "t").alias("e"), F.max("v").alias("top"), F.min_by("t", F.struct(-F.col("v"), "t")).alias("top_at"), F.min(held).alias("h0"), F.max(held).alias("h1")).filter(F.col("top") >= peak)
    ms = lambda c: F.floor(c * 1000 + 0.5) / 1000
    s, e, at_ = F.col("s"), F.col("e"), F.col("top_at")
    return out.select(*by, ms(s).alias("start"), ms(at_).alias("peak_at"), ms(F.col("top")).alias("peak"), ms(e).alias("end"), ms(at_ - s).alias("rise"), ms(e - at_).alias("fall"), ms(e - s).alias("total"), ms(F.col("h1") - F.col("h0")).alias("held"))


def event_flags(found: DataFrame, by: list[str], shortest: float = 0.1, apart: float = 1.5, k: int = 3, within: float = 1.0) -> DataFrame:
    """Events that are too fast, too close to the one before, or the first of ``k`` within a while."""
    w = Window.partitionBy(*by).orderBy("start")
    gap = F.floor((F.col("start") - F.lag("start").over(w)) * 1000 + 0.5) / 1000
    burst = F.lead("start", k - 1).over(w) - F.col("start") <= within
    rows = found.select(*by, F.col("start").alias("at"), F.array_compact(F.array(F.when(F.col("total") < shortest, "fast"), F.when(gap < apart, "close"), F.when(burst, "flutter"))).alias("flags"))
    return rows.select(*by, "at", F.explode("flags").alias("flag"))


def level_runs(windows: DataFrame, by: list[str], above: float, bridge: int, shortest: int) -> DataFrame:
    """Open spans of windows (i, level): closures of up to ``bridge`` windows inside are bridged, spans of
    fewer than ``shortest`` dropped; first, last and mean level."""
    loud = windows.filter(F.col("level") > above)
    w = Window.partitionBy(*by).orderBy("i")
    found = islands(loud, by, ["i"], F.col("i") - F.lag("i").over(w) - 1 > bridge)
    out = found.groupBy(*by, "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.avg("level").alias("level"))
    return out.filter(F.col("last") - F.col("first") + 1 >= shortest).drop("island")


def dips(windows: DataFrame, by: list[str], depth: float = 15.0, least: int = 2) -> DataFrame:
    """Runs of windows (i, db) far below the clip's median, with windows over it of the same width on both sides."""
    mid = windows.groupBy(*by).agg((F.median("db") - depth).alias("floor"))
    rows = windows.join(mid, by)
    w = Window.partitionBy(*by).orderBy("i")
    low = F.col("db") < F.col("floor")
    found = islands(rows.withColumn("low", low), by, ["i"], F.col("low") != F.lag("low").over(w))
    runs = found.groupBy(*by, "island", "low").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("island")
    runs = runs.withColumn("left", F.lag("n").over(order)).withColumn("right", F.lead("n").over(order))
    return runs.filter(F.col("low") & (F.col("n") >= least) & (F.col("left") >= F.col("n")) & (F.col("right") >= F.col("n"))).select(*by, "first", "last", "n")


def quiet_runs(windows: DataFrame, by: list[str], below: float) -> DataFrame:
    """Runs of quiet windows (i, rms), those at the edges too, each with its quietest window."""
    w = Window.partitionBy(*by).orderBy("i")
    rows = windows.withColumn("quiet", F.col("rms") <= below)
    found = islands(rows, by, ["i"], F.col("quiet") != F.lag("quiet").over(w)).filter("quiet")
    return found.groupBy(*by, "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min_by("i", F.struct("rms", "i")).alias("quietest")).drop("island")


def rms_windows(pcm: DataFrame, by: list[str], sec: float = 0.01) -> DataFrame:
    """Windows (i, rms) of a clip's samples (rate, samples): the last may be shorter."""
    n = F.greatest(F.lit(1), F.floor(F.col("rate") * sec + 0.5)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("samples") / F.col("__n")).cast("int") - 1), lambda i: F.slice(F.col("samples"), i * F.col("__n") + 1, F.col("__n")))
    rms = F.transform(cuts, lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.size(x)))
    rows = pcm.withColumn("__n", n).filter(F.size("samples") > 0)
    return rows.select(*by, (F.col("__n") / F.col("rate")).alias("sec"), F.posexplode(rms).alias("i", "rms"))


def pcm_gaps(pcm: DataFrame, by: list[str], gate: float = 1.0, quiet_db: float = -50.0) -> DataFrame:
    """Silences between sounds of at least ``gate`` seconds: from, to; none before the first or after the last sound."""
    found = quiet_runs_between(rms_windows(pcm, by), by, 10 ** (quiet_db / 20))
    return found.filter(F.col("to") - F.col("from") >= gate - EPS)


def quiet_runs_between(windows: DataFrame, by: list[str], below: float) -> DataFrame:
    """From the window behind a sound to the next sound: consecutive sounds with windows between them."""
    loud = windows.filter(F.col("rms") > below)
    w = Window.partitionBy(*by).orderBy("i")
    rows = loud.withColumn("__next", F.lead("i").over(w)).filter(F.col("__next") - F.col("i") > 1)
    return rows.select(*by, ((F.col("i") + 1) * F.col("sec")).alias("from"), (F.col("__next") * F.col("sec")).alias("to"))


def longest_silence(pcm: DataFrame, by: list[str], quiet_db: float = -50.0) -> DataFrame:
    """First sound, longest silence after it, and silence at the end, in seconds."""
    rows = rms_windows(pcm, by)
    w = Window.partitionBy(*by).orderBy("i")
    loud = F.when(F.col("rms") > 10 ** (quiet_db / 20), F.col("i"))
    rows = rows.withColumn("__at", loud).withColumn("__end", F.max("i").over(Window.partitionBy(*by)))
    sounds = rows.filter("__at is not null").withColumn("__gap", F.coalesce(F.lead("__at").over(w), F.col("__end") + 1) - F.col("__at") - 1)
    found = sounds.groupBy(*by).agg((F.max("__gap") * F.max("sec")).alias("longest"), (F.min("__at") * F.max("sec")).alias("first_sound"), ((F.max("__end") - F.max("__at")) * F.max("sec")).alias("trailing"))
    return pcm.select(*by).distinct().join(found, by, "left").withColumn("longest", F.coalesce("longest", F.lit(0.0)))


def silence_cuts(quiet: DataFrame, by: list[str], pieces: Column) -> DataFrame:
    """Middles of the longest quiet runs (first, last), one fewer than ``pieces``, in order of time;
    nothing for a clip with too few."""
    size = F.col("last") - F.col("first") + 1
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(size), "first"))
    rows = quiet.withColumn("__rank", rank).withColumn("__need", pieces - 1).withColumn("__have", F.count("*").over(Window.partitionBy(*by)))
    return rows.filter("__rank <= __need and __have >= __need").select(*by, ((F.col("first") + F.col("last") + 1) / 2).alias("at"))


# sampled times


def sample_times(lines: DataFrame, by: list[str], fps: float, short: float = 0.5) -> DataFrame:
    """Frames at 0.2, 0.5 and 0.8 of a line; of a short one the middle only."""
    at = F.when(F.col("end") - F.col("start") < short, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))
    rows = lines.select(*by, "id", "start", "end", F.explode(at).alias("share"))
    return rows.select(*by, "id", F.floor((F.col("start") + (F.col("end") - F.col("start")) * F.col("share")) * fps + 0.5).cast("long").alias("frame")).distinct()


def steady_spans(clips: DataFrame, by: list[str], rate: float) -> DataFrame:
    """Spans of a steady rate (open half of each period) between a clip's start and end."""
    period = 1.0 / rate
    n = F.ceil((F.col("end") - F.col("start")) / period).cast("int")
    rows = clips.filter("end > start").select(*by, "start", "end", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select(*by, (F.col("start") + F.col("k") * period).alias("from"), F.least(F.col("end"), F.col("start") + (F.col("k") + 0.5) * period).alias("to"))


def frames_in(a: Column, b: Column, fps: float, inclusive: bool = False) -> Column:
    """How many whole frames lie in [a, b) or [a, b]."""
    first = F.ceil(a * fps - EPS)
    last = F.floor(b * fps + EPS) if inclusive else F.ceil(b * fps - EPS) - 1
    return F.greatest(F.lit(0), last - first + 1).cast("long")


def probe_frames(start: Column, end: Column) -> Column:
    """First, middle and last frame of [start, end)."""
    return F.array(start, start + F.floor((end - 1 - start) / 2), end - 1)


def max_step(samples: Column, first: Column, last: Column) -> Column:
    """Largest difference of neighbouring samples x[i] - x[i-1] for i in (first, last)."""
    a = F.slice(samples, F.greatest(first, F.lit(0)) + 1, F.greatest(last - F.greatest(first, F.lit(0)), F.lit(0)))
    steps = F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.abs(x.cast("double") - y))
    return F.coalesce(F.array_max(steps), F.lit(0.0))


def typical_step(samples: Column, first: Column, last: Column, margin: int) -> Column:
    """The same without a margin at both ends, unless nothing would be left."""
    return F.when(last - first > 2 * margin, max_step(samples, first + margin, last - margin)).otherwise(max_step(samples, first, last))


def join_click(window: Column, typical: Column, factor: float = 2.0) -> Column:
    """How much larger the step at a join is than elsewhere, and whether that is a click."""
    ratio = F.when(typical > 0, window / typical).when(window > 0, F.lit(float("inf"))).otherwise(1.0)
    return F.struct(ratio.alias("ratio"), (ratio > factor).alias("click"))


def join_window(rate: Column, at: Column, ms: float = 20.0) -> Column:
    half = F.floor(rate * ms / 1000 + 0.5)
    mid = F.floor(at * rate + 0.5)
    return F.struct(F.greatest(F.lit(0), mid - half).alias("first"), (mid + half).alias("last"))


def part_spans(cuts: Column, total: Column) -> Column:
    """Consecutive spans between cut points inside (0, total)."""
    inner = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c > 0) & (c < total))))
    edges = F.concat(F.array(F.lit(0.0)), inner, F.array(total.cast("double")))
    return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
