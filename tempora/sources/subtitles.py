"""SubRip subtitles as tables of cues: reading, writing and moving, all in SQL functions.

A text is made of paragraphs with blank lines between.  In each, one line holds two times with an
arrow; what stands above it is a number or nothing, what stands below it is shown.  A time is hours,
minutes, seconds and up to three decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.sem import half_up

ARROW = "-->"
CLOCK = r"([0-9]+):([0-5]?[0-9]):([0-5]?[0-9])(?:[.,]([0-9]{1,3}))?"
TIMES = rf"^\s*{CLOCK}\s*{ARROW}\s*{CLOCK}(?:\s.*)?$"


def stamp(seconds: Column, comma: str = ",") -> Column:
    """Seconds as hours, minutes, seconds and milliseconds, half up; before zero is zero, null stays null."""
    ms = F.greatest(F.lit(0), half_up(seconds * 1000)).cast("long")
    clock = F.array(*(F.lpad(x.cast("string"), 2, "0") for x in (F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)))))
    hours = F.floor(ms / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.when(seconds.isNotNull(), F.concat(hours, F.lit(":"), F.array_join(clock, ":"), F.lit(comma), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")))


def _clock(line: Column, first: int) -> Column:
    """The time that four groups of a line of times give."""
    unit = lambda k: F.regexp_extract(line, TIMES, first + k)
    whole = (unit(0).cast("long") * 60 + unit(1).cast("long")) * 60 + unit(2).cast("long")
    return whole + F.concat(F.lit("0."), F.coalesce(F.nullif(unit(3), F.lit("")), F.lit("0"))).cast("double")


def seconds(text: Column) -> Column:
    """A time as seconds; null if it isn't one."""
    pair = F.concat(F.trim(text), F.lit(ARROW + "0:0:0"))
    return F.when(pair.rlike(TIMES), _clock(pair, 1))


def cues(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each cue of each row's whole subtitle text: the other columns, then pos (from 0), start, end, lines.

    Line ends may be of any kind.  A paragraph without a line of times, or with one that can't be read,
    is an error that names its number.  Null and empty texts have no cues.  Columns called pos, start,
    end or lines are refused.
    """
    taken = {"pos", "start", "end", "lines"} & ({*texts.columns} - {text_col})
    if taken:
        raise ValueError(f"columns {sorted(taken)} would stand twice")
    rest = [F.col(f"`{c}`") for c in texts.columns if c != text_col]
    lines = F.split(F.regexp_replace(F.col(text_col), r"^\x{FEFF}", ""), r"\r\n|\r|\n")
    lines = F.transform(lines, lambda x: F.rtrim(x))
    # a paragraph is what lies between blank lines: lines are joined again, as no line holds a line end
    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), r"\n(?:\s*\n)+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    rows = texts.select(*rest, F.posexplode(paragraphs).alias("pos", "__p"))
    rows = rows.withColumn("__l", F.filter(F.split("__p", "\n"), lambda x: F.trim(x) != ""))
    rows = rows.withColumn("__t", F.get(F.filter(F.transform("__l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: F.contains(y["x"], F.lit(ARROW))), F.lit(0)))
    where = F.concat(F.lit("paragraph "), (F.col("pos") + 1).cast("string"))
    fault = F.when(F.col("__t").isNull(), F.concat(where, F.lit(" has no times"))).when(~F.col("__t.x").rlike(TIMES), F.concat(where, F.lit(": these times can't be read: "), F.col("__t.x")))
    time = lambda k: F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(_clock(F.col("__t.x"), k))
    shown = F.slice("__l", F.col("__t.i") + 2, F.size("__l"))
    return rows.select(*rest, "pos", time(1).alias("start"), time(5).alias("end"), shown.alias("lines"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cues of every file below ``path``: file, pos, start, end, lines."""
    return cues(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def written(table: DataFrame, by: str) -> DataFrame:
    """``by`` and the subtitle text of its cues (pos, start, end, lines) in the order of pos.

    One text is one value, so a key's cues meet in one task, as a file's lines must.  Null lines
    count as none; cues with a null pos come first."""
    times = F.concat_ws(f" {ARROW} ", stamp(F.col("start")), stamp(F.col("end")))
    body = F.concat(F.array(times), F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", body.alias("body"))))
    numbered = F.transform(ordered, lambda x, i: F.concat(F.array((i + 1).cast("string")), x["body"]))
    return table.groupBy(by).agg(F.array_join(F.flatten(numbered), "\n").alias("text"))


def moved(table: DataFrame, at: float, by: float, tolerance: float = 0.001) -> DataFrame:
    """Cues that start at ``at`` or later, but for ``tolerance``, stand ``by`` seconds later.

    A cue that began before and goes on after ``at`` is an error; null times stay null."""
    later = F.col("start") >= F.lit(at - tolerance)
    across = ~later & (F.col("end") > F.lit(at + tolerance))
    wrong = F.raise_error(F.concat(F.lit("a cue goes on over "), F.lit(str(at)), F.lit(": "), stamp(F.col("start")))).cast("double")
    by_rows = F.when(across, wrong).when(later, F.lit(float(by))).otherwise(F.lit(0.0))
    return table.withColumns({"start": F.col("start") + by_rows, "end": F.col("end") + by_rows})


def text_moved(texts: DataFrame, by: str, at: float, seconds_: float) -> DataFrame:
    """Whole subtitle texts with their cues moved: ``by``, text, and how many cues moved."""
    table = cues(texts.select(by, "text"))
    later = table.groupBy(by).agg(F.count_if(F.col("start") >= at - 0.001).alias("moved"))
    return written(moved(table, at, seconds_), by).join(later, by)
