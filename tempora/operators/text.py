"""Text measures as column expressions: normal form, error rate, findings, units, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def error_rate(target: Column, heard: Column) -> Column:
    """Edit distance over the target's length (at least 1)."""
    return F.levenshtein(target, heard) / F.greatest(F.length(target), F.lit(1))


def gross(target: Column, heard: Column) -> Column:
    """Whether the error rate is above one half, or the lengths' ratio outside 0.7 to 1.4."""
    ratio = F.length(heard) / F.nullif(F.length(target), F.lit(0))
    return (error_rate(target, heard) > 0.5) | ((F.length(target) > 0) & ((ratio < 0.7) | (ratio > 1.4)))


def tail_cleared(target: Column, heard: Column, n: int = 2) -> Column:
    """Whether the last letters of the target end what was heard; an empty target is cleared."""
    return (F.length(target) == 0) | F.endswith(heard, F.right(target, F.lit(n)))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def units(text: Column) -> Column:
    """Spoken units of ASCII text: vowel groups of words (at least one a word) and digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    vowels = F.aggregate(F.transform(words, lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))), F.lit(0), lambda s, x: s + x)
    return vowels.cast("long") + F.regexp_count(text, F.lit("[0-9]"))


def ranked_search(df: DataFrame, key: str, text: str, tokens: list[str], limit: int, every: bool = False) -> DataFrame:
    """Rows by number of matched tokens, then occurrences, then key; ``every`` needs all tokens."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = [occurrences(F.col("__lower"), F.lit(t.lower())) for t in tokens]
    matched = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0)).cast("long")
    out = df.select(key, lower.alias("__lower")).select(key, matched.alias("matched"), sum(counts, F.lit(0)).cast("long").alias("score"))
    out = out.filter(F.col("matched") == len(tokens) if every else F.col("matched") > 0)
    return out.orderBy(F.desc("matched"), F.desc("score"), key).limit(limit)


def words_in_time(df: DataFrame, keys: list[str], text: str, start: Column, end: Column) -> DataFrame:
    """Words of a line with times in proportion to their lengths.

    A running sum over the words of a line: each word is one small row, whatever the line's length."""
    rows = df.select(*keys, F.monotonically_increasing_id().alias("__line"), F.filter(F.split(text, r"[ \n]+"), lambda w: w != "").alias("__w"), start.cast("double").alias("__s"), end.cast("double").alias("__e"))
    rows = rows.select(*keys, "__line", "__s", "__e", F.posexplode("__w").alias("idx", "word"))
    line = Window.partitionBy("__line", *keys)
    upto = F.sum(F.length("word")).over(line.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__upto": upto, "__n": F.sum(F.length("word")).over(line)})
    at = lambda n: F.col("__s") + (F.col("__e") - F.col("__s")) * n / F.col("__n")
    return rows.select(*keys, F.col("idx").cast("long").alias("idx"), "word", at(F.col("__upto") - F.length("word")).alias("start"), at(F.col("__upto")).alias("end"))
