"""Scripts: whole texts, either a JSON object with lines or plain text with a line each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "struct<lines: array<struct<id: string, text: string, lang: string>>>"


def script_lines(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns, then pos (from 0), id, line, lang, for each line with a text.

    A text that begins with ``{`` is JSON; its lines keep their ids, or are called l1, l2, … by their
    place among all lines.  JSON without an array of lines is an error.  In other texts every line
    that isn't blank counts, trimmed, called l1, l2, … among those.  Null texts have no lines; lang
    is null where none is given.  Columns called pos, id, line or lang are refused.
    """
    rest = [c for c in texts.columns if c != text_col]
    if taken := {"pos", "id", "line", "lang"} & {*rest}:
        raise ValueError(f"columns {sorted(taken)} would stand twice")
    text = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    parsed = F.from_json(text, _SCHEMA)["lines"]
    parsed = F.when(parsed.isNull(), F.raise_error(F.lit("a script without an array of lines")).cast("array<struct<id: string, text: string, lang: string>>")).otherwise(parsed)
    plain = F.filter(F.transform(F.split(text, r"\r?\n"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    none = F.lit(None).cast("string")
    plain = F.transform(plain, lambda t: F.struct(none.alias("id"), t.alias("text"), none.alias("lang")))
    rows = texts.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(F.when(text.startswith("{"), parsed).otherwise(plain)).alias("pos", "__line"))
    line = F.col("__line")
    named = F.coalesce(line["id"], F.concat(F.lit("l"), (F.col("pos") + 1).cast("string")))
    return rows.filter(line["text"].rlike(r"\S")).select(*[F.col(f"`{c}`") for c in rest], "pos", named.alias("id"), line["text"].alias("line"), line["lang"].alias("lang"))
