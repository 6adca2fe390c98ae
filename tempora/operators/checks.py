"""Rules for plans, cues, spans and stages: each row's problems as an array, in a fixed order.

A problem is a short text; tables without problems give empty arrays.  ``by`` is the key of a film.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import schema as sc

from .speech import _mapped, caption_words, first_word_containing


def problems(*rules: tuple[Column, str | Column]) -> Column:
    """The texts of the rules that hold."""
    return F.array_compact(F.array(*(F.when(rule, text if isinstance(text, Column) else F.lit(text)) for rule, text in rules)))


def explode_problems(rows: DataFrame, columns: list[str], found: Column) -> DataFrame:
    return rows.select(*columns, F.explode(found).alias("problem"))


def against_schema(rows: DataFrame, text: str, schema: dict, name: str = "problems") -> DataFrame:
    """JSON texts with everything that their schema finds."""
    return _mapped(rows, [text], lambda x: sc.problems(x, schema), name, "array<string>")


def repeated(ident: str, by: list[str]) -> Column:
    """Whether a row's id was given before it in its key."""
    return F.row_number().over(Window.partitionBy(*by, ident).orderBy("pos")) > 1


def card_problems(cards: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """Cards (pos, id, at, event, kind) with a missing or repeated id, a time before zero, an unknown kind."""
    found = problems(
        (F.coalesce(F.trim("id"), F.lit("")).eqNullSafe(""), "no id"), (repeated("id", by), "id given before"), (F.coalesce(F.col("at") < 0, F.lit(True)), "no time from zero on"),
        (F.coalesce(F.trim("event"), F.lit("")).eqNullSafe(""), "no event"), (~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "unknown kind"),
    )
    return cards.withColumn("problems", found)


def clock_problems(items: DataFrame, by: list[str]) -> DataFrame:
    """Items (pos, id, start, end) out of order, overlapping, empty or of a repeated id."""
    w = Window.partitionBy(*by).orderBy("pos")
    found = problems(
        (F.coalesce(F.col("end") <= F.col("start"), F.lit(True)), "empty"), (F.col("start") < F.lag("start").over(w), "out of order"),
        (F.col("start") < F.lag("end").over(w) - 1e-9, "overlaps the one before"), (repeated("id", by), "id given before"),
    )
    return items.withColumn("problems", found)


def clock_facts(items: DataFrame, by: list[str], fps: Column | float) -> DataFrame:
    """Gaps before items, and whether their edges are off the frames."""
    w = Window.partitionBy(*by).orderBy("start", "pos")
    off = lambda c: F.abs(F.col(c) * fps - F.floor(F.col(c) * fps + 0.5)) > 1e-3
    gap = F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0.0))
    return items.select(*by, "pos", "id", F.when(gap > 1e-9, gap).otherwise(0.0).alias("gap"), (off("start") | off("end")).alias("off_grid"))


def clock_items(timelines: DataFrame, by: list[str], keys: tuple[str, ...] = ("steps", "stages", "scenes", "lines", "shots")) -> DataFrame:
    """The items of the first array of a timeline that isn't null: kind, pos, id, start, end."""
    have = [k for k in keys if k in timelines.columns]
    rows = timelines.withColumn("__items", F.coalesce(*(F.col(k) for k in have))).withColumn("kind", F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in have)))
    return rows.select(*by, "kind", F.posexplode("__items").alias("pos", "x")).select(*by, "kind", "pos", "x.*")


def footage_problems(spans: DataFrame, by: list[str]) -> DataFrame:
    """The first problem of each footage span: id, src, in, out, speed, freeze."""
    found = problems(
        (F.coalesce(F.trim("id"), F.lit("")).eqNullSafe(""), "no id"), (repeated("id", by), "id given before"), (F.coalesce(F.trim("src"), F.lit("")).eqNullSafe(""), "no source"),
        (F.coalesce(F.col("in") < 0, F.lit(True)), "starts before the source"), (F.coalesce(F.col("out") <= F.col("in"), F.lit(False)), "empty"),
        (F.coalesce(F.col("speed") <= 0, F.lit(False)), "no speed"), (F.coalesce(F.col("freeze"), F.lit(False)) & F.coalesce(F.col("speed") != 1, F.lit(False)), "a frozen span has no speed"),
    )
    return spans.withColumn("problem", F.get(found, F.lit(0)))


def source_frame(frame: Column, speed: Column, frozen: Column) -> Column:
    """The source's frame for a film's frame."""
    return F.when(F.coalesce(frozen, F.lit(False)), F.lit(0)).otherwise(F.floor(frame * F.coalesce(speed, F.lit(1.0)) + 1e-9)).cast("long")


def span_frame(at: Column, start: Column, fps: Column | float) -> Column:
    """A film's time as a frame of a span."""
    return F.floor((at - start) * fps + 1e-9).cast("long")


def field_audio(spans: DataFrame, fps: float) -> DataFrame:
    """Which spans' own sound is heard: not of frozen, sped or silenced ones."""
    heard = F.coalesce(F.col("audio"), F.lit(True)) & ~F.coalesce(F.col("freeze"), F.lit(False)) & (F.coalesce(F.col("speed"), F.lit(1.0)) == 1.0)
    return spans.filter(heard).select("id", "src", "in", F.coalesce("out", F.col("in") + F.col("dur")).alias("out"), F.floor(F.col("at") * fps + 0.5).cast("long").alias("frame"))


# plan lines: pos, id, text, say, pause_after_ms, lead, cues array<struct<asset, at, offset_ms, play>>


def cue_word_errors(lines: DataFrame, by: list[str]) -> DataFrame:
    """Cues at ``word:<w>`` whose word is in no word of their line."""
    rows = lines.select(*by, "pos", "id", caption_words(F.col("text")).alias("__w"), F.explode("cues").alias("cue")).filter(F.col("cue.at").startswith("word:"))
    word = F.substr(F.col("cue.at"), F.lit(6))
    return rows.filter(~F.exists("__w", lambda t: F.contains(t, word))).select(*by, "id", "cue.asset", word.alias("word"))


def break_errors(lines: DataFrame, by: list[str]) -> DataFrame:
    """Break marks that lead, trail or repeat in a caption."""
    t = F.trim(F.col("text"))
    found = problems((t.startswith("|"), "leads"), (t.endswith("|"), "trails"), (t.rlike(r"\|\s*\|"), "repeats"))
    return explode_problems(lines, [*by, "id"], found)


def breath_facts(lines: DataFrame, by: list[str], least_ms: int = 500) -> DataFrame:
    """Lines but the last of a film with a planned pause under the least breath."""
    last = F.lead("id").over(Window.partitionBy(*by).orderBy("pos")).isNull()
    return lines.withColumn("__last", last).filter(~F.col("__last") & (F.col("pause_after_ms") < least_ms)).select(*by, "id", "pause_after_ms")


def lead_errors(lines: DataFrame, films: DataFrame, by: list[str], head: float = 0.4) -> DataFrame:
    """Lead lines without a lead, not first, or all there are, and leads without any sound.

    films: lead (seconds), bed, page (whether a music bed or the page gives sound)."""
    w = Window.partitionBy(*by)
    order = w.orderBy("pos")
    marked = F.coalesce("lead", F.lit(False))
    rows = lines.withColumn("lead", marked).withColumn("__n", F.row_number().over(order) - 1).withColumn("__k", F.sum(marked.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__story", F.row_number().over(Window.partitionBy(*by, "lead").orderBy("pos")) == 1)
    lead = F.coalesce(F.col("film_lead"), F.lit(0.0))
    rows = rows.join(films.select(*by, F.col("lead").alias("film_lead"), F.coalesce("bed", F.lit(False)).alias("bed"), F.coalesce("page", F.lit(False)).alias("page")), by)
    own = explode_problems(rows, [*by, "id"], problems((F.col("lead") & (lead <= 0) & F.col("__story"), "a lead line needs a lead"), (F.col("lead") & (lead > 0) & (F.col("__n") != F.coalesce("__k", F.lit(0))), "lead lines come first")))
    start = lambda c: F.when(F.col("lead"), F.lit(head)).otherwise(F.lit(head) + lead) + F.coalesce(c["offset_ms"], F.lit(0)) / 1000
    inside = lambda c: ~c["play"].eqNullSafe("picture") & ((c["at"] == "start") & (start(c) >= 0) & (start(c) < F.lit(head) + lead) | F.col("lead") & ~c["at"].eqNullSafe("start"))
    sounds = (F.col("lead") | F.col("__story")) & F.exists(F.coalesce("cues", F.array().cast(dict(lines.dtypes)["cues"])), lambda c: F.coalesce(inside(c), F.lit(False)))
    film = rows.withColumn("__s", sounds).groupBy(*by).agg(F.max(lead).alias("film_lead"), F.bool_or("bed").alias("bed"), F.bool_or("page").alias("page"), F.bool_or("__s").alias("s"), F.bool_or("lead").alias("any"), F.bool_and("lead").alias("all"))
    whole = problems(((F.col("film_lead") > 0) & F.col("all"), "every line is a lead line"), ((F.col("film_lead") > 0) & ~(F.col("bed") | F.col("page") | F.col("s") | F.col("any")), "the lead has no sound"))
    return own.unionByName(explode_problems(film.withColumn("id", F.lit(None).cast(dict(lines.dtypes)["id"])), [*by, "id"], whole))


def pause_facts(timings: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Planned pauses over a second and a quarter of their slot."""
    rows = timings.withColumn("__next", F.lead("start").over(Window.partitionBy(*by).orderBy("pos"))).join(plan.select(*by, "id", "pause_after_ms"), [*by, "id"])
    slot, pause = F.col("__next") - F.col("start"), F.col("pause_after_ms") / 1000
    return rows.filter(pause > F.greatest(F.lit(1.0), 0.25 * slot)).select(*by, "id", pause.alias("pause"), slot.alias("slot"))


def missing_keys(keys: DataFrame, strings: DataFrame) -> DataFrame:
    """Keys that a language has no text for: lang and its missing keys, sorted.

    ``keys`` meets the languages only, of which there are few."""
    langs = strings.select("lang").distinct()
    wanted = keys.select("key").distinct().crossJoin(F.broadcast(langs))
    have = strings.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("lang", "key")
    return wanted.join(have, ["lang", "key"], "left_anti").groupBy("lang").agg(F.array_sort(F.collect_list("key")).alias("missing"))


def stale_dubs(dub: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Lines whose dubbed text doesn't belong to the base any more: missing on a side, or, where both are
    of one language (``same``, null if that can't be told), with another text."""
    d = dub.select(*by, "id", F.col("text").alias("dub_text"), F.col("base_text").alias("recorded"), "same")
    b = base.select(*by, "id", F.col("text").alias("base_now"))
    state = F.when(F.col("base_now").isNull(), "not in base").when(F.col("dub_text").isNull(), "not dubbed").when(~F.col("recorded").eqNullSafe(F.col("base_now")), "base changed").when(F.coalesce("same", F.lit(False)) & (F.col("dub_text") != F.col("base_now")), "texts differ")
    return d.join(b, [*by, "id"], "full_outer").withColumn("state", state).filter("state is not null").select(*by, "id", "state")


# cues in time


def flat_cues(lines: DataFrame, by: list[str]) -> DataFrame:
    """Cues of all lines, in the order of the plan, with their line and a key."""
    rows = lines.select(*by, "pos", F.col("id").alias("line"), F.posexplode("cues").alias("n", "cue")).select(*by, "pos", "line", "n", "cue.*")
    key = F.concat_ws("\x00", "line", "asset", "at", F.coalesce(F.col("offset_ms"), F.lit(0)).cast("string"))
    return rows.withColumn("key", key)


def cue_fades(cues: DataFrame, by: list[str], reach: float = 1.5) -> DataFrame:
    """How long a track's cue (at, length) crosses into the next one: as far as both overlap, ``reach`` at most."""
    w = Window.partitionBy(*by, "track").orderBy("at")
    over = F.col("at") + F.col("length") - F.lead("at").over(w)
    return cues.withColumn("fade_out", F.when(over > 0, F.least(over, F.lit(reach))).otherwise(0.0)).withColumn("fade_in", F.coalesce(F.lag("fade_out").over(w), F.lit(0.0)))


def word_cues(cues: DataFrame, timings: DataFrame, onsets: DataFrame, by: list[str]) -> DataFrame:
    """Warnings on cues at words: no line, no such word, not heard, word times not measured, sound elsewhere.

    timings: id, text, heard, words, measured; onsets: line, index, status."""
    c = cues.filter(F.col("at").startswith("word:")).select(*by, "line", "asset", F.substr(F.col("at"), F.lit(6)).alias("word"))
    rows = c.join(timings.select(*by, F.col("id").alias("line"), "text", "heard", F.size("words").alias("n"), "measured", F.lit(True).alias("there")), [*by, "line"], "left")
    rows = rows.withColumn("index", first_word_containing(F.col("text"), F.col("word")))
    rows = rows.join(onsets.select(*by, "line", "index", "status"), [*by, "line", "index"], "left")
    plain = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    found = F.when(F.col("there").isNull(), F.array(F.lit("no line"))).when(F.col("index") < 0, F.array(F.lit("no such word"))).otherwise(problems(
        (~F.contains(plain(F.col("heard")), plain(F.col("word"))), "not heard"), (F.col("measured") < F.col("n"), "not all words measured"), (F.col("status") == "off", "sound elsewhere"), (F.col("status") == "no onset", "no clear onset"),
    ))
    return rows.select(*by, "line", "asset", "word", F.explode(found).alias("warning"))


def page_marks(marks: DataFrame, lines: DataFrame, words: DataFrame, by: list[str], far: float = 0.08) -> DataFrame:
    """Marks (at) with the line that holds them (ends included, the first of several) and its nearest word.

    The line is the last that starts by the mark, as lines of a key are apart; words meet the line's marks."""
    from .joins import in_tile, nearest

    closed = lines.select(*by, "id", "start", (F.col("end") + 1e-9).alias("end"))
    held = in_tile(marks, closed, by, "at", "start", "end", "id")
    ends = lines.select(*by, F.col("id").alias("line"), F.col("end").alias("line_end"))
    held = held.withColumnRenamed("tile", "line").join(ends, [*by, "line"], "left")
    held = held.withColumn("line", F.when(F.col("at") <= F.col("line_end"), F.col("line"))).drop("line_end")
    some = held.filter("line is not null")
    near = nearest(some, words.select(*by, "line", F.col("start").alias("at"), "index"), [*by, "line"], "at", "index")
    out = near.withColumnRenamed("match", "index").unionByName(held.filter("line is null"), allowMissingColumns=True)
    return out.withColumn("off", F.coalesce(F.col("distance") > far, F.lit(True)))


# stages of a plan: name, kind, needs, owns, done, prompt, cmd


def stage_problems(stages: DataFrame) -> DataFrame:
    """Problems of stages, one row each: names, kinds, paths, needs that aren't there."""
    known = stages.select(F.col("name").alias("need")).distinct()
    absent = stages.select("name", F.explode("needs").alias("need")).join(known, "need", "left_anti").select("name", F.concat(F.lit("needs unknown "), "need").alias("problem"))
    path = lambda c: F.coalesce(F.col(c).startswith("/"), F.lit(False))
    rows = stages.withColumn("__n", F.count("*").over(Window.partitionBy("name")))
    found = problems(
        (~F.coalesce(F.col("name").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "bad name"), (F.col("__n") > 1, "name used twice"), (~path("done"), "done is no absolute path"),
        ((F.col("kind") == "session") & ~path("prompt"), "a session needs a prompt"), ((F.col("kind") == "job") & (F.coalesce(F.size("cmd"), F.lit(0)) < 1), "a job needs a command"),
        (~F.coalesce(F.col("kind").isin("session", "job"), F.lit(False)), "unknown kind"), (F.exists(F.coalesce("owns", F.array().cast("array<string>")), lambda p: ~p.startswith("/")), "owns no absolute path"),
    )
    return explode_problems(rows, ["name"], found).union(absent)


def with_defaults(stages: DataFrame) -> DataFrame:
    values = {"priority": F.lit(0), "heavy": F.col("kind") == "job", "max_resumes": F.lit(3), "max_attempts": F.lit(2), "needs": F.array().cast("array<string>"), "owns": F.array().cast("array<string>")}
    return stages.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items() if c in stages.columns})


def edit_entries(entries: DataFrame) -> DataFrame:
    """Entries of an edit list (src, segment, from, to, new) with defaults and what is wrong with them."""
    src, seg = (F.coalesce(F.col(c) != "", F.lit(False)) for c in ("src", "segment"))
    found = problems((src == seg, "one of src and segment"), (F.coalesce(F.col("from"), F.lit(0)) < 0, "starts before the clip"), (F.col("to") <= F.coalesce("from", F.lit(0)), "empty"))
    fresh = F.coalesce(F.col("new"), src & F.col("src").rlike(r"(^|[\\/])drafts[\\/]"))
    return entries.withColumn("problems", found).withColumn("from", F.coalesce("from", F.lit(0))).withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def span_frames(spans: DataFrame, by: list[str], fps: float, film_start: int, film_end: int, margin: float = 0.0) -> DataFrame:
    """Spans of seconds as frames with a margin, inside the film, merged on touch; an error for one outside."""
    from .intervals import merge

    a = F.floor(F.col("from") * fps + 1e-9).cast("long")
    b = F.ceil(F.col("to") * fps - 1e-9).cast("long")
    pad = int(margin * fps + 0.5)
    bad = (b <= a) | (b <= film_start) | (a >= film_end)
    fault = lambda x: F.when(bad, F.raise_error(F.concat(F.lit("no part of the film: "), F.col("from").cast("string"))).cast("long")).otherwise(x)
    rows = spans.select(*by, F.greatest(F.lit(film_start), fault(a - pad)).alias("s"), F.least(F.lit(film_end), fault(b + pad)).alias("e"))
    return merge(rows, by, "s", "e").drop("n_spans")


def html_findings(pages: DataFrame, key: str, html: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Rules (name, pattern, most) that a page's source breaks, with the number of matches; the source must have one canvas."""
    counts = [F.struct(F.lit(n).alias("rule"), F.regexp_count(F.col(html), F.lit(p)).alias("n"), F.lit(m).alias("most")) for n, p, m in rules]
    canvas = F.regexp_count(F.col(html), F.lit(r"(?i)<canvas[\s>]"))
    rows = pages.select(key, F.length(html).alias("chars"), canvas.alias("canvases"), F.explode(F.array(*counts)).alias("r"))
    return rows.filter((F.col("r.n") > F.col("r.most"))).select(key, "chars", F.col("r.rule").alias("rule"), F.col("r.n").alias("n"), "canvases")


def literal_keys(sources: DataFrame, key: str, code: str, call: str = "label") -> DataFrame:
    """Keys given as text to a call, and how many calls are given something else."""
    keys = F.regexp_extract_all(F.col(code), F.lit(rf"\b{call}\(\s*['\"]([^'\"]*)['\"]"), 1)
    every = F.regexp_count(F.col(code), F.lit(rf"\b{call}\("))
    return sources.select(key, F.array_distinct(keys).alias("keys"), (every - F.size(keys)).alias("others"))
