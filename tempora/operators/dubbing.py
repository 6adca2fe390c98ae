"""Fitting lines into slots, and stretching the clock between them.

Times are seconds (double) on a clip's or a film's clock.  Tables hold many films: ``by`` names the
key of one, ``pos`` its order.  A film's lines are ordered within its key only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, merge

EPS = 1e-9
HEAD, TAIL = 0.4, 0.4  # fixed silences before the first and behind the last line
PLANNED_SLACK = 0.05
STRADDLE = 0.001


def _order(by: list[str], pos: str = "pos"):
    return Window.partitionBy(*by).orderBy(pos)


# layouts


def next_start(by: list[str], start: str = "start", pos: str = "pos") -> Column:
    return F.lead(start).over(_order(by, pos))


def concat_segments(lines: DataFrame, by: list[str], gap: float, tail: float = TAIL) -> DataFrame:
    """Lines (pos, id, duration) with the silences between them, one row each in order of ``seq``."""
    last = F.lead("pos").over(_order(by)).isNull()
    first = F.row_number().over(_order(by)) == 1
    piece = lambda kind, ident, sec: F.struct(F.lit(kind).alias("kind"), ident.alias("id"), sec.cast("double").alias("duration"))
    none = F.lit(None).cast("string")
    row = F.array_compact(F.array(
        F.when(first, piece("silence", none, F.lit(HEAD))), piece("line", F.col("id"), F.col("duration")),
        piece("silence", none, F.when(last, F.lit(tail)).otherwise(F.lit(gap))),
    ))
    out = lines.select(*by, "pos", row.alias("__row")).select(*by, "pos", F.posexplode("__row").alias("__k", "piece"))
    seq = F.row_number().over(Window.partitionBy(*by).orderBy("pos", "__k")) - 1
    return out.select(*by, seq.alias("seq"), "piece.*")


def previous_slots(lines: DataFrame, plan: DataFrame, by: list[str], gap: float, min_breath: float) -> DataFrame:
    """Slot lengths that lines had: to the next start; the last one's own length and its pause."""
    pause = F.coalesce(F.col("pause_after"), F.lit(gap))
    own = F.col("end") - F.col("start") + F.greatest(pause, F.lit(min_breath))
    out = lines.withColumn("__next", next_start(by)).join(plan.select(*by, "id", "pause_after"), [*by, "id"], "left")
    return out.select(*by, "pos", "id", F.coalesce(F.col("__next") - F.col("start"), own).alias("slot"))


def with_handover(plan: DataFrame, timings: DataFrame, by: list[str]) -> DataFrame:
    """The planned pause (ms) behind the last lead line is at least the measured one."""
    w = _order(by)
    at = plan.join(timings.select(*by, "id", "start", "end"), [*by, "id"], "left")
    hands_over = F.coalesce("lead", F.lit(False)) & F.lead("id").over(w).isNotNull() & ~F.coalesce(F.lead("lead").over(w), F.lit(False))
    measured = F.floor((F.lead("start").over(w) - F.col("end")) * 1000 + 0.5)
    return at.withColumn("pause_after_ms", F.when(hands_over & measured.isNotNull(), F.greatest(F.coalesce("pause_after_ms", F.lit(0)), measured)).otherwise(F.col("pause_after_ms"))).select(*plan.columns)


# fitting


def fit(clip: Column, slot: Column, max_speed: float = 1.1, min_breath: float = 0.0, max_breath: Column | float = float("inf"), min_speed: float = 1.0) -> Column:
    """How a clip goes into a slot: ok, factor, length, breath, breath_short, long_gap, required.

    It is slowed down to ``min_speed`` at most if more than ``max_breath`` would be left, sped up by
    ``max_speed`` at most to leave ``min_breath``, and refused (``required`` is the speed that the
    slot alone would need) if it doesn't fit then."""
    most = max_breath if isinstance(max_breath, Column) else F.lit(max_breath)
    room = slot - F.lit(min_breath)
    eager = F.when(room > 0, clip / room).otherwise(F.lit(float("inf")))
    slowed = F.when(slot - clip > most, F.greatest(F.lit(min_speed), clip / (slot - most))).otherwise(F.lit(1.0))
    refused = (clip > room) & (eager > max_speed + EPS) & (clip / slot > max_speed + EPS)
    factor = F.when(clip <= room, slowed).when(eager <= max_speed + EPS, F.least(eager, F.lit(max_speed))).otherwise(F.lit(max_speed))
    factor = F.when(~refused, factor.cast("double"))
    breath = slot - clip / factor
    return F.struct(
        (~refused).alias("ok"), factor.alias("factor"), (clip / factor).alias("length"), breath.alias("breath"),
        (breath < min_breath - EPS).alias("breath_short"), (breath > most + EPS).alias("long_gap"), F.when(refused, clip / slot).alias("required"),
    )


def allowed_gap(planned: Column) -> Column:
    """A planned pause and its slack; 0 without one."""
    return F.when(planned > 0, planned + F.lit(PLANNED_SLACK)).otherwise(F.lit(0.0))


def planned_gaps(plan: DataFrame, by: list[str]) -> DataFrame:
    """Positive planned pauses in seconds."""
    return plan.filter("pause_after_ms > 0").select(*by, "id", (F.col("pause_after_ms") / 1000).alias("planned"))


def place_words(words: Column, line_start: Column, factor: Column, slot_start: Column) -> Column:
    at = lambda x: slot_start + (x - line_start) / factor
    return F.transform(words, lambda w: F.struct(w["w"].alias("w"), at(w["start"]).alias("start"), at(w["end"]).alias("end")))


def fit_lines(slots: DataFrame, dub: DataFrame, clips: DataFrame, by: list[str], max_speed: float = 1.1, min_breath: float = 0.5, max_breath: float = 1.0, min_speed: float = 0.95) -> DataFrame:
    """All lines of a film fitted to its slots (pos, id, start, end, planned), or none of them.

    dub: id, start, text, lead_trim, words; clips: id, duration.  ``state`` is ``placed``, ``failed``
    with a ``reason``, or ``held`` for lines that fit in a film that has a failure."""
    last = F.lead("pos").over(_order(by)).isNull()
    rows = slots.withColumn("__last", last)
    rows = rows.join(dub.select(*by, "id", F.col("start").alias("dub_start"), "text", "lead_trim", "words"), [*by, "id"], "left")
    rows = rows.join(clips.select(*by, "id", F.col("duration").alias("clip")), [*by, "id"], "left")
    most = F.when(F.col("__last"), F.lit(float("inf"))).otherwise(F.greatest(F.lit(max_breath), allowed_gap(F.coalesce("planned", F.lit(0.0)))))
    rows = rows.withColumn("fit", fit(F.col("clip"), F.col("end") - F.col("start"), max_speed, min_breath, most, min_speed))
    reason = F.when(F.col("dub_start").isNull(), "no dub line").when(F.col("clip").isNull(), "no clip duration").when(~F.col("fit.ok"), "too long")
    rows = rows.withColumn("reason", reason)
    failed = F.max(F.col("reason").isNotNull()).over(Window.partitionBy(*by))
    room = F.col("end") - F.col("start") - F.col("fit.length")
    lead = F.greatest(F.lit(0.0), F.least(F.coalesce("lead_trim", F.lit(0.0)) / F.col("fit.factor"), room))
    placed = F.when(~failed, F.col("start") + lead)
    state = F.when(F.col("reason").isNotNull(), "failed").when(failed, "held").otherwise("placed")
    return rows.select(
        *by, "pos", "id", state.alias("state"), "reason", "fit.required", placed.alias("start"), (placed + F.col("fit.length")).alias("end"),
        F.when(~failed, F.col("fit.factor")).alias("factor"), F.col("fit.breath_short").alias("breath_short"), F.col("fit.long_gap").alias("long_gap"), F.col("fit.breath").alias("breath"),
        "text", place_words(F.col("words"), F.col("dub_start"), F.col("fit.factor"), placed).alias("words"),
    )


def fit_frozen(frozen: DataFrame, dub: DataFrame, clips: DataFrame, by: list[str], max_speed: float = 1.1) -> DataFrame:
    """Lines fitted to windows that stay as they are: joined by place, checked by id and text.

    Each row has its ``problem``, if any; a film with one has no placed rows."""
    w = _order(by)
    rows = frozen.select(*by, "pos", "id", "text", "start", "end", "film_end").withColumn("__before", F.lag("end").over(w))
    rows = rows.withColumn("__same", F.count("*").over(Window.partitionBy(*by, "id")))
    d = dub.select(*by, "pos", F.col("id").alias("dub_id"), F.col("text").alias("dub_text"), F.col("start").alias("dub_start"), "words")
    rows = rows.join(d, [*by, "pos"], "full_outer").join(clips.select(*by, "id", F.col("duration").alias("clip")), [*by, "id"], "left")
    rows = rows.withColumn("fit", fit(F.col("clip"), F.col("end") - F.col("start"), max_speed))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    window = ~finite("start") | ~finite("end") | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("film_end")) | F.coalesce(F.col("start") < F.col("__before"), F.lit(False))
    problem = (
        F.when(F.col("id").isNull() | F.col("dub_id").isNull(), "line count differs").when(~F.col("id").rlike(r"^[\w-]+$") | (F.col("__same") > 1), "bad or repeated id")
        .when((F.col("id") != F.col("dub_id")) | ~F.col("text").eqNullSafe(F.col("dub_text")), "caption differs").when(F.coalesce(window, F.lit(True)) | ~finite("dub_start"), "bad window")
        .when(~finite("clip") | (F.col("clip") <= 0), "no clip duration").when(~F.col("fit.ok"), "too long")
    )
    rows = rows.withColumn("problem", problem)
    ok = ~F.max(F.col("problem").isNotNull()).over(Window.partitionBy(*by))
    return rows.select(
        *by, "pos", F.coalesce("id", "dub_id").alias("id"), "problem", "fit.required", F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("start") + F.col("fit.length")).alias("end"),
        F.when(ok, F.col("fit.factor")).alias("factor"), F.when(ok, place_words(F.col("words"), F.col("dub_start"), F.col("fit.factor"), F.col("start"))).alias("words"),
    )


def gap_range(slot: Column, planned: Column | float = 0.0) -> Column:
    planned = planned if isinstance(planned, Column) else F.lit(planned)
    return F.struct(F.lit(0.4).alias("min"), F.greatest(F.lit(0.25) * slot, F.lit(1.0), planned).alias("max"))


def line_fill(fitted: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """How full each line (id, start, end, factor) makes its slot (pos, id, start, end, planned), and whether the gap behind it is right."""
    s = slots.withColumn("last", F.lead("pos").over(_order(by)).isNull())
    s = s.select(*by, "id", F.col("start").alias("s"), F.col("end").alias("e"), "last", F.coalesce("planned", F.lit(0.0)).alias("planned"))
    rows = fitted.join(s, [*by, "id"], "left").withColumn("slot", F.col("e") - F.col("s"))
    fill = F.when(F.col("slot") > 0, (F.col("end") - F.col("start")) / F.col("slot"))
    gap = F.when(~F.col("last"), F.col("e") - F.col("end"))
    span = gap_range(F.col("slot"), allowed_gap(F.col("planned")))
    state = F.when(gap < span["min"], "crammed").when(gap > span["max"], "sparse").when(gap.isNotNull(), "ok")
    factor = F.coalesce("factor", F.lit(1.0))
    squeezed = F.coalesce(fill > 1.0, F.lit(False)) | (factor != 1.0)
    return rows.select(*by, "id", fill.alias("fill"), gap.alias("gap_after"), F.when(gap.isNotNull(), span["max"]).alias("gap_max"), state.alias("gap_state"), F.coalesce("last", F.lit(False)).alias("last"), squeezed.alias("squeezed"), (squeezed | F.coalesce(state != "ok", F.lit(False))).alias("warn"))


# the edges of a clip, from its windows array<struct<start, end, db>>


def trim_edges(windows: Column, duration: Column, above: float = -45.0, head: float = 0.04, tail: float = 0.04) -> Column:
    """Lead and tail that hold no sound, with pads left: from, to, lead, trail."""
    loud = F.filter(windows, lambda w: w["db"] > above)
    some = F.size(loud) > 0
    begin = F.when(some, F.greatest(F.lit(0.0), F.get(loud, F.lit(0))["start"] - head)).otherwise(F.lit(0.0))
    end = F.when(some, F.least(duration, F.get(loud, F.size(loud) - 1)["end"] + tail)).otherwise(duration)
    return F.struct(begin.alias("from"), end.alias("to"), begin.alias("lead"), F.when(some, F.greatest(F.lit(0.0), duration - end)).otherwise(F.lit(0.0)).alias("trail"))


def decay_end(windows: Column, gate: float = -40.0) -> Column:
    """Where the last sound has died away: three windows in a row at most at the clip's floor."""
    db = F.transform(windows, lambda w: F.when(w["db"].isNull() | F.isnan(w["db"]) | (F.abs(w["db"]) == float("inf")), F.lit(-200.0)).otherwise(w["db"]))
    ranked, n = F.array_sort(db), F.size(windows)
    rank = lambda p: F.get(ranked, F.floor(F.lit(p) * (n - 1)).cast("int"))
    floor = F.greatest(rank(0.9) - 45.0, rank(0.1) + 6.0)
    last = F.array_max(F.filter(F.transform(windows, lambda w, i: F.when(w["db"] > gate, i)), lambda i: i.isNotNull()))
    quiet = lambda i: ~F.exists(F.slice(db, i + 1, 3), lambda x: x > floor)
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > last) & quiet(i))
    return F.when(last.isNotNull(), F.when(F.size(ends) > 0, F.get(windows, F.get(ends, F.lit(0)))["start"]).otherwise(F.get(windows, n - 1)["end"]))


def voiced_span(windows: Column, duration: Column, gate: float = -40.0, head: float = 0.05, tail: float = 0.3, fade: float = 0.05, margin: float = 0.05) -> Column:
    span = trim_edges(windows, duration, gate, head, tail)
    end = F.least(duration, F.greatest(span["to"], F.coalesce(decay_end(windows, gate) + margin + fade, span["to"])))
    return F.struct(span["from"].alias("from"), end.alias("to"), span["lead"].alias("lead"), F.greatest(F.lit(0.0), duration - end).alias("trail"))


# the picture's spans


def frame_count(duration: Column, fps: Column | int) -> Column:
    """Frames of a film, half up."""
    return F.floor(duration * fps + F.lit(0.5)).cast("long")


def caption_spans(spans: DataFrame, films: DataFrame, by: list[str], min_shared: float = 1.0) -> DataFrame:
    """Frame spans that a language draws itself and those that all languages share: from, to, kind.

    spans: start, end (lines, the last one held to the film's end, and labels); films: duration, fps."""
    f = films.select(*by, "fps", frame_count(F.col("duration"), F.col("fps")).alias("total"), F.floor(F.lit(min_shared) * F.col("fps") + 0.5).alias("least"))
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.col("total"), x.cast("long")))
    rows = spans.join(f, by).select(*by, "total", "least", clamp(F.floor(F.col("start") * F.col("fps"))).alias("s"), clamp(F.ceil(F.col("end") * F.col("fps"))).alias("e")).filter("e > s")
    own = merge(rows, [*by, "total", "least"], "s", "e", F.col("least"), strict=True).drop("n_spans")
    w = Window.partitionBy(*by).orderBy("s")
    own = own.withColumn("__n", F.row_number().over(w)).withColumn("__last", F.lead("s").over(w).isNull())
    own = own.withColumn("s", F.when((F.col("__n") == 1) & (F.col("s") < F.col("least")), 0).otherwise(F.col("s")))
    own = own.withColumn("e", F.when(F.col("__last") & (F.col("total") - F.col("e") < F.col("least")), F.col("total")).otherwise(F.col("e"))).select(*by, "s", "e")
    cuts = own.select(*by, "s", "e", F.lit("lang").alias("kind"))
    ends = f.select(*by, F.col("total").alias("s"), F.col("total").alias("e"), F.lit("end").alias("kind"))
    every = cuts.union(ends).withColumn("__before", F.coalesce(F.lag("e").over(Window.partitionBy(*by).orderBy("s", "e")), F.lit(0)))
    piece = lambda a, b, kind: F.struct(a.alias("from"), b.alias("to"), kind.alias("kind"))
    both = F.array(piece(F.col("__before"), F.col("s"), F.lit("shared")), piece(F.col("s"), F.col("e"), F.col("kind")))
    out = every.select(*by, F.explode(both).alias("p")).select(*by, "p.*")
    return out.filter(F.col("to") > F.col("from"))


def promote(spans: DataFrame, by: list[str], at: Column) -> DataFrame:
    """Give the spans for which ``at`` holds to the language, and join equal neighbours."""
    flipped = spans.withColumn("kind", F.when(at, "lang").otherwise(F.col("kind")))
    w = Window.partitionBy(*by).orderBy("from")
    found = islands(flipped, by, ["from"], F.col("kind") != F.lag("kind").over(w))
    return found.groupBy(*by, "island", "kind").agg(F.min("from").alias("from"), F.max("to").alias("to")).select(*by, "from", "to", "kind")


def span_totals(spans: DataFrame, by: list[str]) -> DataFrame:
    n = F.col("to") - F.col("from")
    return spans.groupBy(*by).agg(*(F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(f"{k}_frames") for k in ("lang", "shared")))


def language_ranges(spans: DataFrame) -> DataFrame:
    return spans.filter("kind = 'lang'").drop("kind")


# moving what comes later


def side(start: Column, end: Column, at: Column) -> Column:
    """Whether a span moves, stays or straddles an insertion point."""
    return F.when(start >= at - STRADDLE, "move").when(end > at + STRADDLE, "straddle").otherwise("stay")


def shift_placed(lines: DataFrame, at: float, seconds: float) -> DataFrame:
    """Lines (start, end, words) at and behind a point moved; an error if a line straddles it."""
    where = side(F.col("start"), F.col("end"), F.lit(at))
    by = F.when(where == "straddle", F.raise_error(F.concat(F.lit("line over the insertion point: "), F.col("id").cast("string"))).cast("double")).when(where == "move", seconds).otherwise(0.0)
    out = lines.withColumn("__by", by)
    moved = F.transform("words", lambda w: F.struct(w["w"].alias("w"), (w["start"] + F.col("__by")).alias("start"), (w["end"] + F.col("__by")).alias("end")))
    return out.withColumns({"start": F.col("start") + F.col("__by"), "end": F.col("end") + F.col("__by"), "words": moved}).drop("__by")


def shift_for_pause(lines: DataFrame, by: list[str], ident: str, word: int, pause: float) -> DataFrame:
    """A pause put behind a word of a line: that line's later words, its end and all later lines move."""
    here = F.max(F.when(F.col("id") == ident, F.col("pos"))).over(Window.partitionBy(*by))
    after, own = F.col("pos") > here, F.col("pos") == here
    step = F.when(after, pause).otherwise(0.0)
    moved = F.transform("words", lambda w, i: F.struct(w["w"].alias("w"), (w["start"] + F.when(after | (own & (i > word)), pause).otherwise(0.0)).alias("start"), (w["end"] + F.when(after | (own & (i > word)), pause).otherwise(0.0)).alias("end")))
    return lines.withColumns({"start": F.col("start") + step, "end": F.col("end") + F.when(after | own, pause).otherwise(0.0), "words": moved})


# stretching the clock


def gap_deltas(base: DataFrame, placed: DataFrame, by: list[str], least: float) -> DataFrame:
    """How much each slot must be widened so that ``least`` is left behind its placed line."""
    nxt = base.withColumn("__next", next_start(by))
    rows = nxt.join(placed.select(*by, "id", F.col("end").alias("placed_end")), [*by, "id"], "left")
    gap = F.col("__next") - F.col("placed_end")
    return rows.select(*by, "pos", "id", "start", gap.alias("gap"), F.coalesce(F.greatest(F.lit(0.0), F.lit(least) - gap), F.lit(0.0)).alias("delta"))


def time_map(deltas: DataFrame, films: DataFrame, by: list[str]) -> DataFrame:
    """A film's clock in pieces: old_from, old_to, new_from, new_to and the factor of each.

    Each line's slot (to the next start, the last to the film's end) is longer by its delta; what is
    before the first line stays."""
    w = _order(by)
    rows = deltas.join(films.select(*by, "duration"), by)
    rows = rows.withColumn("old_to", F.coalesce(F.lead("start").over(w), F.col("duration")))
    rows = rows.withColumn("__len", F.col("old_to") - F.col("start") + F.col("delta")).withColumn("__first", F.first("start").over(w))
    new_to = F.col("__first") + F.sum("__len").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*by, F.col("start").alias("old_from"), "old_to", (new_to - F.col("__len")).alias("new_from"), new_to.alias("new_to"), F.row_number().over(w).alias("__n"))
    head = rows.filter((F.col("__n") == 1) & (F.col("old_from") > EPS)).select(*by, F.lit(0.0).alias("old_from"), F.col("old_from").alias("old_to"), F.lit(0.0).alias("new_from"), F.col("old_from").alias("new_to"))
    out = rows.drop("__n").unionByName(head)
    return out.withColumn("factor", F.when(F.col("old_to") - F.col("old_from") > EPS, (F.col("new_to") - F.col("new_from")) / (F.col("old_to") - F.col("old_from"))))


def segment_factors(pieces: DataFrame) -> DataFrame:
    return pieces.filter("factor is not null")


def remap(points: DataFrame, pieces: DataFrame, by: list[str], at: str, name: str = "mapped") -> DataFrame:
    """Times on the new clock: an as-of join of points with the pieces, by one union and one window.

    Before the first piece time goes on at its own speed; the last piece goes on beyond its end."""
    kinds = dict(points.dtypes)
    rest = [c for c in points.columns if c not in by]
    p = points.select(*by, *rest, F.col(at).cast("double").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("struct<old:double,new:double,factor:double>").alias("__piece"))
    m = pieces.select(*by, *(F.lit(None).cast(kinds[c]).alias(c) for c in rest), F.col("old_from").alias("__at"), F.lit(0).alias("__side"), F.struct(F.col("old_from").alias("old"), F.col("new_from").alias("new"), F.coalesce("factor", F.lit(0.0)).alias("factor")).alias("__piece"))
    w = Window.partitionBy(*by).orderBy("__at", "__side")
    found = F.last("__piece", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__piece", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = p.unionByName(m).withColumn("__found", found).withColumn("__first", first).filter("__side = 1")
    mapped = F.coalesce(F.col("__found.new") + (F.col("__at") - F.col("__found.old")) * F.col("__found.factor"), F.col("__first.new") + F.col("__at") - F.col("__first.old"), F.col("__at"))
    return out.withColumn(name, mapped).select(*points.columns, name)


def remap_lines(lines: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """Lines (id, start, end, words) on the new clock: all their times are mapped as one table of points."""
    points = lines.select(*by, "id", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("k"), F.col("start").alias("t")), F.struct(F.lit(-1).alias("i"), F.lit(1).alias("k"), F.col("end").alias("t"))),
        F.flatten(F.transform(F.coalesce("words", F.array().cast(dict(lines.dtypes)["words"])), lambda w, i: F.array(F.struct(i.alias("i"), F.lit(0).alias("k"), w["start"].alias("t")), F.struct(i.alias("i"), F.lit(1).alias("k"), w["end"].alias("t"))))),
    )).alias("p")).select(*by, "id", "p.*")
    mapped = remap(points, pieces, by, "t")
    found = mapped.groupBy(*by, "id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * 2 + F.col("k"), "mapped"))).alias("__t"))
    t = F.col("__t")
    moved = F.transform("words", lambda w, i: F.struct(w["w"].alias("w"), t[i * 2].alias("start"), t[i * 2 + 1].alias("end")))
    return lines.join(found, [*by, "id"]).withColumns({"start": t[F.lit(-2)], "end": t[F.lit(-1)], "words": moved}).select(*lines.columns)


# silence between lines


def picture_gaps(lines: DataFrame, plan: DataFrame, by: list[str], gate: float = 1.0) -> DataFrame:
    """Pauses (ms) behind lines: as planned, or as long as the picture's own pause if that is over the gate."""
    own = (next_start(by) - F.col("end")) * 1000
    rows = lines.withColumn("__own", own).join(plan.select(*by, "id", "pause_after_ms"), [*by, "id"], "left")
    return rows.select(*by, "pos", "id", F.greatest(F.coalesce(F.col("pause_after_ms").cast("double"), F.lit(0.0)), F.when(F.col("__own") > gate * 1000, F.col("__own")).otherwise(F.lit(0.0))).alias("pause_after_ms"))


def classify_gaps(gaps: DataFrame, lines: DataFrame, plan: DataFrame, by: list[str], default_ms: float | None = None, slack: float = 0.4) -> DataFrame:
    """Silent gaps (from, to) with the lines around them, and whether a planned pause explains them.

    The line before is the last that starts by the gap's start, the one after the first that starts
    by its end less half the slack: two windows over one union of gaps and lines each."""

    def seek(rows: DataFrame, at: Column, forward: bool, name: str) -> DataFrame:
        left = rows.select("*", at.alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("struct<id:string,e:double>").alias("__line"))
        right = lines.select(*by, *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in by), F.col("start").alias("__at"), F.lit(0).alias("__side"), F.struct(F.col("id").cast("string").alias("id"), F.col("end").alias("e")).alias("__line"))
        order = [F.desc("__at"), "__side"] if forward else [F.asc("__at"), "__side"]
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return left.unionByName(right).withColumn(name, F.last("__line", ignorenulls=True).over(w)).filter("__side = 1").drop("__at", "__side", "__line")

    rows = seek(gaps, F.col("from") + 1e-6, False, "__prev")
    rows = seek(rows, F.col("to") - slack / 2, True, "__next")
    rows = rows.join(plan.select(*by, F.col("id").cast("string").alias("after_id"), "pause_after_ms"), [rows[c] == plan[c] for c in by] + [F.col("__prev.id") == F.col("after_id")], "left").select(rows["*"], "pause_after_ms")
    inside = F.coalesce(F.col("__prev.e") > F.col("to") + 1e-6, F.lit(False))
    planned = F.coalesce(F.col("pause_after_ms").cast("double"), F.lit(default_ms).cast("double"), F.lit(0.0)) / 1000
    fits = ~inside & (planned > 0) & (F.col("to") - F.col("from") <= planned + slack)
    return rows.select(*by, "from", "to", F.col("__prev.id").alias("after_id"), F.when(inside, F.col("__prev.id")).otherwise(F.col("__next.id")).alias("before_id"), inside.alias("inside"), planned.alias("planned"), fits.alias("is_planned"))


# levels


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def line_gain(measured: Column, target: float = -16.0, most: float = 12.0) -> Column:
    """Decibels that bring a line to its target; 0 where it can't be measured."""
    known = finite(measured)
    return F.when(known.isNotNull(), F.least(F.lit(target) - known, F.lit(most))).otherwise(F.lit(0.0))


def needs_limiter(peak: Column, gain: Column, most: float = -1.5) -> Column:
    return F.coalesce(finite(peak) + gain > most, F.lit(True))


def mix_offset(bed: Column, peak: Column, voice: Column, under: float | None = None, most: float = -1.0) -> Column:
    """How far a bed is under the voice, what to add for the wanted gap, and how far its peak is over then."""
    gap = voice - F.coalesce(finite(bed), F.raise_error(F.lit("the bed has no measurable loudness")).cast("double"))
    offset = gap - F.lit(under).cast("double")
    after = finite(peak) + F.coalesce(offset, F.lit(0.0))
    return F.struct(gap.alias("gap"), offset.alias("offset"), after.alias("peak_after"), F.when(after > most, after - most).alias("over_peak"))


def duck_gain(t: Column, start: Column, end: Column, depth_db: float = -2.5, ramp: float = 0.8) -> Column:
    """The gain that one narration window leaves to the bed at a time: down by a ramp, low, up by a ramp."""
    low = F.lit(10 ** (depth_db / 20))
    falling, rising = 1 - (1 - low) * (t - (start - ramp)) / ramp, low + (1 - low) * (t - end) / ramp
    return F.when((t < start - ramp) | (t > end + ramp), 1.0).when(t < start, falling).when(t <= end, low).otherwise(rising)


def duck_swing(films: DataFrame, page: DataFrame, dub: DataFrame, by: list[str], step: float = 0.05, page_db: float = -10.0, dub_db: float = -2.5, page_ramp: float = 0.12, dub_ramp: float = 0.8) -> DataFrame:
    """The deepest point of two ducks together, sampled every ``step`` seconds of a film, and for how long
    the second one takes more than half a decibel from the first."""

    def least(windows: DataFrame, depth: float, ramp: float, name: str) -> DataFrame:
        """Samples that a window reaches: each window names the samples that it touches."""
        first = F.greatest(F.lit(0), F.floor((F.col("start") - ramp) / step))
        touched = windows.withColumn("k", F.explode(F.sequence(first, F.greatest(first, F.ceil((F.col("end") + ramp) / step)))))
        return touched.groupBy(*by, "k").agg(F.min(duck_gain(F.col("k") * step, F.col("start"), F.col("end"), depth, ramp)).alias(name))

    own = merge(dub.filter("end > start"), by, "start", "end", 1.5, strict=True)
    k = films.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("duration") / step) - 1))).alias("k"))
    rows = k.join(least(page, page_db, page_ramp, "p"), [*by, "k"], "left").join(least(own, dub_db, dub_ramp, "d"), [*by, "k"], "left")
    db = lambda g: 20 * F.log10(F.greatest(g, F.lit(1e-6)))
    rows = rows.withColumn("p", F.coalesce("p", F.lit(1.0))).withColumn("g", F.col("p") * F.coalesce("d", F.lit(1.0)))
    deepest = F.min(F.struct("g", "k"))
    return rows.groupBy(*by).agg(db(deepest["g"]).alias("deepest_db"), (deepest["k"] * step).alias("deepest_at"), (F.count_if(db(F.col("g")) < db(F.col("p")) - 0.5) * step).alias("stacked"), db(F.min("p")).alias("page_deepest_db"))
