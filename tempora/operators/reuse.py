"""What can be used again: stored pieces against current ones, drafts, stages, takes.

Decisions are columns: a struct of the action and the first reason, in a fixed order of tests.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPE = ("frame_start", "frame_end", "fps", "width", "height")


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The text of the first rule that holds."""
    out = F.lit(None).cast("string")
    for rule, text in reversed(rules):
        out = F.when(rule, text).otherwise(out)
    return out


def same_encoder(stored: Column, current: Column) -> Column:
    """An encoder that wasn't recorded is the usual one; one that isn't asked for fits any."""
    return current["encoder"].isNull() | (F.coalesce(stored["encoder"], F.lit("libx264")) == current["encoder"])


def same_shape(stored: Column, current: Column) -> Column:
    out = same_encoder(stored, current)
    for c in SHAPE:
        out = out & stored[c].eqNullSafe(current[c])
    return out


def segment_reuse(stored: Column, current: Column, exists: Column) -> Column:
    """(reuse, reason) of a stored segment: struct with SHAPE, encoder, probes and mismatch."""
    probes = F.size(stored["probes"]) != F.size(current["probes"])
    differs = F.exists(F.arrays_zip(stored["probes"].alias("a"), current["probes"].alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))
    reason = first_reason([
        (~exists, "no file"), (stored.isNull(), "not stored"), (F.coalesce(stored["mismatch"], F.lit(False)), "differs from the page"),
        (~stored["frame_start"].eqNullSafe(current["frame_start"]) | ~stored["frame_end"].eqNullSafe(current["frame_end"]), "frame range"),
        (~stored["fps"].eqNullSafe(current["fps"]), "frame rate"), (~stored["width"].eqNullSafe(current["width"]) | ~stored["height"].eqNullSafe(current["height"]), "size"),
        (~same_encoder(stored, current), "encoder"), (stored["probes"].isNull() | probes, "number of probes"), (differs, "probe"),
    ])
    return F.struct(reason.isNull().alias("reuse"), reason.alias("reason"))


def stamp_matches(known: Column, recorded: Column, now_known: Column, now: Column) -> Column:
    """Why a piece's record of its base doesn't fit the base now; null if it fits.

    ``known``: whether a base was recorded at all (its record may be null: there was none);
    ``now_known``: whether the base was looked for now."""
    return first_reason([
        (~now_known, None), (~known & now.isNull(), None), (~known, "no record of the base"), (recorded.isNull() & now.isNull(), None),
        (recorded.isNull(), "the base is new"), (now.isNull(), "the base is gone"), ((recorded["size"] != now["size"]) | (recorded["mtime"] != now["mtime"]), "the base changed"),
    ])


def language_segment(own: Column, base: Column, stamp: Column) -> Column:
    """REUSE a language's own piece, COPY the base's, or RENDER, from two reuse decisions and the stamp's reason."""
    keep = own["reuse"] & stamp.isNull()
    action = F.when(keep, "REUSE").when(base["reuse"], "COPY").otherwise("RENDER")
    return F.struct(action.alias("action"), F.when(~keep & ~base["reuse"], F.when(own["reuse"], stamp).otherwise(own["reason"])).alias("reason"))


def unprobed_segment(base: Column, own: Column, current: Column, strings: Column, base_exists: Column, own_exists: Column, stamp: Column) -> Column:
    """The same without probes, where the base recorded which strings it draws (``reads``) and none of
    them is translated; null if that can't be told."""
    changed = F.map_keys(F.map_filter(F.coalesce(strings, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != "")))
    untold = base.isNull() | F.coalesce(base["mismatch"], F.lit(False)) | F.coalesce(own["mismatch"], F.lit(False)) | ~base_exists | ~same_shape(base, current) | base["reads"].isNull() | F.coalesce(base["reads_all"], F.lit(False))
    current_copy = own.isNotNull() & own_exists & same_shape(own, current) & own["probes"].eqNullSafe(base["probes"]) & stamp.isNull()
    return F.when(F.coalesce(untold, F.lit(True)) | (F.size(F.array_intersect(base["reads"], changed)) > 0), None).when(F.coalesce(current_copy, F.lit(False)), "REUSE").otherwise("COPY")


def outside_selection(segments: DataFrame, stored: DataFrame, only: list[str]) -> DataFrame:
    """Segments that aren't selected but whose stored range isn't the current one: they must be."""
    s = stored.select(F.col("id"), F.struct("frame_start", "frame_end").alias("was"))
    out = segments.filter(~F.col("id").isin(only)).join(s, "id", "left")
    return out.filter(~F.col("was").eqNullSafe(F.struct("frame_start", "frame_end"))).select("id")


def unknown_ids(segments: DataFrame, only: DataFrame) -> DataFrame:
    return only.join(segments.select("id"), "id", "left_anti")


def neighbours(segments: DataFrame, by: list[str], only: list[str], skip: list[str] = ()) -> DataFrame:
    """Segments beside selected ones, without these and those to skip."""
    w = Window.partitionBy(*by).orderBy("pos")
    chosen = F.col("id").isin(list(only))
    rows = segments.withColumn("__c", chosen).withColumn("__near", F.coalesce(F.lag("__c").over(w), F.lit(False)) | F.coalesce(F.lead("__c").over(w), F.lit(False)))
    return rows.filter(F.col("__near") & ~F.col("__c") & ~F.col("id").isin(list(skip))).drop("__c", "__near")


def draft_state(stamp: Column, now: Column, probes: Column, current: Column) -> Column:
    return F.when(stamp.isNull(), "unstamped").when(stamp == now, "current").when(probes.isNull() | current.isNull(), "stamp moved").when(probes == current, "slot unchanged").otherwise("stale")


def take_state(exists: Column, recorded: Column, text: Column) -> Column:
    """A raw take's state by the digest of the text that it was made from."""
    return F.when(~exists, "missing").when(recorded.isNull(), "unrecorded").when(recorded == F.sha2(text, 256), "current").otherwise("stale")


def verify_content(text: Column, is_json: Column, contains: Column, matches: Column) -> Column:
    """The first check that a text fails: JSON, contained text, pattern; null if none."""
    return first_reason([(F.coalesce(is_json, F.lit(False)) & F.try_parse_json(text).isNull(), "no JSON"), (F.coalesce(~F.contains(text, contains), F.lit(False)), "text missing"), (F.coalesce(~F.regexp(text, matches), F.lit(False)), "pattern missing")])


def verify_done(size: Column, modified: Column, started: Column, least: Column, content: Column, slack: float = 2.0) -> Column:
    """Why a stage's file doesn't count: missing, too small, older than the run (seconds), or its content."""
    return F.coalesce(first_reason([(size.isNull(), "missing"), (size < F.coalesce(least, F.lit(1)), "too small"), (F.coalesce(modified < started - slack, F.lit(False)), "older than the run")]), content)


def choose_take(takes: DataFrame, by: list[str], score: Column) -> DataFrame:
    """The fitting take of the lowest finite score, the lowest number on a tie; keys without one are missing."""
    ok = takes.withColumn("__s", score).filter(F.col("fits") & F.col("__s").isNotNull() & ~F.isnan("__s") & (F.abs("__s") != float("inf")))
    w = Window.partitionBy(*by).orderBy("__s", "k")
    return ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__s")


def waiting_order(tickets: DataFrame) -> DataFrame:
    return tickets.filter("alive").orderBy(F.desc("priority"), "arrived", "id")


def shuffled(rows: DataFrame, seed: str, column: str) -> DataFrame:
    """Rows in an order that a seed gives (a sort by hash, not a swap by swap shuffle)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(column)), F.col(column))


def scores_template(cards: DataFrame) -> DataFrame:
    return cards.select("id", F.lit(None).cast("double").alias("fit"), F.lit(False).alias("manual"))


def with_manual(cards: DataFrame, manual: DataFrame, entries: DataFrame) -> DataFrame:
    """Scores in the order of cards: what was given by hand first, then new ones."""
    m, e = manual.select("id", F.col("fit").alias("__m")), entries.select("id", F.col("fit").alias("__e"))
    return cards.select("pos", "id").join(m, "id", "left").join(e, "id", "left").select("pos", "id", F.coalesce("__m", "__e").alias("fit"), F.col("__m").isNotNull().alias("manual")).orderBy("pos")


def with_poorest(frames: DataFrame, regions: str = "regions") -> DataFrame:
    """The region of the lowest ratio (of several the first) as fields of the row."""
    ranked = F.array_sort(F.transform(regions, lambda r, i: F.struct(r["ratio"].alias("ratio"), i.alias("i"), r.alias("region"))))
    return frames.withColumn("poorest", F.get(F.filter(ranked, lambda r: r["ratio"].isNotNull()), F.lit(0))["region"])


def list_entries(entries: DataFrame, older_than: float) -> DataFrame:
    """Queue entries with the reasons for which they may go."""
    reasons = F.array_compact(F.array(F.when(~F.col("alive"), "owner gone"), F.when(F.col("age") > older_than, "old"), F.when(F.col("output").isNotNull() & ~F.coalesce("output_present", F.lit(False)), "output missing")))
    return entries.withColumn("reasons", reasons)


def remove_entries(entries: DataFrame, ids: DataFrame, force: bool = False) -> DataFrame:
    """Entries without those of the ids; an error, before any is removed, for unknown ids and living owners."""
    unknown = ids.join(entries.select("id"), "id", "left_anti")
    live = entries.join(ids, "id", "left_semi").filter("alive") if not force else entries.limit(0)
    bad = [r.id for r in unknown.select("id").union(live.select("id")).limit(20).collect()]
    if bad:
        raise ValueError(f"unknown or in use: {', '.join(map(str, bad))}")
    return entries.join(ids, "id", "left_anti")


def cache_key(files: DataFrame, options: dict) -> str:
    """A digest of a listing (path, size, mtime) and options: files are digested one by one, and a
    digest of digests in order of path is taken by ranges, so that no text of them all is needed."""
    one = files.select("path", F.sha2(F.concat_ws("|", "path", "size", "mtime"), 256).alias("d"))
    parts = one.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    found = [r.d for r in parts.orderBy("part").collect()]  # 256 rows at most
    return hashlib.sha256((json.dumps(options, sort_keys=True) + "".join(found)).encode()).hexdigest()


# spans against stored segments


def splice_plan(segments: DataFrame, spans: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """Pieces of segments (frame_start, frame_end) that spans (from, to) don't touch, kept, and what
    they touch, new: an equi-join on buckets of frames, then the fragments of each segment."""
    s = spans.select(*by, "from", "to", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))).alias("__b"))
    g = segments.select(*by, "id", "frame_start", "frame_end", F.explode(F.sequence(F.floor(F.col("frame_start") / width), F.floor((F.col("frame_end") - 1) / width))).alias("__b"))
    hit = g.join(s, [*by, "__b"]).filter("from < frame_end and to > frame_start").select(*by, "id", "frame_start", "frame_end", F.greatest("from", "frame_start").alias("from"), F.least("to", "frame_end").alias("to")).distinct()
    from .intervals import merge

    new = merge(hit, [*by, "id", "frame_start", "frame_end"], "from", "to").drop("n_spans")
    w = Window.partitionBy(*by, "id").orderBy("from")
    piece = lambda a, b, kind: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"), F.lit(kind).alias("kind"))
    rows = new.withColumn("__before", F.coalesce(F.lag("to").over(w), F.col("frame_start"))).withColumn("__last", F.lead("from").over(w).isNull())
    tail = F.when(F.col("__last"), piece(F.col("to"), F.col("frame_end"), "keep"))
    pieces = F.array_compact(F.array(piece(F.col("__before"), F.col("from"), "keep"), piece(F.col("from"), F.col("to"), "new"), tail))
    touched = rows.select(*by, "id", F.explode(pieces).alias("p")).select(*by, "id", "p.*").filter(F.col("to") > F.col("from"))
    whole = segments.join(new.select(*by, "id").distinct(), [*by, "id"], "left_anti").select(*by, "id", F.col("frame_start").cast("long").alias("from"), F.col("frame_end").cast("long").alias("to"), F.lit("keep").alias("kind"))
    return touched.union(whole)


def insert_plan(segments: DataFrame, by: list[str], at: Column, frames: Column) -> DataFrame:
    """Where segments lie after a clip of ``frames`` is put in at a frame: what is behind moves, a
    segment that holds the frame is cut in two."""
    a, n = F.col("__at"), F.col("__n")
    rows = segments.withColumn("__at", at).withColumn("__n", frames)
    piece = lambda x, y, by_: F.struct((x + by_).cast("long").alias("from"), (y + by_).cast("long").alias("to"), x.cast("long").alias("source_from"))
    s, e = F.col("frame_start"), F.col("frame_end")
    pieces = F.when(e <= a, F.array(piece(s, e, F.lit(0)))).when(s >= a, F.array(piece(s, e, n))).otherwise(F.array(piece(s, a, F.lit(0)), piece(a, e, n)))
    return rows.select(*by, "id", F.explode(pieces).alias("p")).select(*by, "id", "p.*")


def cut_plan(cuts: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Pieces of [from, to) that can be copied from a key frame to a key frame, and those that must be
    encoded: the first key frame at or behind ``from`` and the last at or before ``to``."""
    from .joins import asof

    c = cuts.withColumn("cut", F.monotonically_increasing_id())
    k = keys.select(*by, F.col("frame").alias("t"), F.lit(0).cast("long").alias("cut"), F.col("frame").alias("key"))
    first = asof(c.select(*by, F.col("from").alias("t"), "cut"), k, by, "t", "cut", "key", forward=True).select(*by, "cut", F.col("match_key").alias("first"))
    last = asof(c.select(*by, F.col("to").alias("t"), "cut"), k, by, "t", "cut", "key").select(*by, "cut", F.col("match_key").alias("last"))
    rows = c.join(first, [*by, "cut"]).join(last, [*by, "cut"])
    end = F.col("to") == F.col("total")
    last_key = F.when(end, F.col("to")).otherwise(F.col("last"))
    copies = F.coalesce(F.col("first") < last_key, F.lit(False))
    piece = lambda a, b, kind: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"), F.lit(kind).alias("kind"))
    pieces = F.when(copies, F.array(piece(F.col("from"), F.col("first"), "encode"), piece(F.col("first"), last_key, "copy"), piece(last_key, F.col("to"), "encode"))).otherwise(F.array(piece(F.col("from"), F.col("to"), "encode")))
    return rows.select(*by, "cut", F.explode(pieces).alias("p")).select(*by, "cut", "p.*").filter(F.col("to") > F.col("from"))


def entry_check_ranges(pieces: DataFrame, by: list[str], edge: int = 2) -> DataFrame:
    """Frames of an entry to look at: encoded pieces, and the edges of copied ones, merged on touch."""
    from .intervals import merge

    both = F.when(F.col("kind") == "encode", F.array(F.struct(F.col("from").alias("from"), F.col("to").alias("to")))).otherwise(
        F.array(F.struct(F.col("from").alias("from"), F.least(F.col("to"), F.col("from") + edge).alias("to")), F.struct(F.greatest(F.col("from"), F.col("to") - edge).alias("from"), F.col("to").alias("to")))
    )
    return merge(pieces.select(*by, F.explode(both).alias("r")).select(*by, "r.*"), by, "from", "to").drop("n_spans")


def frame_grid(packets: DataFrame, by: list[str], fps: float, base: float) -> DataFrame:
    """Frame numbers of packets (n, pts) on a grid, whether a number is doubled or off the grid, and how far a packet is late."""
    frame = F.floor(F.col("pts") * base * fps + 0.5).cast("long")
    rows = packets.withColumn("frame", frame)
    doubled = F.count("*").over(Window.partitionBy(*by, "frame")) > 1
    outside = (F.col("frame") < 0) | (F.col("frame") >= F.count("*").over(Window.partitionBy(*by)))
    return rows.withColumn("problem", F.when(doubled, "doubled").when(outside, "outside")).withColumn("delay", F.greatest(F.lit(0), F.max(F.col("n") - F.col("frame")).over(Window.partitionBy(*by))))


# timelines


def owned_ranges(items: DataFrame, films: DataFrame, by: list[str]) -> DataFrame:
    """Frames that each item owns, to the next start or the film's end, and a digest of what it shows."""
    rows = items.join(films.select(*by, "fps", "duration"), by)
    w = Window.partitionBy(*by).orderBy("start")
    frame = lambda c: F.floor(c * F.col("fps") + 0.5).cast("long")
    a, b = frame(F.col("start")), frame(F.coalesce(F.lead("start").over(w), F.col("duration")))
    rows = rows.withColumn("from", a).withColumn("to", b)
    return rows.select(*by, "id", "from", "to", F.sha2(F.to_json(F.struct("text", "hash", (F.col("to") - F.col("from")).alias("n"))), 256).alias("content"))


def timeline_diff(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Runs of the new timeline (id, from, to, content): kept from the old one, shifted or not, changed or
    added; neighbours of one state and shift are one run."""
    from .intervals import islands

    o = old.select(*by, "id", F.col("from").alias("was"), F.col("content").alias("old_content"))
    rows = new.join(o, [*by, "id"], "left")
    state = F.when(F.col("old_content").isNull(), "added").when(F.col("old_content") == F.col("content"), "keep").otherwise("changed")
    rows = rows.withColumn("state", state).withColumn("shift", F.when(state == "keep", F.col("from") - F.col("was")))
    w = Window.partitionBy(*by).orderBy("from")
    begins = ~F.struct("state", "shift").eqNullSafe(F.lag(F.struct("state", "shift")).over(w)) | (F.lag("to").over(w) != F.col("from"))
    found = islands(rows, by, ["from"], begins)
    return found.groupBy(*by, "island", "state", "shift").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.count("*").alias("items")).drop("island")


def diff_totals(runs: DataFrame, by: list[str]) -> DataFrame:
    n = F.col("to") - F.col("from")
    return runs.groupBy(*by).agg(F.sum(F.when(F.col("state") == "keep", n).otherwise(0)).alias("kept"), F.sum(F.when(F.col("state") != "keep", n).otherwise(0)).alias("new"), F.sum(F.when(F.coalesce(F.col("shift") != 0, F.lit(False)), n).otherwise(0)).alias("shifted"))


def edit_list(runs: DataFrame, old_film: str) -> DataFrame:
    """Runs as an edit list: kept ones from the old film, at their old frames; others are new."""
    keep = F.col("state") == "keep"
    return runs.withColumn("src", F.when(keep, F.lit(old_film))).withColumn("src_from", F.when(keep, F.col("from") - F.col("shift"))).withColumn("fresh", ~keep)


def span_flag(runs: DataFrame, by: list[str], fps: float) -> DataFrame:
    """Changed runs as a text of seconds."""
    one = F.format_string("%.3f-%.3f", F.col("from") / fps, F.col("to") / fps)
    rows = runs.filter("state <> 'keep'").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("from", one.alias("t")))).alias("l"))
    return rows.select(*by, F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("spans"))


def cover(clips: DataFrame, by: list[str]) -> DataFrame:
    """The fewest clips (from, to) that cover a run (start, end): at each point the one that reaches
    farthest.  A clip is taken if some point is reached by no clip that starts as early and goes farther.

    Each clip that reaches farther than all before it in order of start is a step; of the steps those
    are jumped to that start last before the reach of the one before.  Steps of a run are folded in one row."""
    w = Window.partitionBy(*by).orderBy("from", F.desc("to")).rowsBetween(Window.unboundedPreceding, -1)
    steps = clips.withColumn("__r", F.max("to").over(w)).filter("__r is null or to > __r")
    rows = steps.groupBy(*by, "start", "end").agg(F.array_sort(F.collect_list(F.struct("from", "to", "id"))).alias("s"))
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("ids"), F.lit(None).cast("struct<`from`:bigint,`to`:bigint,id:string>").alias("best"), F.lit(False).alias("gap"))

    def take(acc: Column, x: Column) -> Column:
        """Keep the farthest clip that starts in time; go on from it once the next one starts too late."""
        late = x["from"] > acc["at"]
        jump = late & acc["best"].isNotNull()
        at = F.when(jump, acc["best"]["to"]).otherwise(acc["at"])
        ids = F.when(jump & (acc["at"] < F.col("end")), F.concat(acc["ids"], F.array(acc["best"]["id"]))).otherwise(acc["ids"])
        gap = acc["gap"] | ((x["from"] > at) & (at < F.col("end")))
        best = F.struct(x["from"].cast("long").alias("from"), x["to"].cast("long").alias("to"), x["id"].alias("id"))
        return F.struct(at.cast("long").alias("at"), ids.alias("ids"), F.when(x["to"] > at, best).otherwise(F.when(~jump, acc["best"])).alias("best"), gap.alias("gap"))

    folded = rows.withColumn("__f", F.aggregate("s", first.cast("struct<at:bigint,ids:array<string>,best:struct<`from`:bigint,`to`:bigint,id:string>,gap:boolean>"), take))
    more = F.col("__f.at") < F.col("end")
    ids = F.when(more & F.col("__f.best").isNotNull(), F.concat("__f.ids", F.array("__f.best.id"))).otherwise(F.col("__f.ids"))
    gap = F.col("__f.gap") | (F.coalesce(F.greatest("__f.best.to", "__f.at"), F.col("__f.at")) < F.col("end"))
    return rows.join(folded.select(*by, "start", "end", ids.alias("clips"), gap.alias("gap")), [*by, "start", "end"]).drop("s")
