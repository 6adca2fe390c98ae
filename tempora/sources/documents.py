"""JSON documents, folders of results, logs and catalogues as tables."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole files as rows of a schema; a file that isn't JSON, or a missing path, is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def write_json(spark: SparkSession, value, path: str) -> None:
    """One document, indented, written under another name and moved, by the file system that the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = hadoop(path), hadoop(path + ".draft")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def folder_tables(root: str) -> dict[str, str]:
    """Where a film's folder keeps its tables."""
    names = {"plan": "plan.json", "timings": "voice/timings.json", "usage": "voice/tts-usage.jsonl", "results": "results", "state": ".runner/state.json", "segments": "out/segments", "output": "out"}
    return {k: f"{root.rstrip('/')}/{v}" for k, v in names.items()}


def inside(root: str, path: str) -> str:
    """A path below ``root``, which may be relative to it; ValueError for one that leads out of it."""
    scheme, _, rest = root.rpartition("://")
    whole, top = posixpath.normpath(posixpath.join(rest, path)), posixpath.normpath(rest)
    if whole != top and not whole.startswith(top.rstrip("/") + "/"):
        raise ValueError(f"{path} leads out of {root}")
    if not scheme and os.path.exists(whole):
        real, real_top = os.path.realpath(whole), os.path.realpath(top)
        if real != real_top and not real.startswith(real_top.rstrip("/") + "/"):
            raise ValueError(f"{path} links out of {root}")
    return f"{scheme}://{whole}" if scheme else whole


def library_folder(spark: SparkSession, default: str, setting: str = "spark.tempora.library") -> str:
    """The catalogue's folder: as the session says, or the default one."""
    return spark.conf.get(setting, None) or default


CATALOGUE = "id string, role string, kind string, path string, description string, tags array<string>, duration double, license struct<kind:string,commercial_safe:boolean>"


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a catalogue that have all they need: pos and the entry; others are left out."""
    rows = spark.read.schema(f"assets array<struct<{CATALOGUE.replace(' struct', ': struct').replace(' string', ': string').replace(' array', ': array').replace(' double', ': double')}>>").option("multiLine", "true").json(f"{folder}/catalog.json")
    rows = rows.select(F.posexplode("assets").alias("pos", "a")).select("pos", "a.*")
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return rows.filter(full("id") & full("role") & full("kind") & full("path") & F.col("license").isNotNull())


def by_id(rows: DataFrame, ident: str) -> DataFrame:
    """The first row of each id, in the order of pos."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(ident).orderBy("pos"))).filter("__n = 1").drop("__n")


def is_model(kind: Column, kinds: tuple[str, ...] = ("model", "part", "rig", "scene")) -> Column:
    return F.coalesce(kind.isin(*kinds), F.lit(False))


def fetched(cues: DataFrame, assets: DataFrame, personal: bool = False) -> DataFrame:
    """Cues with their assets; an error that names all unknown ids, or all whose license isn't commercially safe."""
    unknown = cues.join(assets, cues["asset"] == assets["id"], "left_anti").select("asset").distinct()
    refuse(unknown, "asset", "unknown assets")
    used = assets.join(cues.select(F.col("asset").alias("id")).distinct(), "id", "left_semi")
    if not personal:
        refuse(used.filter(~F.coalesce("license.commercial_safe", F.lit(False))), "id", "assets not free for commercial use")
    return cues.join(assets.withColumnRenamed("id", "asset"), "asset")


def refuse(rows: DataFrame, column: str, what: str, most: int = 50) -> None:
    """An error that names up to ``most`` of the rows, if there are any."""
    bad = [str(r[0]) for r in rows.select(column).orderBy(column).limit(most).collect()]
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def json_lines_by_id(lines: DataFrame, text: str, pos: str) -> DataFrame:
    """Lines that are JSON objects with an id: the last of each id, as (id, pos, text); other lines are passed over."""
    ident = F.get_json_object(text, "$.id")
    rows = lines.filter(F.try_parse_json(text).isNotNull() & ident.isNotNull()).select(ident.alias("id"), pos, text)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(pos)))).filter("__n = 1").drop("__n")


# results of stages: <stage>.<run>.<attempt>.json, and older names

RESULT = "type string, subtype string, is_error boolean, session_id string, total_cost_usd double, cost_usd double, duration_ms double, num_turns double, usage struct<input_tokens:double,cache_creation_input_tokens:double,cache_read_input_tokens:double,output_tokens:double>"


def stage_of(file: Column) -> Column:
    """(stage, run, attempt) of a result file's name."""
    name = F.regexp_replace(F.regexp_replace(file, "^.*/", ""), r"\.json$", "")
    pattern = r"^(.+?)(?:\.(r[0-9a-z]+))?\.([0-9]+)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    named = name.rlike(pattern)
    return F.struct(F.when(named, part(1)).otherwise(F.regexp_replace(name, "^result-", "")).alias("stage"), F.when(named, part(2)).otherwise("").alias("run"), F.when(named, part(3).cast("int")).otherwise(0).alias("attempt"))


def parse_result(text: Column) -> Column:
    """A result: an object, or the last event of type ``result`` of an array; null if there is none."""
    many = F.from_json(text, f"array<struct<{_fields(RESULT)}>>")
    last = F.filter(many, lambda e: e["type"] == "result")
    one = F.from_json(text, RESULT)
    return F.when(F.try_parse_json(text).isNull(), None).when(F.ltrim(text).startswith("["), F.get(last, F.size(last) - 1)).when(F.ltrim(text).startswith("{"), one)


def _fields(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def result_rows(files: DataFrame) -> DataFrame:
    """Files (file, text) as rows of cost, time and tokens with flags; an unreadable file is a row with a flag."""
    r = F.col("r")
    rows = files.select(stage_of(F.col("file")).alias("s"), parse_result(F.col("text")).alias("r"))
    cost = F.coalesce(r["total_cost_usd"], r["cost_usd"])
    flags = F.when(r.isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(F.array(F.when(F.coalesce(r["is_error"], F.lit(False)), "is_error"), F.when(F.coalesce((r["subtype"] != "success") & (r["subtype"] != ""), F.lit(False)), r["subtype"]), F.when(cost.isNull(), "no cost"))))
    number = lambda *c: sum((F.coalesce(x, F.lit(0.0)) for x in c), F.lit(0.0))
    u = r["usage"]
    return rows.select("s.*", flags.alias("flags"), r["session_id"].alias("session"), number(cost).alias("cost"), number(r["duration_ms"]).alias("ms"), number(r["num_turns"]).alias("turns"), number(u["input_tokens"], u["cache_creation_input_tokens"], u["cache_read_input_tokens"]).alias("tokens_in"), number(u["output_tokens"]).alias("tokens_out"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.json")
    listed = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    empty = [(str(f.getPath()), "") for f in listed if not f.getLen()]  # readers pass these over
    return result_rows(files.union(spark.createDataFrame(empty, "file string, text string")))


SUMS = ("cost", "ms", "turns", "tokens_in", "tokens_out")


def stage_report(results: DataFrame) -> DataFrame:
    """Sums and flags of each stage, in order of run and attempt, and a row for all (stage null)."""
    flag = F.transform("flags", lambda f: F.struct("run", "attempt", F.when(F.col("attempt") > 0, F.concat(f, F.lit("@resume"), F.col("attempt").cast("string"))).otherwise(f).alias("flag")))
    sums = [F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in SUMS)]
    told = F.transform(F.array_sort(F.flatten(F.collect_list(flag))), lambda x: x["flag"])
    return results.groupBy("stage").agg(*sums, told.alias("flags")).unionByName(results.agg(*sums).withColumn("stage", F.lit(None).cast("string")).withColumn("flags", F.lit(None).cast("array<string>")))


USAGE = "provider string, chars double, seconds double, audioSec double, cost double"


def usage(lines: DataFrame) -> DataFrame:
    """Log lines (scope, text) by scope and provider: uses, characters, seconds, known cost, uses without one, and lines that can't be read."""
    rows = lines.filter(F.trim("text") != "").withColumn("bad", F.try_parse_json("text").isNull() | ~F.ltrim("text").startswith("{")).withColumn("u", F.from_json("text", USAGE))
    provider = F.when(~F.col("bad"), F.coalesce("u.provider", F.lit("?")))
    return rows.groupBy("scope", provider.alias("provider")).agg(
        F.count_if(~F.col("bad")).alias("uses"), F.coalesce(F.sum("u.chars"), F.lit(0.0)).alias("chars"), F.coalesce(F.sum(F.coalesce("u.seconds", "u.audioSec")), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.sum("u.cost"), F.lit(0.0)).alias("cost"), F.count_if(~F.col("bad") & F.col("u.cost").isNull()).alias("no_cost"), F.count_if("bad").alias("unreadable"),
    )


def read_usage(spark: SparkSession, scopes: dict[str, str]) -> DataFrame:
    """The logs of several folders, those that are there; unreadable lines are counted."""
    found = None
    for scope, path in scopes.items():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            one = spark.read.text(path).select(F.lit(scope).alias("scope"), F.col("value").alias("text"))
            found = one if found is None else found.union(one)
    return usage(spark.createDataFrame([], "scope string, text string") if found is None else found)


def append_log(rows: DataFrame, path: str, note: Callable[[str], None] = print) -> bool:
    """Rows appended to a log of JSON lines; a failure is a note and never fails the run."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception as e:  # the log is no part of the result
        note(f"log not written: {e}")
        return False


def wall_times(spark: SparkSession, path: str) -> DataFrame:
    """Stages of a state file with the time from start to finish (ms); without a readable file no rows."""
    empty = spark.createDataFrame([], "stage string, ms double")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    state = spark.read.text(path, wholetext=True).select(F.from_json("value", "stages map<string,struct<startedAt:double,finishedAt:double>>").alias("s"))
    rows = state.select(F.explode("s.stages").alias("stage", "x"))
    return rows.filter("x.finishedAt >= x.startedAt").select("stage", (F.col("x.finishedAt") - F.col("x.startedAt")).alias("ms"))


def imported_sources(files: DataFrame, roots: DataFrame, deepest: int = 200) -> DataFrame:
    """Files (file, text) that the roots reach by imports of files beside them, round by round of new ones."""
    from tempora.functions.session import cut

    target = F.regexp_extract_all("text", F.lit(r"""(?:import|from)\s+['"]\./([^'"]+)['"]"""), 1)
    edges = cut(files.select("file", F.explode(F.array_distinct(target)).alias("into")), "imports")
    seen = cut(roots.select("file").distinct(), "seen")
    front = seen
    for _ in range(deepest):
        new = cut(edges.join(front, "file").select(F.col("into").alias("file")).distinct().join(files.select("file"), "file", "left_semi").join(seen, "file", "left_anti"), "front")
        if new.isEmpty():
            break
        seen, front = cut(seen.union(new), "seen"), new
    return files.join(seen, "file", "left_semi")


def grown_prefix(texts: DataFrame, seen: dict[str, int]) -> DataFrame:
    """Growing JSON arrays (file, text, complete or not) as far as whole items go, of files with more items than seen.

    The text up to its last closed object, closed, is tried; what isn't an array by then has no items."""
    body = F.regexp_replace("text", r"\}[^}]*$", "}")
    closed = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise(F.concat(body, F.lit("]")))
    items = F.coalesce(F.from_json(closed, "array<string>"), F.array().cast("array<string>"))
    before = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in seen.items() for x in (F.lit(k), F.lit(v)))) if seen else F.create_map().cast("map<string,int>"), F.col("file")), F.lit(0))
    return texts.select("file", items.alias("items")).filter(F.size("items") > before)
