"""Part files: lines of whole models as tables of steps, references and colours; binary scenes as nodes."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.session import prepare

NUMBER = r"[-+0-9.eE]+"
REFERENCE = rf"^\s*1\s+(\S+)\s+((?:{NUMBER}\s+){{12}})(.+?)\s*$"
FILE_LINE = r"^\s*0\s+FILE\s+(.+?)\s*$"
STEP_LINE = r"^\s*0\s+(STEP|ROTSTEP)\b"


def model_name(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit("\\"), F.lit("/"))


def model_lines(texts: DataFrame, by: list[str], fallback: str = "main.ldr") -> DataFrame:
    """Lines of a text of several models: by, model, pos, line.  Lines before the first name, if it has any
    text, are of ``fallback``; lines behind an end mark and before the next name are of none."""
    rows = texts.select(*by, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    name = F.when(F.col("line").rlike(FILE_LINE), model_name(F.regexp_extract("line", FILE_LINE, 1))).when(F.col("line").rlike(r"^\s*0\s+NOFILE\b"), "")
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__name", name).withColumn("model", F.coalesce(F.last("__name", ignorenulls=True).over(w), F.lit(fallback)))
    return rows.filter((F.col("model") != "") & F.col("__name").isNull() & (F.trim("line") != "")).select(*by, "model", "pos", "line")


def reference(line: Column) -> Column:
    """(color, m, part) of a line that refers to another file, its matrix row by row; null for other lines."""
    v = F.transform(F.split(F.trim(F.regexp_extract(line, REFERENCE, 2)), r"\s+"), lambda x: x.try_cast("double"))
    at = lambda *ks: F.array(*(F.get(v, F.lit(k)) for k in ks))
    m = at(3, 4, 5, 0, 6, 7, 8, 1, 9, 10, 11, 2)
    ok = line.rlike(REFERENCE) & ~F.exists(v, lambda x: x.isNull())
    return F.when(ok, F.struct(F.regexp_extract(line, REFERENCE, 1).alias("color"), m.alias("m"), F.regexp_extract(line, REFERENCE, 3).alias("part")))


def steps(lines: DataFrame, by: list[str]) -> DataFrame:
    """References of models with their step, steps without any left out: by, model, step (from 1), pos, color, m, part."""
    key = Window.partitionBy(*by, "model")
    marks = F.sum(F.col("line").rlike(STEP_LINE).cast("int")).over(key.orderBy("pos"))
    rows = lines.withColumn("__s", marks).withColumn("r", reference(F.col("line"))).filter("r is not null")
    return rows.withColumn("step", F.dense_rank().over(key.orderBy("__s"))).select(*by, "model", "step", "pos", "r.*")


def build_model(refs: DataFrame, main: str, deepest: int = 16) -> tuple[str, list[float]]:
    """The model to build: from ``main`` down through models that hold one model only, and its matrix."""
    name, m = main, np.hstack([np.eye(3), np.zeros((3, 1))])
    for _ in range(deepest):
        own = refs.filter(F.col("model") == name).select("m", model_name(F.col("part")).alias("child")).limit(2).collect()
        if len(own) != 1 or refs.filter(F.col("model") == own[0].child).isEmpty():
            break
        inner = np.array(own[0].m).reshape(3, 4)
        m = np.hstack([m[:, :3] @ inner[:, :3], (m[:, :3] @ inner[:, 3] + m[:, 3])[:, None]])
        name = own[0].child
    return name, m.ravel().tolist()


def model_tree(refs: DataFrame, main: str) -> list[tuple[int, int, str, bool]]:
    """(depth, step, model, again) of sub-models in the order of building; a model met again isn't opened again.

    A model file's own structure, which its builder holds in hand: one row for each reference to a sub-model."""
    rows = refs.select("model", "step", "pos", model_name(F.col("part")).alias("child"))
    models = rows.select(F.col("model").alias("child")).distinct()
    inner: dict[str, list] = {}
    for r in rows.join(models, "child", "left_semi").orderBy("model", "step", "pos").collect():
        inner.setdefault(r.model, []).append((r.step, r.child))
    out, seen = [], {main}
    stack = [(0, iter(inner.get(main, [])))]
    while stack:
        depth, todo = stack[-1]
        nxt = next(todo, None)
        if nxt is None:
            stack.pop()
            continue
        step, child = nxt
        out.append((depth, step, child, child in seen))
        if child not in seen:
            seen.add(child)
            stack.append((depth + 1, iter(inner.get(child, []))))
    return out


def colours(lines: DataFrame) -> DataFrame:
    """Colour definitions among lines: code, name, value, edge, alpha."""
    pattern = r"^\s*0\s+!COLOUR\s+(\S+)\s+CODE\s+([0-9]+)\s+VALUE\s+(#[0-9A-Fa-f]{6})\s+EDGE\s+(#[0-9A-Fa-f]{6})(.*)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    alpha = F.regexp_extract(part(5), r"ALPHA\s+([0-9]+)", 1)
    return lines.filter(F.col("line").rlike(pattern)).select(part(2).alias("code"), part(1).alias("name"), part(3).alias("value"), part(4).alias("edge"), F.when(alpha == "", 255).otherwise(alpha.try_cast("int")).alias("alpha"))


def with_colour(refs: DataFrame, table: DataFrame) -> DataFrame:
    """References with the value of their colour: of the table, or given directly as 0x2RRGGBB."""
    direct = F.regexp_extract("color", "^0x2([0-9A-Fa-f]{6})$", 1)
    return refs.join(table.select(F.col("code").alias("color"), F.col("value").alias("__v")), "color", "left").withColumn("value", F.coalesce("__v", F.when(direct != "", F.concat(F.lit("#"), direct)))).drop("__v")


def titles(parts: DataFrame) -> DataFrame:
    """(name, first line) as (name, title): a part that was moved has the title of where it went."""
    first = F.trim(F.regexp_replace("line", r"^\s*0\s+", ""))
    rows = parts.select(model_name(F.col("name")).alias("name"), first.alias("title"))
    to = F.regexp_extract("title", r"^~Moved to (\S+)", 1)
    rows = rows.withColumn("to", F.when(to != "", F.concat(model_name(to), F.lit(".dat"))))
    for _ in range(8):
        nxt = rows.select(F.col("name").alias("to"), F.col("title").alias("__t"), F.col("to").alias("__to"))
        rows = rows.join(nxt, "to", "left").select("name", F.coalesce("__t", "title").alias("title"), F.when(F.col("__t").isNull(), F.col("to")).otherwise(F.col("__to")).alias("to"))
    return rows.select("name", "title")


# binary scenes


def scene_json(content: bytes) -> tuple[dict, bytes]:
    """The document and the binary part of a scene: a container of chunks, or JSON alone."""
    if content[:4] != b"glTF":
        return json.loads(content.decode()), b""
    chunks, at = {}, 12
    while at + 8 <= len(content):
        size, kind = struct.unpack_from("<I4s", content, at)
        chunks.setdefault(kind, content[at + 8 : at + 8 + size])
        at += 8 + size
    if b"JSON" not in chunks or content[16:20] != b"JSON":
        raise ValueError("the container doesn't begin with JSON")
    return json.loads(chunks[b"JSON"].decode()), chunks.get(b"BIN\0", b"")


def scene_nodes(content: bytes) -> list[dict]:
    """Nodes of a scene in order: index, parent, name, depth, triangles, morph targets.  A node is listed where it is met first."""
    doc, _ = scene_json(content)
    nodes, accessors = doc.get("nodes", []), doc.get("accessors", [])

    def triangles(mesh: dict) -> int:
        total = 0
        for p in mesh.get("primitives", []):
            source = p.get("indices", p.get("attributes", {}).get("POSITION"))
            n, mode = accessors[source]["count"] if source is not None else 0, p.get("mode", 4)
            total += n // 3 if mode == 4 else max(0, n - 2) if mode in (5, 6) else 0
        return total

    scenes = doc.get("scenes", [])
    children = {c for n in nodes for c in n.get("children", [])}
    which = doc.get("scene", 0)
    roots = scenes[which].get("nodes", []) if which < len(scenes) else [i for i in range(len(nodes)) if i not in children]
    out, stack, seen = [], [(i, None, 0) for i in reversed(roots)], set()
    while stack:
        i, parent, depth = stack.pop()
        if i in seen or not 0 <= i < len(nodes):
            continue
        seen.add(i)
        mesh = doc["meshes"][nodes[i]["mesh"]] if nodes[i].get("mesh") is not None else {}
        count = max((len(p.get("targets", [])) for p in mesh.get("primitives", [])), default=0)
        names = mesh.get("extras", {}).get("targetNames", [])
        out.append({"node": i, "parent": parent, "name": "".join("_" if c.isspace() else c for c in nodes[i].get("name", "") if c not in "[].:/"), "depth": depth, "triangles": triangles(mesh), "targets": [str(names[k]) if k < len(names) else str(k) for k in range(count)]})
        stack += [(c, i, depth + 1) for c in reversed(nodes[i].get("children", []))]
    return out


def _values(doc: dict, blob: bytes, accessor: int) -> np.ndarray:
    a = doc["accessors"][accessor]
    view = doc["bufferViews"][a["bufferView"]]
    width = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}[a["type"]]
    if a["componentType"] != 5126:
        raise ValueError("only floats are read")
    return np.frombuffer(blob, "<f4", a["count"] * width, view.get("byteOffset", 0) + a.get("byteOffset", 0))


def morph_series(content: bytes) -> list[dict]:
    """Weights of morph targets in time: clip, node, target, t, v.  Steps have a point just before they
    change; of cubic splines the values count, not the tangents."""
    doc, blob = scene_json(content)
    out = []
    for k, clip in enumerate(doc.get("animations", [])):
        for channel in clip.get("channels", []):
            if channel["target"].get("path") != "weights":
                continue
            sampler = clip["samplers"][channel["sampler"]]
            t, v = _values(doc, blob, sampler["input"]), _values(doc, blob, sampler["output"])
            kind = sampler.get("interpolation", "LINEAR")
            per = len(v) // len(t) // (3 if kind == "CUBICSPLINE" else 1)
            v = v.reshape(len(t), 3, per)[:, 1] if kind == "CUBICSPLINE" else v.reshape(len(t), per)
            for target in range(per):
                for i, at in enumerate(t.tolist()):
                    if kind == "STEP" and i and v[i, target] != v[i - 1, target]:
                        out.append({"clip": clip.get("name", f"animation_{k}"), "node": channel["target"].get("node"), "target": target, "t": at - 1e-6, "v": float(v[i - 1, target])})
                    out.append({"clip": clip.get("name", f"animation_{k}"), "node": channel["target"].get("node"), "target": target, "t": at, "v": float(v[i, target])})
    return out


def _listed(files: DataFrame, f, kind: str) -> DataFrame:
    """Rows that f gives for each file's content (path, content)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    prepare(files.sparkSession)
    arrow = to_arrow_type(StructType.fromDDL(f"rows array<struct<{kind}>>")[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    found = f(content)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found], arrow)], names=["path", "rows"])

    return files.select("path", "content").mapInArrow(run, f"path string, rows array<struct<{kind}>>").select("path", F.explode("rows").alias("r")).select("path", "r.*")


def read_nodes(files: DataFrame) -> DataFrame:
    return _listed(files, scene_nodes, "node:int,parent:int,name:string,depth:int,triangles:long,targets:array<string>")


def read_morphs(files: DataFrame) -> DataFrame:
    return _listed(files, morph_series, "clip:string,node:int,target:int,t:double,v:double")
