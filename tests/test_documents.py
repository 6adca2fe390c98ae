import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.sources import documents as do
from tempora.sources import parts as pt


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_json_files(spark, tmp_path):
    path = f"file://{tmp_path}/doc.json"
    do.write_json(spark, {"a": 1, "b": ["é"]}, path)
    do.write_json(spark, {"a": 2, "b": ["é"]}, path)
    assert rows(do.read_json(spark, path, "a int, b array<string>")) == [(2, ["é"])]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        do.read_json(spark, f"{tmp_path}/bad.json", "a int").collect()
    assert do.folder_tables("/x/")["timings"] == "/x/voice/timings.json"


def test_paths(spark, tmp_path):
    assert do.inside("/lib", "a/../b") == "/lib/b" and do.inside("s3://x/lib", "a") == "s3://x/lib/a"
    for bad in ("../x", "/etc", "a/../../x"):
        with pytest.raises(ValueError):
            do.inside("/lib", bad)
    (tmp_path / "lib").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "lib" / "link").symlink_to(tmp_path / "out")
    with pytest.raises(ValueError, match="links out"):
        do.inside(str(tmp_path / "lib"), "link")
    assert do.library_folder(spark, "/d") == "/d"


def test_catalogue(spark, tmp_path):
    good = {"id": "a", "role": "r", "kind": "model", "path": "p", "license": {"kind": "cc", "commercial_safe": True}}
    (tmp_path / "catalog.json").write_text(json.dumps({"assets": [good, good | {"path": " "}, good | {"id": "b", "license": None}, good | {"id": "c", "license": {"kind": "x"}}, good | {"role": "again"}]}))
    found = do.catalogue(spark, str(tmp_path))
    assert [r.id for r in found.orderBy("pos").collect()] == ["a", "c", "a"]
    first = do.by_id(found, "id")
    assert sorted((r.id, r.role) for r in first.collect()) == [("a", "r"), ("c", "r")] and first.filter(do.is_model(F.col("kind"))).count() == 2
    cue = lambda *x: spark.createDataFrame([(i, n) for n, i in enumerate(x)], "asset string, at int")
    assert do.fetched(cue("a"), first).first().path == "p" and do.fetched(cue("a", "c"), first, personal=True).count() == 2
    with pytest.raises(ValueError, match="unknown assets: y, z"):
        do.fetched(cue("z", "a", "y"), first)
    with pytest.raises(ValueError, match="commercial use: c"):
        do.fetched(cue("a", "c"), first)


def test_lines(spark):
    lines = ['{"id": "a", "v": 1}', "junk", '{"v": 2}', '{"id": "a", "v": 3}', '{"id": 7}', "[1]"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, t string")
    assert rows(do.json_lines_by_id(df, "t", "n"), "id") == [("7", 4, '{"id": 7}'), ("a", 3, '{"id": "a", "v": 3}')]


def test_results(spark, tmp_path):
    ok = {"type": "result", "subtype": "success", "total_cost_usd": 1.5, "duration_ms": 10, "num_turns": 2, "usage": {"input_tokens": 5, "cache_read_input_tokens": 3, "output_tokens": 4}, "session_id": "s"}
    files = {"film.r1a.0.json": json.dumps(ok), "film.r1a.1.json": json.dumps([{"type": "x"}, ok | {"subtype": "error_max_turns"}, {"type": "y"}]), "voice.2.json": "", "result-script.json": json.dumps({"cost_usd": 2, "is_error": True}), "b.json": "[]"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = do.read_results(spark, str(tmp_path))
    got = {(r.stage, r.run, r.attempt): r for r in found.collect()}
    assert set(got) == {("film", "r1a", 0), ("film", "r1a", 1), ("voice", "", 2), ("script", "", 0), ("b", "", 0)}
    a = got["film", "r1a", 0]
    assert (a.flags, a.cost, a.tokens_in, a.tokens_out, a.session) == ([], 1.5, 8.0, 4.0, "s")
    assert got["film", "r1a", 1].flags == ["error_max_turns"] and got["voice", "", 2].flags == ["unreadable"] == got["b", "", 0].flags and got["script", "", 0].flags == ["is_error"]
    report = {r.stage: r for r in do.stage_report(found).collect()}
    assert report["film"].flags == ["error_max_turns@resume1"] and report["film"].cost == 3.0 and report[None].sessions == 5 and report["voice"].flags == ["unreadable@resume2"]


def test_logs(spark, tmp_path):
    log = tmp_path / "u.jsonl"
    log.write_text('{"provider": "p", "chars": 10, "seconds": 1.5, "cost": 0.1}\n{"provider": "p", "chars": 5, "audioSec": 2}\n\nnot json\n')
    got = {r.provider: r for r in do.read_usage(spark, {"voice": f"{log}", "dub": f"{tmp_path}/none"}).collect()}
    assert (got["p"].uses, got["p"].chars, got["p"].seconds, got["p"].cost, got["p"].no_cost) == (2, 15.0, 3.5, 0.1, 1) and got[None].unreadable == 1
    assert do.read_usage(spark, {}).count() == 0
    notes = []
    assert do.append_log(spark.range(2), f"{tmp_path}/log") and do.append_log(spark.range(2), f"{tmp_path}/log") and spark.read.json(f"{tmp_path}/log").count() == 4
    (tmp_path / "file").write_text("x")
    assert not do.append_log(spark.range(1), f"file://{tmp_path}/file/x", notes.append) and notes
    (tmp_path / "state.json").write_text('{"stages": {"a": {"startedAt": 5, "finishedAt": 9}, "b": {"startedAt": 5}}}')
    assert rows(do.wall_times(spark, f"{tmp_path}/state.json")) == [("a", 4.0)] and do.wall_times(spark, f"{tmp_path}/no.json").count() == 0


def test_imports_and_growth(spark):
    files = spark.createDataFrame([("a", "import './b'\nimport x from './c';"), ("b", "from './a'"), ("c", "from './d.js'"), ("e", "")], "file string, text string")
    assert sorted(r.file for r in do.imported_sources(files, spark.createDataFrame([("a",)], "file string")).collect()) == ["a", "b", "c"]
    grow = spark.createDataFrame([("x", '[{"w":1},{"w":2},{"w'), ("y", '[{"w":1}]'), ("z", "[")], "file string, text string")
    assert sorted((r.file, len(r["items"])) for r in do.grown_prefix(grow, {"y": 1}).collect()) == [("x", 2)]
    assert sorted(r.file for r in do.grown_prefix(grow, {}).collect()) == ["x", "y"]


IDENT = "1 0 0 0 1 0 0 0 1"
MODEL = f"""0 FILE Main.ldr
1 16 10 0 0 {IDENT} sub\\One.ldr
0 NOFILE
noise
0 FILE sub\\one.ldr
0 STEP
1 4 0 0 0 {IDENT} 3001.dat
1 0x2aabbcc 1 2 3 0 1 0 1 0 0 0 0 1 two.ldr
0 STEP
0 STEP
1 4 0 0 0 {IDENT} two.ldr
1 4 x 0 0 {IDENT} bad.dat
0 FILE two.ldr
1 1 0 0 0 {IDENT} 3002.dat
"""


def test_models(spark):
    texts = spark.createDataFrame([("k", MODEL), ("p", f"\n1 4 0 0 0 {IDENT} a.dat\n")], "file string, text string")
    lines = pt.model_lines(texts, ["file"])
    assert {r.model for r in lines.collect()} == {"main.ldr", "sub/one.ldr", "two.ldr"} and lines.filter("line = 'noise'").count() == 0
    assert pt.steps(lines, ["file"]).filter("file <> 'k'").count() == 1
    one = pt.steps(lines.filter("file = 'k'").drop("file"), [])
    assert [(r.step, r.part) for r in one.filter("model = 'sub/one.ldr'").orderBy("pos").collect()] == [(1, "3001.dat"), (1, "two.ldr"), (2, "two.ldr")]
    m = one.filter("part = 'two.ldr' and step = 1").first().m
    assert m == [0, 1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3]
    name, matrix = pt.build_model(one, "main.ldr")
    assert name == "sub/one.ldr" and matrix[3] == 10
    assert pt.model_tree(one, "main.ldr") == [(0, 1, "sub/one.ldr", False), (1, 1, "two.ldr", False), (1, 2, "two.ldr", True)]
    conf = spark.createDataFrame([("0 !COLOUR Red CODE 4 VALUE #C91A09 EDGE #333333 ALPHA 128",), ("0 !COLOUR Blue CODE 1 VALUE #0055BF EDGE #333333",), ("0 other",)], "line string")
    table = pt.colours(conf)
    assert rows(table, "code") == [("1", "Blue", "#0055BF", "#333333", 255), ("4", "Red", "#C91A09", "#333333", 128)]
    assert {r.color: r.value for r in pt.with_colour(one, table).collect()} == {"4": "#C91A09", "1": "#0055BF", "0x2aabbcc": "#aabbcc", "16": None}
    t = spark.createDataFrame([("a.dat", "0 ~Moved to b"), ("b.dat", "0 ~Moved to C"), ("c.dat", "0 Brick 2 x 4"), ("x.dat", "0 ~Moved to y")], "name string, line string")
    assert rows(pt.titles(t), "name") == [("a.dat", "Brick 2 x 4"), ("b.dat", "Brick 2 x 4"), ("c.dat", "Brick 2 x 4"), ("x.dat", "~Moved to y")]


def container(doc, blob=b""):
    body = json.dumps(doc).encode()
    body += b" " * (-len(body) % 4)
    return b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<I4s", len(body), b"JSON") + body + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def test_scenes(spark):
    t, v = np.array([0, 1, 2], "<f4"), np.array([0, 0, 1, 0, 1, 1], "<f4")
    cubic = np.arange(18, dtype="<f4")
    blob = t.tobytes() + v.tobytes() + cubic.tobytes()
    views = [{"byteOffset": 0}, {"byteOffset": 12}, {"byteOffset": 36}]
    acc = [{"count": 3, "type": "SCALAR", "componentType": 5126, "bufferView": 0}, {"count": 6, "type": "SCALAR", "componentType": 5126, "bufferView": 1}, {"count": 18, "type": "SCALAR", "componentType": 5126, "bufferView": 2}, {"count": 9}]
    doc = {
        "scenes": [{"nodes": [0]}], "nodes": [{"name": "ro ot", "children": [1, 2]}, {"name": "a.b", "mesh": 0}, {"name": "c", "children": [1]}], "accessors": acc, "bufferViews": views,
        "meshes": [{"primitives": [{"indices": 3, "targets": [{}, {}]}, {"mode": 5, "attributes": {"POSITION": 3}}], "extras": {"targetNames": ["smile"]}}],
        "animations": [{"name": "clip", "samplers": [{"input": 0, "output": 1, "interpolation": "STEP"}, {"input": 0, "output": 2, "interpolation": "CUBICSPLINE"}], "channels": [{"sampler": 0, "target": {"path": "weights", "node": 1}}, {"sampler": 1, "target": {"path": "weights", "node": 2}}, {"sampler": 0, "target": {"path": "scale", "node": 0}}]}],
    }
    files = spark.createDataFrame([("x.glb", bytearray(container(doc, blob)))], "path string, content binary")
    got = [(r.node, r.parent, r.name, r.depth, r.triangles, r.targets) for r in pt.read_nodes(files).orderBy("node").collect()]
    assert got == [(0, None, "ro_ot", 0, 0, []), (1, 0, "ab", 1, 10, ["smile", "1"]), (2, 0, "c", 1, 0, [])]
    series = pt.read_morphs(files).collect()
    assert [(round(r.t, 4), r.v) for r in series if r.node == 1 and r.target == 0] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0)]
    assert [r.v for r in series if r.node == 2 and r.target == 0] == [2.0, 8.0, 14.0]
    assert pt.scene_nodes(json.dumps({"nodes": [{"children": [1]}, {}]}).encode())[0]["node"] == 0
    with pytest.raises(ValueError):
        pt.scene_json(b"glTF" + b"\0" * 12 + b"XXXX")
