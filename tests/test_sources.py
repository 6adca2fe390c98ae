import struct

import pytest
from pyspark.sql import functions as F

from tempora.sources import scripts, subtitles, waves


def test_stamps(spark):
    values = [0.0, 754.2504, -3.5, 7199.9996, 432000.0014, None]
    table = spark.createDataFrame([(v,) for v in values], "s double").select(subtitles.stamp(F.col("s")).alias("t"))
    assert [r.t for r in table.collect()] == ["00:00:00,000", "00:12:34,250", "00:00:00,000", "02:00:00,000", "120:00:00,001", None]


def test_cues_of_texts(spark):
    text = "﻿1\r\n00:00:01,5 --> 00:00:02.250\r\nfirst\r\nsecond\r\n\r\n\r\n00:00:03,000-->01:00:04,001\n\n"
    table = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", " \n ")], "lang string, text string")
    found = [(r.lang, r.pos, r.start, r.end, r.lines) for r in subtitles.cues(table).orderBy("pos").collect()]
    assert found == [("a", 0, 1.5, 2.25, ["first", "second"]), ("a", 1, 3.0, 3604.001, [])]
    with pytest.raises(ValueError):
        subtitles.cues(table.withColumn("pos", F.lit(1)))


@pytest.mark.parametrize("text, said", [("1\nno times", "paragraph 1 has no times"), ("00:00:01,0 --> 00:00:02,0\nx\n\n0:1 --> 00:00:02,000", "paragraph 2: these times can't be read"), ("00:61:01 --> 00:62:02", "paragraph 1: these times")])
def test_unreadable_cues(spark, text, said):
    with pytest.raises(Exception, match=said):
        subtitles.cues(spark.createDataFrame([(text,)], "text string")).collect()


def test_files_round_trip(spark, tmp_path):
    rows = [("x", i, i * 2.5, i * 2.5 + 1.25, [f"line {i}", "more"][: i % 3]) for i in range(12)]
    table = spark.createDataFrame(rows, "file string, pos int, start double, `end` double, lines array<string>").repartition(3)
    text = subtitles.written(table, "file").collect()[0].text
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,250\n")
    (tmp_path / "x.srt").write_text(text)
    back = subtitles.read(spark, str(tmp_path)).orderBy("pos").collect()
    # a cue without lines leaves one empty line less between the cues, which still parts them
    assert [(r.pos, r.start, r.end, r.lines) for r in back] == [(p, a, z, w) for _, p, a, z, w in rows]
    assert back[0].file.endswith("/x.srt")


def riff(kind, channels, bits, data, before=b""):
    fmt = struct.pack("<HHIIHH", kind, channels, 8000, 0, 0, bits)
    return b"RIFF\0\0\0\0WAVE" + before + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def test_waves(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(riff(1, 2, 16, struct.pack("<6h", 16384, 0, -32768, -32768, 1, 3), b"LIST\x03\0\0\0abc\0"))
    (tmp_path / "b.wav").write_bytes(riff(3, 1, 32, struct.pack("<2f", 0.5, -0.25))[:-2])
    (tmp_path / "c.wav").write_bytes(riff(0xFFFE, 1, 16, b""))
    found = {r.file[-5:]: (r.sample_rate, r.channels, r.samples) for r in waves.read(spark, str(tmp_path)).collect()}
    assert found == {"a.wav": (8000, 2, [0.25, -1.0, 2 / 32768]), "b.wav": (8000, 1, [0.5]), "c.wav": (8000, 1, [])}


@pytest.mark.parametrize("content, said", [(b"", "no sound file"), (b"RIFF\0\0\0\0WAVE", "holds none"), (riff(1, 1, 24, b"abc"), "isn't read"), (riff(1, 0, 16, b"ab"), "isn't read")])
def test_unreadable_waves(content, said):
    with pytest.raises(ValueError, match=said):
        waves.decode(content)


def test_extensible_and_strict():
    fmt = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 8000, 0, 0, 32, 22, 32, 0, 3, b"")
    data = struct.pack("<2f", 0.25, -0.5)
    content = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    assert waves.decode(content)[2].tolist() == [0.25, -0.5]
    with pytest.raises(ValueError, match="one channel of 16 bits"):
        waves.decode(content, strict=True)


def test_waves_round_trip(spark, tmp_path):
    clips = spark.createDataFrame([("a", 8000, [0.5, -0.5, 2.0]), ("b", 16000, [])], "name string, sample_rate long, samples array<float>")
    waves.write(clips, f"file://{tmp_path}/out")
    back = {r.file[-5:]: r for r in waves.read(spark, f"{tmp_path}/out", strict=True).collect()}
    assert back["b.wav"].samples == [] and back["b.wav"].sample_rate == 16000
    assert [round(v, 3) for v in back["a.wav"].samples] == [0.5, -0.5, 1.0]
    two = waves.decode(waves.encode([[0.0, 1.0], [1.0, 1.0]], 100, 2))
    assert two[:2] == (100, 2) and abs(two[2][0] - 0.5) < 1e-3
    with pytest.raises(ValueError, match="announced"):
        waves.encode([[0.0]], 100, 2)


def test_texts_moved(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\na\n\n2\n00:00:03,000 --> 00:00:04,000\nb\n"
    got = subtitles.text_moved(spark.createDataFrame([("x", text)], "file string, text string"), "file", 2.5, 1.0).first()
    assert got.moved == 1 and got.text == text.replace("03,000", "04,000").replace("04,000 --> 00:00:04,000", "04,000 --> 00:00:05,000")


def test_cues_moved(spark):
    table = spark.createDataFrame([(0, 0.0, 2.0, ["a"]), (1, 1.99951171875, 3.0, ["b"]), (2, 5.0, None, None)], "pos int, start double, `end` double, lines array<string>")
    found = [(r.pos, r.start, r.end) for r in subtitles.moved(table, 2.0, 1.5).orderBy("pos").collect()]
    assert found == [(0, 0.0, 2.0), (1, 3.49951171875, 4.5), (2, 6.5, None)]
    with pytest.raises(Exception, match="goes on over 1.0"):
        subtitles.moved(table, 1.0, 1.5).collect()


def test_script_lines(spark):
    json = '{"title": "t", "lines": [{"id": "x", "text": "one", "lang": "en"}, {"text": " "}, {"id": 7, "text": "two"}, {"text": "three"}]}'
    table = spark.createDataFrame([("j", json), ("p", " a \r\n\n  b\n"), ("n", None), ("e", "")], "name string, text string")
    found = sorted((r.name, r.pos, r.id, r.line, r.lang) for r in scripts.script_lines(table).collect())
    assert found == [("j", 0, "x", "one", "en"), ("j", 2, "7", "two", None), ("j", 3, "l4", "three", None), ("p", 0, "l1", "a", None), ("p", 1, "l2", "b", None)]
    for bad in ('{"lines": 3}', "{}", "{"):
        with pytest.raises(Exception, match="without an array of lines"):
            scripts.script_lines(spark.createDataFrame([(bad,)], "text string")).collect()
