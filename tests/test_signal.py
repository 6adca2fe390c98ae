import math

import numpy as np
import pytest

from tempora.functions import signal as sg
from tempora.operators import signal as op

RATE = 16000


def tone(hz, sec, amp=0.5, rate=RATE):
    return amp * np.sin(2 * np.pi * hz * np.arange(int(sec * rate)) / rate)


def quiet(sec, rate=RATE):
    return np.zeros(int(sec * rate))


def test_levels_and_peaks():
    x = np.array([0.0, 1.0, -1.0, 0.0, 0.5])
    assert np.allclose(sg.levels(x, 2), [math.sqrt(0.5), math.sqrt(0.5), 0.5]) and len(sg.levels(x, 2, False)) == 2
    assert sg.rms(x, -1, 2) == 0 and sg.rms(x, 9, 2) == 0 and sg.peak_db(x) == 0 and sg.peak_db(np.zeros(4)) == -math.inf
    assert sg.attack_ms(np.array([0, 0.05, 0.2, 1.0, 0.1]), 1000) == 1.0 and sg.attack_ms(np.zeros(3), 10) == 0


def test_onsets():
    x = np.concatenate([quiet(0.5), tone(300, 0.5)])
    assert abs(sg.steepest_rise(x, RATE, 0.3, 0.7) - 0.5) <= 0.01 and sg.steepest_rise(x, RATE, 0.6, 0.9) is None and sg.steepest_rise(x, RATE, 0.1, 0.11) is None
    assert sg.onset_offset_ms(x, RATE, 0.45) == 50 and sg.onset_offset_ms(quiet(1), RATE, 0.5) is None
    got = sg.word_onsets([{"line": "a", "index": 0, "start": 0.48}, {"line": "a", "index": 1, "start": 0.9}, {"line": "b", "index": 0, "start": None}], x, RATE)
    assert [w["status"] for w in got] == ["ok", "no onset"]
    words = [("a", 0.1, 0.2), ("b", 0.4, 0.9)]
    assert sg.snap_starts(words, x, RATE) == [("a", 0.1, 0.2), ("b", 0.5, 0.9)]
    assert sg.trim_words([("b", 0.4, 0.9), ("q", 0.0, 0.3)], x, RATE) == [("b", 0.5, 0.9), ("q", 0.0, 0.3)]


def test_spectrum():
    assert abs(sg.spectral_peak(tone(440, 1), RATE) - 440) < 8 and abs(sg.brightness_hz(tone(1000, 1), RATE) - 1000) < 60
    noise = np.random.default_rng(1).normal(0, 0.1, RATE)
    assert sg.noisiness(noise, RATE) > 0.5 > 0.1 > sg.noisiness(tone(440, 1), RATE) and sg.noisiness(np.zeros(100), RATE) == 0
    assert sg.pitch_trend(np.concatenate([tone(300, 0.5), tone(600, 0.5)]), RATE) == "rising" and sg.pitch_trend(tone(300, 1), RATE) == "flat"
    assert sg.pitch_trend(np.concatenate([tone(600, 0.5), tone(300, 0.5)]), RATE) == "falling" and sg.pitch_trend(quiet(1), RATE) == "none"
    # the transform against its definition
    x = tone(700, 0.128)
    w = x * np.hanning(2048)
    want = [abs(sum(w * np.exp(-2j * np.pi * k * np.arange(2048) / 2048))) for k in (0, 5, 90)]
    assert np.allclose(sg.spectrum(x, RATE)[0][[0, 5, 90]], want)


def test_pitch():
    for hz in (90, 150, 220, 380):
        found = [p["hz"] for p in sg.pitch_track(tone(hz, 0.4), RATE)]
        assert found and all(abs(f - hz) / hz < 0.02 for f in found)
    assert all(p["hz"] is None for p in sg.pitch_track(np.random.default_rng(2).normal(0, 0.1, 8000), RATE)) and sg.pitch_track(np.zeros(0), RATE) == []
    up = sg.pitch_track(np.concatenate([tone(150, 0.6), tone(220, 0.3)]), RATE)
    assert sg.end_contour(up)["direction"] == "rise" and sg.end_contour(sg.pitch_track(tone(150, 1), RATE))["direction"] == "level" and sg.end_contour([]) is None
    shapes = sg.word_contours(up, [("a", 0.0, 0.5), ("b", 0.4, 0.85), ("c", 5.0, 6.0)])
    assert [s["shape"] for s in shapes] == ["level", "rising", "unvoiced"]
    assert abs(sg.pitch_summary(up)["median_hz"] - 150) < 3 and sg.pitch_summary([{"t": 0, "hz": None}])["voiced"] == 0


def test_loudness():
    x = tone(997, 5, 1.0, 48000)
    assert abs(sg.line_loudness(sg.k_weight(x, 48000), 48000) + 3.01) < 0.05  # a full-scale sine of 997 Hz
    half = np.concatenate([x[: 48000 * 2], quiet(2, 48000)])
    assert abs(sg.line_loudness(sg.k_weight(half, 48000), 48000) + 3.01) < 0.3  # silence is gated
    assert sg.line_loudness(np.zeros(48000), 48000) == -120 and sg.lufs(np.zeros(0)) == -120
    y = sg._biquad(np.array([1.0, 2.0, -1.0, 0.5]), [0.2, 0.3, 0.1], [-0.4, 0.05])
    out, px, py = [], [0, 0], [0, 0]
    for v in (1.0, 2.0, -1.0, 0.5):
        o = 0.2 * v + 0.3 * px[0] + 0.1 * px[1] + 0.4 * py[0] - 0.05 * py[1]
        px, py = [v, px[0]], [o, py[0]]
        out.append(o)
    assert np.allclose(y, out)
    fade = np.minimum(1, np.minimum(np.arange(RATE), np.arange(RATE)[::-1]) / 4000)
    cut, soft = sg.edge_audibility(tone(300, 1), RATE), sg.edge_audibility(tone(300, 1) * fade**3, RATE)
    assert cut["abrupt"] and cut["cut"] and not soft["abrupt"] and not soft["cut"] and sg.edge_audibility(quiet(1), RATE) is None


def test_cuts_and_defects():
    x = np.concatenate([quiet(0.2), tone(300, 0.5), quiet(0.3)])
    assert [c["edge"] for c in sg.step_cuts(x, RATE)] == ["start", "end"] and sg.step_cuts(tone(300, 1), RATE) == []
    assert {(c["id"], c["edge"]) for c in sg.span_cuts(x, RATE, [("a", 0.2, 0.7), ("b", 0.75, 0.95), ("c", 0.1, 0.8)])} == {("a", "start"), ("a", "end")}
    y = np.concatenate([tone(300, 0.5), tone(300, 0.2, 0.01), tone(300, 0.5), quiet(0.4), tone(300, 0.3)])
    d = sg.defects(y, RATE)
    assert d["dips"] == [{"at": 0.5, "sec": 0.2}] and d["pauses"] == [{"at": 1.2, "sec": 0.4}] and d["abrupt"] and sg.defects(quiet(1), RATE) is None
    assert sg.take_flag({"cut": True, "raw_cut": False}, None) == "end cut" and sg.take_flag(None, {"cut": True, "abrupt": True}) == "tail"
    assert sg.take_flag({"cut": True, "raw_cut": True}, {"cut": False, "abrupt": True}) == "end cut" and sg.take_flag(None, None) is None


def test_spans():
    env = [0, 0, 1, 1, 1, 0, 1, 1, 0, 0, 0, 1, 0]
    assert sg.open_spans(env, 0.04) == [{"from": 0.08, "to": 0.32, "open": 0.833}] and sg.open_spans([], 0.04) == [] and sg.open_spans([0.0], 0.04) == []
    x = np.concatenate([quiet(0.1), tone(300, 0.1), quiet(0.2)])
    got = sg.quiet_spans(x, RATE)
    assert [(round(q["from"], 3), round(q["to"], 3)) for q in got] == [(0.0, 0.1), (0.2, 0.4)]


def test_edits():
    x = np.concatenate([np.ones(100), np.zeros(100), np.ones(100)])
    y, pieces = sg.edit_pcm(x, 100, [{"start": 1.1, "end": 1.9, "duration": 0.2}])
    assert len(y) == 240 and pieces == [(110, 190, 110, 130)]
    assert [sg.map_frame(f, pieces) for f in (50, 110, 150, 190, 300)] == [50, 110, 120, 130, 240]
    for bad in ([{"start": 0.5, "end": 1.5, "duration": 1}], [{"start": 1.1, "end": 1.5, "duration": 1}, {"start": 1.4, "end": 1.6, "duration": 1}], [{"start": 1.5, "end": 1.5, "duration": 1}], [{"start": 1.1, "end": 9.0, "duration": 1}], [{"start": 1.1, "end": 1.2, "duration": 1, "x": 1}]):
        with pytest.raises(ValueError):
            sg.edit_pcm(x, 100, bad)
    z = sg.splice(np.zeros(300), np.ones(100), 100, 100, 0.2)
    assert z[99] == 0 and z[100] == 0 and z[150] == 1 and abs(z[110] ** 2 + np.cos(0.5 * np.pi / 2) ** 2 - 1) < 1e-9
    with pytest.raises(ValueError):
        sg.splice(np.zeros(10), np.ones(20), 0, 100)
    assert sg.insert_silence(np.ones(3), 1, 2).tolist() == [1, 0, 0, 1, 1]


def test_columns(spark):
    clips = [("a", RATE, [float(v) for v in np.concatenate([quiet(0.2), tone(200, 0.6), quiet(0.2)])], 0.15, [("w", 0.1, 0.5)], [("s", 0.2, 0.8)]), ("b", RATE, None, 0.1, None, None)]
    df = spark.createDataFrame(clips, "id string, rate int, samples array<float>, mark double, words array<struct<w:string,start:double,end:double>>, spans array<struct<id:string,start:double,end:double>>")
    got = {r.id: r for r in op.features(df).collect()}
    assert abs(got["a"].features.peak_db + 6.02) < 0.1 and got["b"].features is None and "samples" not in got["a"].asDict()
    one = lambda x, c: {r.id: r[c] for r in x.collect()}
    assert one(op.onset_offsets(df), "offset_ms") == {"a": 50, "b": None}
    assert len(one(op.waveform_cuts(df, "spans"), "cuts")["a"]) == 2 and len(one(op.waveform_cuts(df), "cuts")["a"]) == 2
    assert one(op.snapped_words(df), "snapped")["a"][0].start == 0.2 and one(op.trimmed_words(df), "trimmed")["a"][0].start == 0.2
    assert abs([p.hz for p in one(op.pitch(df), "track")["a"] if p.hz][0] - 200) < 3
    assert -15 < one(op.loudness(df), "lufs")["a"] < -5 and one(op.take_defects(df), "defects")["a"].abrupt and one(op.edges(df), "edges")["b"] is None
    assert len(one(op.quiet_spans(df), "quiet")["a"]) == 2 and len(one(op.mouth_spans(df), "spans")["a"]) == 1
