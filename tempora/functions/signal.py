"""Measures of one clip's samples, with NumPy: levels, onsets, spectrum, pitch, loudness, splices.

``x`` holds samples in -1..1, ``rate`` how many a second; times are seconds.  ``tempora.operators.signal``
applies these to columns in Arrow batches, a clip at a time.
"""

from __future__ import annotations

import math

import numpy as np

HOP = 0.01
SILENT = -120.0


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _db(rms: np.ndarray, least: float = 1e-6) -> np.ndarray:
    return 20 * np.log10(np.maximum(rms, least))


def levels(x: np.ndarray, win: int, part: bool = True) -> np.ndarray:
    """RMS of consecutive windows; the last, shorter one too unless ``part`` is false."""
    n = len(x) if part else len(x) // win * win
    if not n:
        return np.zeros(0)
    starts = np.arange(0, n, win)
    sizes = np.diff([*starts, n])
    return np.sqrt(np.add.reduceat(x[:n].astype(np.float64) ** 2, starts) / sizes)


def rms(x: np.ndarray, start: int, size: int) -> float:
    """RMS of a window clipped to the samples; 0 if it is empty."""
    part = x[max(0, start) : max(0, start + size)].astype(np.float64)
    return float(np.sqrt(np.mean(part * part))) if len(part) else 0.0


# peaks and onsets


def peak_db(x: np.ndarray) -> float:
    top = float(np.abs(x).max()) if len(x) else 0.0
    return 20 * math.log10(top) if top >= 1e-12 else -math.inf


def attack_ms(x: np.ndarray, rate: int, share: float = 0.1) -> float:
    """From the first sample at a share of the peak to the peak."""
    if peak_db(x) == -math.inf:
        return 0.0
    a = np.abs(x)
    top = int(a.argmax())
    return (top - int(np.argmax(a >= a[top] * share))) / rate * 1000


def onset_offset_ms(x: np.ndarray, rate: int, mark: float, reach: float = 0.15) -> int | None:
    """How far the steepest rise around a mark is from it; None without a rise."""
    win = max(1, half_up(rate * HOP))
    mid, span = half_up(mark * rate), half_up(reach * rate)
    lo, hi = max(0, mid - span), min(len(x), mid + span)
    at_head = mid - span <= 0
    before = 0.0 if at_head else rms(x, lo, win)
    places = range(lo if at_head else lo + win, hi - win + 1, win)
    best, at = 1e-6, None
    for i in places:
        now = rms(x, i, win)
        if now - before > best:
            best, at = now - before, i
        before = now
    return None if at is None else half_up((at / rate - mark) * 1000)


def steepest_rise(x: np.ndarray, rate: int, start: float, end: float, share: float = 0.25) -> float | None:
    """Where the level rises most within a span, if by a share of the span's highest level."""
    win = max(1, half_up(rate * HOP))
    lo, hi = max(0, half_up(start * rate)), min(len(x), half_up(end * rate))
    n = (hi - lo) // win
    if n < 2:
        return None
    own = levels(x[lo : lo + n * win], win)
    rises = np.diff(own, prepend=rms(x, lo - win, win) if lo else 0.0)
    k = int(rises.argmax())
    if own.max() <= 1e-6 or rises[k] <= 0 or rises[k] < share * own.max():
        return None
    return (lo + k * win) / rate


def word_onsets(words: list[dict], x: np.ndarray, rate: int, reach: float = 0.25, far: float = 0.12) -> list[dict]:
    """For words (line, index, start), in order of start, the onset near each: ok, off or no onset.

    A word is sought no farther than half the way to its neighbours."""
    words = sorted((w for w in words if w["start"] is not None), key=lambda w: w["start"])
    starts = [-math.inf, *(w["start"] for w in words), math.inf]
    out = []
    for k, w in enumerate(words, 1):
        at = w["start"]
        onset = steepest_rise(x, rate, at - min(reach, (at - starts[k - 1]) / 2), at + min(reach, (starts[k + 1] - at) / 2))
        off = None if onset is None else half_up((onset - at) * 1000) / 1000
        out.append({"line": w["line"], "index": w["index"], "onset": onset, "offset": off, "status": "no onset" if off is None else "off" if abs(off) > far else "ok"})
    return out


def sound_floor(x: np.ndarray, rate: int) -> tuple[np.ndarray, float]:
    """Levels of whole windows, and a tenth of their 95th percentile."""
    own = levels(x, max(1, half_up(rate * HOP)), part=False)
    return own, 0.1 * float(np.sort(own)[math.floor(0.95 * (len(own) - 1))]) if len(own) else 0.0


def trim_words(words: list[tuple[str, float, float]], x: np.ndarray, rate: int) -> list[tuple[str, float, float]]:
    """Words shrunk to their first and last window with sound; those without sound stay."""
    own, floor = sound_floor(x, rate)
    out = []
    for w, a, b in words:
        lo, hi = max(0, half_up(a / HOP)), min(len(own), half_up(b / HOP))
        loud = np.flatnonzero(own[lo:hi] >= floor) + lo if hi > lo else np.zeros(0, int)
        out.append((w, max(a, loud[0] * HOP), min(b, (loud[-1] + 1) * HOP)) if len(loud) else (w, a, b))
    return out


def snap_starts(words: list[tuple[str, float, float]], x: np.ndarray, rate: int, pause: float = 0.12, least: float = 0.02, reach: float = 0.6, margin: float = 0.03) -> list[tuple[str, float, float]]:
    """Word starts after a pause moved to the sound: forward over silence, or back to where a sound that
    is on at the start began, by ``least`` at least and ``reach`` at most."""
    own, floor = sound_floor(x, rate)
    out = [list(w) for w in words]
    loud = own >= floor if len(own) else np.zeros(0, bool)
    for i, w in enumerate(out):
        start, end = w[1], w[2]
        before = out[i - 1][2] if i else 0.0
        if not len(own) or (i and start - before < pause):
            continue
        at = half_up(start / HOP)
        if loud[max(0, half_up(before / HOP)) : at].any():
            low = max(0, half_up(max(before + margin if i else 0.0, start - reach) / HOP))
            if not 0 < at <= len(loud) or not loud[at - 1]:
                continue
            quiet = np.flatnonzero(~loud[low:at])
            first = low + (int(quiet[-1]) + 1 if len(quiet) else 0)
            if (first == low and low > 0 and loud[low - 1]) or start - first * HOP < least:
                continue
            w[1] = half_up(first * HOP * 1000) / 1000
            continue
        limit = min((words[i + 1][1] if i + 1 < len(words) else math.inf) - margin, start + reach)
        found = np.flatnonzero(loud[at : half_up(limit / HOP)])
        if not len(found) or (sound := (at + int(found[0])) * HOP) - start < least:
            continue
        nxt = words[i + 1][1] if i + 1 < len(words) else math.inf
        stop = end if sound + margin <= end else min(sound + end - start, nxt)
        w[1], w[2] = half_up(sound * 1000) / 1000, half_up(max(stop, sound + margin) * 1000) / 1000
    return [tuple(w) for w in out]


# cuts


def span_cuts(x: np.ndarray, rate: int, spans: list[tuple[str, float, float]], edge_ms: float = 5.0, audible: float = -40.0, below: float = 20.0) -> list[dict]:
    """Edges of spans that are nearly as loud as the span's loudest window."""
    win, edge, out = max(1, half_up(rate * HOP)), max(1, half_up(rate * edge_ms / 1000)), []
    for ident, a, b in spans:
        lo, hi = half_up(a * rate), min(len(x), half_up(b * rate))
        own = levels(x[lo : lo + (hi - lo) // win * win], win) if hi - lo >= win else np.zeros(0)
        body = float(_db(own).max()) if len(own) else SILENT
        if body < audible:
            continue
        for name, at, sec in (("start", lo, lo), ("end", hi - edge, hi)):
            level = float(_db(np.array([rms(x, at, edge)]))[0])
            if level > body - below:
                out.append({"id": ident, "edge": name, "at": sec / rate, "edge_db": level, "body_db": body})
    return out


def step_cuts(x: np.ndarray, rate: int, edge_ms: float = 5.0, step: float = 30.0, audible: float = -40.0, full: float = 12.0, near: int = 10) -> list[dict]:
    """Sudden steps of level between neighbouring short windows, from or to nearly the full level around."""
    edge = max(1, half_up(rate * edge_ms / 1000))
    own, out = _db(levels(x, edge, part=False)), []
    for w in range(1, len(own)):
        a, b = own[w - 1], own[w]
        if a > audible and b < a - step and a >= own[max(0, w - near) : w].max() - full:
            out.append({"id": None, "edge": "end", "at": w * edge / rate, "edge_db": float(a), "body_db": float(a)})
        elif b > audible and a < b - step and b >= own[w : w + near].max() - full:
            out.append({"id": None, "edge": "start", "at": w * edge / rate, "edge_db": float(b), "body_db": float(b)})
    return out


# spectrum


def spectrum(x: np.ndarray, rate: int, size: int = 2048, most: int = 64) -> tuple[np.ndarray, float]:
    """Mean magnitudes over up to ``most`` Hann-windowed frames spread over the clip, and the bins' width."""
    count = len(x) // size
    used = min(count, most)
    starts = [0] if count <= 1 else [math.floor(k * (count - 1) / max(1, used - 1)) * size for k in range(used)]
    out = np.zeros(size // 2)
    for s in starts:
        part = x[s : s + size].astype(np.float64)
        out += np.abs(np.fft.rfft(part * np.hanning(len(part)) if len(part) > 1 else part * 0, size))[: size // 2]
    return out / len(starts), rate / size


def brightness_hz(x: np.ndarray, rate: int) -> float:
    mags, width = spectrum(x, rate)
    return float((mags * np.arange(len(mags))).sum() * width / mags.sum()) if mags.sum() >= 1e-9 else 0.0


def noisiness(x: np.ndarray, rate: int, low: float = 60.0, high: float = 12000.0) -> float:
    """Spectral flatness: 1 for white noise, near 0 for a tone."""
    mags, width = spectrum(x, rate)
    lo, hi = max(1, math.floor(low / width)), min(len(mags) - 1, math.ceil(high / width))
    power = mags[lo : hi + 1] ** 2
    if not len(power) or power.sum() < 1e-9:
        return 0.0
    power = power + 1e-12
    return float(min(1.0, max(0.0, np.exp(np.log(power).mean()) / power.mean())))


def spectral_peak(x: np.ndarray, rate: int, low: float = 60.0, high: float = 6000.0) -> float | None:
    mags, width = spectrum(x, rate)
    lo, hi = max(1, math.floor(low / width)), min(len(mags) - 1, math.ceil(high / width))
    part = mags[lo : hi + 1]
    if mags.sum() < 1e-9 or not len(part) or part.sum() < 1e-9 or part.max() / part.sum() < 3 / len(part):
        return None
    return (lo + int(part.argmax())) * width


def pitch_trend(x: np.ndarray, rate: int) -> str:
    """The last third's strongest frequency against the first third's."""
    third = len(x) // 3
    if third < rate // 2000:
        return "none"
    a, b = spectral_peak(x[:third], rate), spectral_peak(x[len(x) - third :], rate)
    if a is None or b is None:
        return "none"
    return "rising" if b > a * 1.05 else "falling" if b < a * 0.95 else "flat"


def features(x: np.ndarray, rate: int) -> dict:
    return {"duration": len(x) / rate, "peak_db": peak_db(x), "attack_ms": attack_ms(x, rate), "brightness_hz": brightness_hz(x, rate), "pitch_trend": pitch_trend(x, rate), "noisiness": noisiness(x, rate)}


# pitch


def pitch_track(x: np.ndarray, rate: int, low: float = 70.0, high: float = 400.0, clear: float = 0.45, keep: float = 0.9) -> list[dict]:
    """Fundamental frequency every 10 ms by normalised autocorrelation at about 16 kHz: the shortest lag
    that is a peak and nearly as good as the best; None for quiet or unclear frames."""
    step = max(1, half_up(rate / 16000))
    n = len(x) // step
    x, rate = x[: n * step].astype(np.float64).reshape(n, step).mean(1), rate / step
    size, hop = half_up(0.04 * rate), half_up(HOP * rate)
    first, last = math.floor(rate / high), math.ceil(rate / low)
    if not n:
        return []
    level = np.sort(np.abs(x))[math.floor(0.95 * (n - 1))]
    out = []
    for at in range(0, n - size - last, hop):
        own = x[at : at + size]
        hz = None
        energy = float(own @ own)
        if np.abs(own).max() >= 0.1 * level and energy > 0:
            moved = np.lib.stride_tricks.sliding_window_view(x[at : at + size + last], size)[: last + 1]
            other = (moved * moved).sum(1)
            r = np.where(other > 0, moved @ own / np.sqrt(np.maximum(other, 1e-300) * energy), 0.0)
            r[:first] = 0
            if r.max() >= clear:
                peaks = (r >= keep * r.max()) & (r >= np.concatenate([[0], r[:-1]])) & (r >= np.concatenate([r[1:], [0]]))
                peaks[:first] = False
                if peaks.any():
                    hz = half_up(rate / int(np.argmax(peaks)) * 10) / 10
        out.append({"t": half_up((at + size / 2) / rate * 1000) / 1000, "hz": hz})
    return out


def semitones(track: list[dict], start: float = -math.inf, end: float = math.inf) -> list[float]:
    return [12 * math.log2(p["hz"] / 100) for p in track if p["hz"] and start <= p["t"] < end]


def _tenth(x: float) -> float:
    return half_up(x * 10) / 10


def end_contour(track: list[dict], move: float = 2.0) -> dict | None:
    """How the voice's last 0.15 seconds lie against the 0.35 seconds that end 0.2 before its end."""
    voiced = [p["t"] for p in track if p["hz"]]
    if not voiced:
        return None
    end = voiced[-1]
    tail, ref = semitones(track, end - 0.15, end + HOP), semitones(track, end - 0.55, end - 0.2)
    if min(len(tail), len(ref)) < 3:
        return None
    delta = _tenth(float(np.median(tail) - np.median(ref)))
    return {"end": end, "delta": delta, "direction": "rise" if delta >= move else "fall" if delta <= -move else "level"}


def word_contours(track: list[dict], words: list[tuple[str, float, float]], move: float = 1.5) -> list[dict]:
    """The shape of each word's pitch by the medians of its thirds."""
    out = []
    for w, a, b in words:
        v = semitones(track, a, b)
        if len(v) < 4:
            out.append({"w": w, "shape": "unvoiced"})
            continue
        k = max(1, len(v) // 3)
        first, mid, last = (_tenth(float(np.median(p))) for p in (v[:k], v[k : len(v) - k] or v, v[len(v) - k :]))
        up, down = mid - first, last - mid
        shape = "dipping" if up <= -move and down >= move else "peaking" if up >= move and down <= -move else "rising" if last - first >= move else "falling" if last - first <= -move else "level"
        out.append({"w": w, "shape": shape})
    return out


def pitch_summary(track: list[dict]) -> dict:
    v = sorted(semitones(track))
    if not v:
        return {"voiced": 0.0, "median_hz": None, "range": None}
    rank = lambda p: v[math.floor(p * (len(v) - 1))]
    return {"voiced": half_up(len(v) / len(track) * 1000) / 1000, "median_hz": _tenth(100 * 2 ** (float(np.median(v)) / 12)), "range": _tenth(rank(0.95) - rank(0.05))}


# loudness (ITU-R BS.1770)


def k_weight(x: np.ndarray, rate: int) -> np.ndarray:
    """The two filters of BS.1770, a high shelf and a high pass, from their analogue prototypes."""
    # fixed values of the recommendation: frequency, gain and quality of the shelf; frequency and quality of the high pass
    f, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, top = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    band, norm = top**0.4996667741545416, 1 + k / q + k * k
    x = _biquad(x, [(top + band * k / q + k * k) / norm, 2 * (k * k - top) / norm, (top - band * k / q + k * k) / norm], [2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm])
    f, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f / rate)
    norm = 1 + k / q + k * k
    return _biquad(x, [1.0, -2.0, 1.0], [2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm])


def _biquad(x: np.ndarray, b: list[float], a: list[float]) -> np.ndarray:
    p = np.concatenate([[0.0, 0.0], x.astype(np.float64)])
    forward = (b[0] * p[2:] + b[1] * p[1:-1] + b[2] * p[:-2]).tolist()
    y1 = y2 = 0.0
    out = []
    for v in forward:
        y1, y2 = v - a[0] * y1 - a[1] * y2, y1
        out.append(y1)
    return np.array(out)


def lufs(weighted: np.ndarray) -> float:
    ms = float(np.mean(weighted * weighted)) if len(weighted) else 0.0
    return max(SILENT, -0.691 + 10 * math.log10(ms)) if ms > 0 else SILENT


def short_levels(weighted: np.ndarray, rate: int, sec: float = 0.005) -> np.ndarray:
    win = max(1, half_up(rate * sec))
    n = len(weighted) // win
    ms = (weighted[: n * win].reshape(n, win) ** 2).mean(1)
    return np.maximum(SILENT, -0.691 + 10 * np.log10(np.maximum(ms, 1e-300)))


def line_loudness(weighted: np.ndarray, rate: int) -> float:
    """Energy mean of 100 ms blocks over -70, then over 10 below their mean."""
    blocks = short_levels(weighted, rate, 0.1)
    if not len(blocks):
        return lufs(weighted)
    mean = lambda v: -0.691 + 10 * math.log10(float(np.mean(10 ** ((v + 0.691) / 10))))
    loud = blocks[blocks > -70]
    if not len(loud):
        return SILENT
    kept = loud[loud > mean(loud) - 10]
    return mean(kept if len(kept) else loud)


def audible_floor(line: float, mask: float = -math.inf) -> float:
    return max(-65.0, line - 35.0, mask)


def edge_audibility(x: np.ndarray, rate: int, head_mask: float = -math.inf, tail_mask: float = -math.inf) -> dict | None:
    """Whether a clip begins abruptly or is cut at its end, from 5 ms levels against its loudness."""
    weighted = k_weight(x, rate)
    line = line_loudness(weighted, rate)
    if line <= SILENT:
        return None
    own = short_levels(weighted, rate)
    head = np.flatnonzero(own >= audible_floor(line, head_mask) + 10)
    tail = np.flatnonzero(own >= audible_floor(line, tail_mask) + 10)
    out = {"line": _tenth(line), "head_at": None, "abrupt": False, "tail_at": None, "cut": False}
    if len(head):
        k = int(head[0])
        out |= {"head_at": k * 0.005, "abrupt": k < 3 and float(own[k : k + 4].max()) - line > -15}
    if len(tail):
        k = int(tail[-1])
        out |= {"tail_at": (k + 1) * 0.005, "cut": float(own[max(0, k - 3) : k + 1].max()) - line > -5}
    return out


# defects of a take


def defects(x: np.ndarray, rate: int) -> dict | None:
    """Head, dips and pauses of the voiced part of a clip; None for a silent one."""
    win = max(1, half_up(rate * HOP))
    own = levels(x, win, part=False)
    if not len(own):
        return None
    db = np.where(own > 0, 20 * np.log10(np.maximum(own, 1e-300)), SILENT)
    top = float(np.sort(db)[math.floor(0.95 * (len(db) - 1))])
    voiced = np.flatnonzero(db >= max(-50.0, top - 30))
    if top <= -50 or not len(voiced):
        return None
    a, b = int(voiced[0]), int(voiced[-1])
    inner = db[a : b + 1]
    mid = float(np.median(inner[inner > -50]))
    head = float(inner[:15].max())
    found = [(s, n) for s, n in _runs((inner > -50) & (inner <= mid - 15), 15) if s >= 15 and s + n + 15 <= len(inner) and inner[s - 15 : s].max() > mid - 15 and inner[s + n : s + n + 15].max() > mid - 15]
    sec = lambda runs: [{"at": half_up((a + s) * HOP * 1000) / 1000, "sec": half_up(n * HOP * 1000) / 1000} for s, n in runs]
    return {"abrupt": float(inner[0]) >= top - 9, "weak": head < top - 18, "dips": sec(found), "pauses": sec(_runs(inner <= -50, 35)), "edges": edge_audibility(x, rate)}


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= least]


def take_flag(end_cut: dict | None, edges: dict | None) -> str | None:
    """The gravest fault: an end that only the clip lost, a cut tail, a lost end, an abrupt head."""
    if end_cut and end_cut.get("cut") and not end_cut.get("raw_cut"):
        return "end cut"
    if edges and edges["cut"]:
        return "tail"
    if end_cut and end_cut.get("cut"):
        return "end cut"
    return "head" if edges and edges["abrupt"] else None


def open_spans(env: list[float], step: float, threshold: float = 0.15, least: float = 0.06, closed: float = 0.05) -> list[dict]:
    """Spans of an envelope over a share of its 95th percentile: short closures inside are bridged, short spans dropped."""
    v = np.asarray(env, float)
    ref = np.sort(v)[min(len(v) - 1, math.floor(len(v) * 0.95))] if len(v) else 0.0
    if ref <= 0:
        return []
    level = np.minimum(1, v / ref)
    up = level >= threshold
    for s, n in _runs(~up, 1):
        if s and s + n < len(up) and n < closed / step:
            up[s : s + n] = True
    ms = lambda t: half_up(t * 1000) / 1000
    return [{"from": ms(s * step), "to": ms((s + n) * step), "open": ms(float(level[s : s + n].mean()))} for s, n in _runs(up, 1) if n * step >= least]


# edits


def quiet_spans(x: np.ndarray, rate: int, db: float = -50.0) -> list[dict]:
    """Quiet spans, those at the ends too, each with its quietest sample."""
    win = max(1, half_up(rate * HOP))
    out = []
    for s, n in _runs(levels(x, win) <= 10 ** (db / 20), 1):
        a, b = s * win, min(len(x), (s + n) * win)
        out.append({"from": a / rate, "to": b / rate, "quietest": (a + int(np.abs(x[a:b]).argmin())) / rate})
    return out


def checked_pauses(pauses: list[dict], x: np.ndarray, rate: int, db: float = -50.0) -> list[tuple[int, int, int]]:
    """Pauses (start, end, duration in seconds) in samples, in order; ValueError unless they are apart, inside and quiet."""
    out, before = [], 0
    for p in sorted(pauses, key=lambda p: p["start"]):
        if set(p) - {"start", "end", "duration"}:
            raise ValueError("a pause has start, end and duration")
        if not all(isinstance(p[k], (int, float)) and math.isfinite(p[k]) and p[k] >= 0 for k in ("start", "end", "duration")):
            raise ValueError("times are finite and not negative")
        a, b, n = (half_up(p[k] * rate) for k in ("start", "end", "duration"))
        if p["end"] > len(x) / rate or b <= a:
            raise ValueError("a pause is empty or outside the clip")
        if a < before:
            raise ValueError("pauses overlap")
        if np.abs(x[a:b]).max(initial=0.0) > 10 ** (db / 20):
            raise ValueError("a pause isn't quiet")
        out.append((a, b, n))
        before = b
    return out


def edit_pcm(x: np.ndarray, rate: int, pauses: list[dict]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Quiet spans replaced by silence of another length, and the map (from, to, new from, new to) in samples."""
    parts, pieces, at, done = [], [], 0, 0
    for a, b, n in checked_pauses(pauses, x, rate):
        parts += [x[at:a], np.zeros(n, x.dtype)]
        done += a - at
        pieces.append((a, b, done, done + n))
        done, at = done + n, b
    return np.concatenate([*parts, x[at:]]), pieces


def map_frame(frame: float, pieces: list[tuple[int, int, int, int]]) -> float:
    """Where a sample is after the edit."""
    k = int(np.searchsorted([p[0] for p in pieces], frame, side="right")) - 1
    if k < 0:
        return frame
    a, b, c, d = pieces[k]
    return c + (frame - a) * (d - c) / (b - a) if frame < b else d + frame - b


def splice(base: np.ndarray, new: np.ndarray, start: int, rate: int, fade: float = 0.02) -> np.ndarray:
    """A span replaced, with crossfades of equal power at both ends."""
    n = half_up(fade * rate)
    if start < 0 or start + len(new) > len(base):
        raise ValueError("the span is outside the clip")
    if len(new) < 2 * n:
        raise ValueError("the span is shorter than two crossfades")
    wet = np.ones(len(new))
    if n:
        wet[:n] = np.arange(n) / n
        wet[len(new) - n :] = np.arange(n)[::-1] / n
    out = base.astype(np.float64)
    span = slice(start, start + len(new))
    out[span] = new * np.sin(wet * np.pi / 2) + out[span] * np.cos(wet * np.pi / 2)
    return out.astype(base.dtype)


def insert_silence(x: np.ndarray, at: int, count: int) -> np.ndarray:
    return np.concatenate([x[:at], np.zeros(count, x.dtype), x[at:]])
