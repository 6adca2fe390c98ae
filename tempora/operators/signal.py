"""Measures of clips in columns: each row's samples are read once, in Arrow batches of few rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tempora.functions import signal
from tempora.functions.session import prepare

FEATURES = "duration double, peak_db double, attack_ms double, brightness_hz double, pitch_trend string, noisiness double"
TRACK = "array<struct<t:double,hz:double>>"
EDGES = "struct<line:double,head_at:double,abrupt:boolean,tail_at:double,cut:boolean>"
RUNS = "array<struct<at:double,sec:double>>"
DEFECTS = f"struct<abrupt:boolean,weak:boolean,dips:{RUNS},pauses:{RUNS},edges:{EDGES}>"
CUTS = "array<struct<id:string,edge:string,at:double,edge_db:double,body_db:double>>"
WORDS = "array<struct<w:string,start:double,end:double>>"


def measured(clips: DataFrame, f: Callable, name: str, kind: str, samples: str = "samples", rate: str = "rate", *more: str, keep: bool = False) -> DataFrame:
    """Clips with f(samples as an array, rate, further columns) as a column; the samples are dropped unless ``keep``.

    Null samples give null; a column that has the name already is replaced."""
    prepare(clips.sparkSession)
    columns = [c for c in clips.columns if (keep or c != samples) and c != name]
    kinds = dict(clips.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` {kind}"])
    arrow = to_arrow_type(StructType.fromDDL(f"`{name}` {kind}")[0].dataType)
    source, rates, others = clips.columns.index(samples), clips.columns.index(rate), [clips.columns.index(c) for c in more]
    kept = [clips.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for k in range(part.num_rows):
                    x = part.column(source)[k]
                    values = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) if x.is_valid else None
                    out.append(None if values is None else f(values, part.column(rates)[k].as_py(), *(part.column(j)[k].as_py() for j in others)))
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in kept), pa.array(out, arrow)], names=[*columns, name])

    return clips.mapInArrow(run, schema)


def features(clips: DataFrame) -> DataFrame:
    """Duration, peak, attack, spectral centroid and flatness, and trend of pitch."""
    return measured(clips, signal.features, "features", f"struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>")


def pitch(clips: DataFrame) -> DataFrame:
    return measured(clips, signal.pitch_track, "track", TRACK)


def loudness(clips: DataFrame) -> DataFrame:
    """Gated loudness of the weighted samples."""
    return measured(clips, lambda x, rate: signal.line_loudness(signal.k_weight(x, rate), rate), "lufs", "double")


def take_defects(clips: DataFrame) -> DataFrame:
    return measured(clips, signal.defects, "defects", DEFECTS)


def edges(clips: DataFrame) -> DataFrame:
    return measured(clips, signal.edge_audibility, "edges", EDGES)


def waveform_cuts(clips: DataFrame, spans: str | None = None) -> DataFrame:
    """Abrupt edges of spans (array<struct<id, start, end>>), or steps of level anywhere."""
    if spans is None:
        return measured(clips, signal.step_cuts, "cuts", CUTS)
    return measured(clips, lambda x, rate, s: signal.span_cuts(x, rate, [(p["id"], p["start"], p["end"]) for p in s or []]), "cuts", CUTS, "samples", "rate", spans)


def onset_offsets(clips: DataFrame, mark: str = "mark") -> DataFrame:
    return measured(clips, signal.onset_offset_ms, "offset_ms", "int", "samples", "rate", mark)


def _words(f: Callable) -> Callable:
    names = ("w", "start", "end")
    return lambda x, rate, words: [dict(zip(names, w, strict=True)) for w in f([(w["w"], w["start"], w["end"]) for w in words or []], x, rate)]


def trimmed_words(clips: DataFrame, words: str = "words") -> DataFrame:
    return measured(clips, _words(signal.trim_words), "trimmed", WORDS, "samples", "rate", words)


def snapped_words(clips: DataFrame, words: str = "words") -> DataFrame:
    return measured(clips, _words(signal.snap_starts), "snapped", WORDS, "samples", "rate", words)


def word_onsets(clips: DataFrame, words: str = "words") -> DataFrame:
    """words: array<struct<line, index, start>>."""
    return measured(clips, lambda x, rate, w: signal.word_onsets(w or [], x, rate), "onsets", "array<struct<line:string,index:int,onset:double,offset:double,status:string>>", "samples", "rate", words)


def mouth_spans(clips: DataFrame, step: float = 0.04) -> DataFrame:
    def run(x: np.ndarray, rate: int) -> list[dict]:
        return signal.open_spans(signal.levels(x, max(1, signal.half_up(rate * step))).tolist(), step)

    return measured(clips, run, "spans", "array<struct<`from`:double,`to`:double,open:double>>")


def quiet_spans(clips: DataFrame) -> DataFrame:
    return measured(clips, signal.quiet_spans, "quiet", "array<struct<`from`:double,`to`:double,quietest:double>>")
