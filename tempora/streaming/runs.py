"""Runs of flagged frames found as they come: black or still frames of many clips at once.

A clip's state is a handful of numbers: where its open run began and the last frame.  Frames of a clip
come in order; a frame that was seen before (a batch that is tried again) is passed over.  A run is
given out when it ends, or when the clip's last frame (``done``) comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "since long, last long"
RUNS = "clip string, frame_from long, frame_to long, seconds double"


def flag_runs(frames: DataFrame, fps: float, least: float) -> DataFrame:
    """Runs of frames (clip, frame, flag, done) of at least ``least`` seconds, from a stream or a table."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(batches), ignore_index=True).drop_duplicates("frame").sort_values("frame")
        out = []

        def close(end: int) -> None:
            if since >= 0 and (end - since) / fps >= least - 1e-9:
                out.append((key[0], since, end, (end - since) / fps))

        done = False
        for frame, flag, ends in zip(rows["frame"].tolist(), rows["flag"].tolist(), rows["done"].tolist(), strict=True):
            if frame <= last:
                continue
            if not flag or (since >= 0 and frame != last + 1):
                close(last + 1)
                since = -1
            if flag and since < 0:
                since = frame
            last, done = frame, done or bool(ends)
        if done:
            close(last + 1)
            state.remove()
        else:
            state.update((since, last))
        yield pd.DataFrame(out, columns=["clip", "frame_from", "frame_to", "seconds"])

    rows = frames.select("clip", "frame", "flag", "done")
    return rows.groupBy("clip").applyInPandasWithState(step, RUNS, STATE, "append", GroupStateTimeout.NoTimeout)


def black_runs(frames: DataFrame, fps: float, least: float = 0.1, most: int = 25, share: float = 0.98) -> DataFrame:
    """Runs of black frames (clip, frame, gray, done)."""
    from tempora.operators.frames import is_black

    return flag_runs(frames.withColumn("flag", is_black(frames["gray"], most, share)), fps, least)


FREEZE = "since long, last long, gray array<float>"


def freeze_runs(frames: DataFrame, fps: float, least: float = 0.8, above: float = 6, share: float = 0.002) -> DataFrame:
    """Runs of frames (clip, frame, gray, done) that stay as they are, pair by pair: the state holds one frame."""
    import numpy as np

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, gray = state.get if state.exists else (-1, -1, None)
        before = None if gray is None else np.asarray(gray, np.float32)
        rows = pd.concat(list(batches), ignore_index=True).drop_duplicates("frame").sort_values("frame")
        out, done = [], False

        def close(end: int) -> None:
            if since >= 0 and (end - since) / fps >= least - 1e-9:
                out.append((key[0], since, end, (end - since) / fps))

        for frame, pixels, ends in zip(rows["frame"].tolist(), rows["gray"], rows["done"].tolist(), strict=True):
            if frame <= last:
                continue
            now = np.asarray(pixels, np.float32)
            still = before is not None and frame == last + 1 and np.mean(np.abs(now - before) > above) < share
            if still and since < 0:
                since = last
            if not still:
                close(last)
                since = -1
            before, last, done = now, frame, done or bool(ends)
        if done:
            close(last)
            state.remove()
        else:
            state.update((since, last, None if before is None else before.tolist()))
        yield pd.DataFrame(out, columns=["clip", "frame_from", "frame_to", "seconds"])

    rows = frames.select("clip", "frame", "gray", "done")
    return rows.groupBy("clip").applyInPandasWithState(step, RUNS, FREEZE, "append", GroupStateTimeout.NoTimeout)
