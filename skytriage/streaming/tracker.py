"""Online tracking: the frame fold with its state kept per video (K1)."""

from __future__ import annotations

import json
from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skytriage.operators.association import FrameTracker, TrackerConfig

OUT = ("source_video {video}, track_id bigint, frame_index bigint, x1 double, y1 double, x2 double, y2 double, score double")
_ROW = "frame_index bigint, ts_ms bigint, det_index bigint, x1 double, y1 double, x2 double, y2 double, score double"
_COLS = ["frame_index", "ts_ms", "det_index", "x1", "y1", "x2", "y2", "score"]


class OnlineTracker(StatefulProcessor):
    """Buffers frames until the watermark has passed them, then folds them in order.

    State per video: the tracks alive and the frames still waiting, both bounded by the
    age limit and the watermark delay. Rows behind the watermark are counted and left
    out. A video that stays silent for ``idle_ms`` is closed; only its track counter is kept, so
    that numbers are never given twice.
    """

    def __init__(self, config: TrackerConfig, idle_ms: int) -> None:
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "blob string, last_ms bigint, late bigint")
        self.waiting = handle.getListState("waiting", _ROW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        blob, last, late = self.tracker.get() if self.tracker.exists() else ("", 0, 0)
        newest = 0
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64") if pdf["ts"].dt.tz is None else pdf["ts"].dt.tz_convert(None).astype("datetime64[ms]").astype("int64")
            pdf = pdf.assign(ts_ms=ms)
            late += int((ms < mark).sum())
            fresh = pdf[ms >= mark]
            if len(fresh):
                self.waiting.appendList([tuple(r) for r in fresh[_COLS].astype(object).where(fresh[_COLS].notna(), None).itertuples(index=False)])
                newest = max(newest, int(fresh["ts_ms"].max()))
        if newest:
            self.handle.registerTimer(newest + 1)
            self.handle.registerTimer(newest + self.idle_ms)
        self.tracker.update((blob, max(last, newest), late))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if not self.tracker.exists():
            yield pd.DataFrame()
            return
        blob, last, late = self.tracker.get()
        rows = pd.DataFrame(list(self.waiting.get()), columns=_COLS)
        due = rows[rows["ts_ms"] < mark]
        tracker = FrameTracker.restore(self.config, json.loads(blob)) if blob else FrameTracker(self.config)
        out = []
        for frame, pdf in due.sort_values(["frame_index", "det_index"], na_position="first").groupby("frame_index", sort=True):
            seen = pdf[pdf["score"].notna()]
            boxes, scores = seen[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), seen["score"].to_numpy(dtype=float)
            sure = tracker.step(np.zeros(len(seen), dtype=np.int64), boxes, scores, np.full((len(seen), 1), int(frame)))
            if sure is not None:
                _, numbers, (frames,), boxes, scores = sure[0], sure[1], sure[2].T, sure[3], sure[4]
                out += zip(numbers.tolist(), frames.tolist(), *boxes.T.tolist(), scores.tolist())
        rest = rows[rows["ts_ms"] >= mark]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.astype(object).where(rest.notna(), None).itertuples(index=False)])
        if expiredTimerInfo.getExpiryTimeInMs() >= last + self.idle_ms and not len(rest):
            count, tracker = tracker.spawned, FrameTracker(self.config)
            tracker.spawned = count
        self.tracker.update((json.dumps(tracker.state()), last, late))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["source_video", "track_id", "frame_index", "x1", "y1", "x2", "y2", "score"])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_tracks(det: DataFrame, config: TrackerConfig = TrackerConfig(), delay: str = "10 seconds", idle_seconds: int = 3600) -> DataFrame:
    """Confirmed observations as they become certain.

    ``det`` has ``source_video, ts, frame_index, det_index``, a box and a score; a frame
    without detections is a row with a null score. Needs the RocksDB state store.
    """
    spark = det.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return (
        det.withWatermark("ts", delay).groupBy("source_video")
        .transformWithStateInPandas(OnlineTracker(config, idle_seconds * 1000), OUT.format(video=dict(det.dtypes)["source_video"]), "append", "eventTime"))
