"""Structured Streaming: landed frames as a source, the ordered mapping fold as a stateful sink, snapshots and replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mapping import BOX, SceneMap


def landed_frames(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Frames that a capture process lands as Parquet files, as a stream in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


STATE = "next bigint, frames bigint, width int, ids array<bigint>, weights array<double>, features array<double>, boxes array<double>, last bigint"


def _load(m: SceneMap, s: tuple) -> SceneMap:
    m.next, m.frames, width, ids, weights, features, boxes = s
    m.ids, m.weight = list(ids), np.array(weights, float)
    m.feature, m.box = np.array(features, float).reshape(len(m.ids), width), np.array(boxes, float).reshape(len(m.ids), 6)
    return m


def map_stream(dets: DataFrame, scene: str, frame: str, det: str, feature: str, threshold: float, bias: float = 0.0, maintain: int = 0) -> DataFrame:
    """(scene, frame, det, object) of a stream of detections (batch frames too). The state per scene is its map; frames of a
    micro-batch are folded in order, and a frame must arrive whole within one micro-batch: one of whole-numbered frames that is not after
    all earlier ones stops the query, as folding it late would silently give another map. Equal to
    :func:`orbweave.operators.mapping.map_scenes` on the same frames."""
    kind = {f.name: f.dataType.simpleString() for f in dets.schema}
    whole = kind[frame] in ("tinyint", "smallint", "int", "bigint")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = SceneMap(threshold, bias, maintain)
        last = None
        if state.exists:
            *saved, last = state.get
            _load(m, tuple(saved))
        rows = pd.concat(list(parts)).sort_values([frame, det])
        if whole:
            if last is not None and int(rows[frame].iloc[0]) <= last:
                raise ValueError(f"frame {rows[frame].iloc[0]} of scene {key[0]} came after frame {last}")
            last = int(rows[frame].iloc[-1])
        for f, part in rows.groupby(frame, sort=True):
            ids = m.add(np.array(part[feature].tolist(), float), part[BOX].to_numpy(float))
            yield pd.DataFrame({scene: key[0], frame: f, det: part[det], "object": ids})
        width = m.feature.shape[1] if len(m.ids) else 0
        state.update((m.next, m.frames, width, [int(i) for i in m.ids], m.weight.tolist(), m.feature.ravel().tolist(), m.box.ravel().tolist(), last))

    out = f"{scene} {kind[scene]}, {frame} {kind[frame]}, {det} {kind[det]}, object bigint"
    return dets.groupBy(scene).applyInPandasWithState(fold, out, STATE, "append", GroupStateTimeout.NoTimeout)


def capture(stream: DataFrame, folder: str, checkpoint: str, every: Callable[[DataFrame, int], None] | None = None):
    """Append a stream's rows to a Parquet folder, partitioned by batch, once each: a batch that is repeated overwrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if every:
            every(df, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, folder: str, order: list[str]) -> DataFrame:
    """Captured rows in order, for inspection frame by frame."""
    return spark.read.parquet(folder).orderBy(*(F.col(o) for o in order))
