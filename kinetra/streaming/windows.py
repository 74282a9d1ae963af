"""Sliding windows over an unbounded signal (an extension: the batch library has none)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def time_windows(stream: DataFrame, size: str, slide: str, late: str, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Mean and count of value in event-time windows; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", size, slide).alias("w")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "mean", "n")


def count_windows(stream: DataFrame, width: int, step: int) -> DataFrame:
    """Windows of exactly `width` samples each `step` samples, a user's samples in order of arrival of their batches.

    State: the samples that a window to come still needs, width at most, and how many have been seen.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for value in rows["value"].tolist():
            held.append(float(value))
            seen += 1
            if len(held) > width:
                held.pop(0)
            if seen >= width and (seen - width) % step == 0:
                out.append(((seen - width) // step, sum(held) / width))
        state.update((held, seen))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "window_id": [o[0] for o in out], "mean": [o[1] for o in out]})

    return stream.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, window_id bigint, mean double", "held array<double>, seen bigint", "append", GroupStateTimeout.NoTimeout)
