"""Series as streams: windowed figures, first full windows of runs, evidence linked as it arrives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "5 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean and spread of value by window and event type; rows later than the delay are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = _timed(events).withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "std")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Visits of users, divided by pauses."""
    out = _timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


def first_windows(events: DataFrame, size: int) -> DataFrame:
    """The first `size` values of each run, as one row when the run has so many; what comes after is not kept.

    State of a run: its values so far, at most `size`, or the mark that it is done.
    """

    def step(key, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        if state.exists and len(held) == 0:
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        held = (held + rows["value"].astype(float).tolist())[:size]
        if len(held) < size:
            state.update((held,))
            return
        state.update(([],))
        yield pd.DataFrame([(key[0], key[1], sum(held) / size, held)], columns=["event_type", "user_id", "mean", "values"])

    return events.groupBy("event_type", "user_id").applyInPandasWithState(
        step, "event_type string, user_id long, mean double, values array<double>", "values array<double>", "append", GroupStateTimeout.NoTimeout
    )


def link_stream(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """Mentions as they arrive with the nodes that have them as an exact term: a join of the stream with the graph."""
    seen = terms.select(F.col("key").alias("mention_key"), "id", "label", "scenario", "ord")
    return mentions.join(seen, "mention_key").where("scenario in (dataset, 'shared')").drop("scenario")
