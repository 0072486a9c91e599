"""Navigation as a stream: keyed session state, exactly-once events, watermarked counts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.navigation import Episode, World, step

OUT = "session string, turn int, event string, valid boolean, new_ids array<string>, selected int, stopped boolean"


def session_events(actions: DataFrame, world: dict[str, World] | None = None, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """One row per action of a stream (session string, ts timestamp, action string), with the state of its session kept.

    Actions of one micro-batch are taken in the order of ts. A session that is idle longer than the timeout is dropped; a
    run over a bounded source must have no timeout (None), since waiting for timeouts it would never end.
    ``world`` is what sessions can find; sessions that are not in it see nothing.
    """
    worlds = world or {}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        episode = Episode(**json.loads(state.get[0])) if state.exists else Episode()
        w = worlds.get(key[0], World([], {}, {}))
        rows = []
        for action in pd.concat(list(batches)).sort_values("ts", kind="stable")["action"]:
            out = step(episode, action or "", w)
            rows.append((key[0], episode.counts.get("valid_action_id_count", 0) + episode.counts.get("invalid_action_count", 0), out["event"], out["valid"], out["new"], len(episode.selected), episode.stopped))
        state.update((json.dumps(asdict(episode)),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["session", "turn", "event", "valid", "new_ids", "selected", "stopped"])

    return actions.groupBy("session").applyInPandasWithState(run, OUT, "episode string", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) per tumbling window; rows later than the watermark are left out of a stream."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind)
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def once(events: DataFrame, key: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Every event once, however often it is delivered within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data there is into a Parquet table (complete mode: as the last batch leaves it) and read it."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)
