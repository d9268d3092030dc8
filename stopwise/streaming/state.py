"""Live state as structured streams.

Deltas are rows (feed_id, kind, key, ts, generation, payload). A keyed state keeps the last row of each key for a time to live;
a full snapshot raises its feed's generation and so replaces what came before. Caps are global and are applied to the published
table, not to keyed state. Time comes from the rows, never from the clock.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

STATE = "feed_id string, kind string, key string, ts timestamp, generation long, payload string, gone boolean"
#: Seconds after which an entry that was not seen again goes, and how many stay at most, by kind.
TTL_S = {"trip": 7_200, "vehicle": 900, "alert": 21_600}
WATCHED = 32
CAPS = {"trip": 100_000, "vehicle": 50_000, "alert": 10_000}


class Latest(StatefulProcessor):
    """Last delta of each (feed_id, kind, key) in arrival order; an event-time timer announces its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, generation long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        if self.last.exists():
            ts, generation, payload = self.last.get()
            frame = pd.concat([pd.DataFrame([{"ts": ts, "generation": generation, "payload": payload}]), frame])
        frame = frame.sort_values(["generation", "ts"], kind="stable")
        top = frame.iloc[-1]
        at = pd.Timestamp(top["ts"])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(at.timestamp() * 1000) + TTL_S.get(key[1], 7_200) * 1000)
        self.last.update((at.to_pydatetime(), int(top["generation"]), top["payload"]))
        yield pd.DataFrame({"feed_id": [key[0]], "kind": [key[1]], "key": [key[2]], "ts": [at], "generation": [int(top["generation"])], "payload": [top["payload"]], "gone": [False]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            ts, generation, payload = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"feed_id": [key[0]], "kind": [key[1]], "key": [key[2]], "ts": [pd.Timestamp(ts)], "generation": [int(generation)], "payload": [payload], "gone": [True]})

    def close(self) -> None:
        pass


def upserts(deltas: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes of the state: a row for each key that a batch touched, and one with ``gone`` when its time is over."""
    ship(deltas.sparkSession)
    rows = deltas.withWatermark("ts", delay).groupBy("feed_id", "kind", "key")
    return rows.transformWithStateInPandas(statefulProcessor=Latest(), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def live_view(changes: DataFrame) -> DataFrame:
    """The published table of accumulated changes: last word of each key, older generations and ended keys out, caps applied."""
    last = changes.groupBy("feed_id", "kind", "key").agg(F.max_by(F.struct("ts", "generation", "payload", "gone"), F.struct("generation", "ts", "gone")).alias("x")).select("feed_id", "kind", "key", "x.*")
    newest = F.max("generation").over(W.partitionBy("feed_id", "kind"))
    last = last.withColumn("newest", newest).where("generation = newest and not gone").drop("newest", "gone")
    cap = F.create_map(*(F.lit(x) for pair in CAPS.items() for x in pair))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("ts"), "feed_id", "key"))
    return last.withColumn("n", rank).where(F.col("n") <= F.coalesce(F.try_element_at(cap, F.col("kind")), F.lit(100_000))).drop("n")


def publish(changes: DataFrame, folder: str, then: Callable[[DataFrame, int], None] | None = None):
    """Append each batch's changes under its number, which is the version readers ask for; repeated batches overwrite themselves."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={version}")
        if then:
            then(batch, version)

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/_progress")


def changed(changes: DataFrame, watched: list[str]) -> DataFrame:
    """Changes of the watched keys only, as a subscription sees them; more than ``WATCHED`` keys are refused."""
    if len(watched) > WATCHED:
        raise ValueError(f"a subscription watches {WATCHED} keys at most")
    return changes.where(F.col("key").isin(*watched))


def delays_by_window(updates: DataFrame, length: str = "15 minutes", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(feed_id, start, updates, mean_delay_s) in sliding windows with late rows up to ``delay``."""
    rows = updates.withWatermark("ts", delay).groupBy("feed_id", F.window("ts", length, slide))
    return rows.agg(F.count("*").alias("updates"), F.round(F.avg("delay_s"), 3).alias("mean_delay_s")).select("feed_id", F.col("window.start").alias("start"), "updates", "mean_delay_s")


def deduplicated_alerts(alerts: DataFrame, delay: str = "6 hours") -> DataFrame:
    """The first alert of each merge key within the watermark."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["feed_id", "merge_key"])
