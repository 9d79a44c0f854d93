"""Structured Streaming forms: saturation by arriving scan, windows over events, and a forward tracker."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import boxes
from ..operators.boxes import Tracker
from ..operators.voxels import sw_series
from ..scratch import table_path


def windowed_mean(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and mean value in tumbling event-time windows. In append and update mode rows later than the watermark are left out;
    in complete mode, where all windows are kept, none is."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), "n", "mean_value")


def final_state(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return the complete result table, read back from the shared folder: each batch
    writes the table anew, from the executors."""
    spark, path, written = stream.sparkSession, table_path(stream.sparkSession, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        written.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/{written[-1]}")


def latest_rows(stream: DataFrame, keys: list[str], conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream in update mode over what is there now and return the last version of each key's row.

    Each batch writes the rows that changed into a folder of its own, which a repeated batch writes anew."""
    spark, path, written = stream.sparkSession, table_path(stream.sparkSession, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")
        written.append(number)

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not written:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch long").parquet(path)
    last = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*").select(*stream.columns)


def arriving_saturation(runs: DataFrame) -> DataFrame:
    """Gas, brine and saturation of each scan of a stream of runs, brought up to date by every batch.

    The state of a scan is two sums, which merge whatever order its runs come in: a scan may arrive in pieces, late, and
    between the pieces of others. Each run counts once; a file is read once."""
    return sw_series(runs)


def stream_saturation(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Saturation of each scan whose runs arrive in ``folder`` as Parquet: every batch writes the scans that changed to a folder of its
    own below ``target``, the greatest batch number holding a scan's latest row; a repeated batch overwrites its own."""
    schema = "scan_index int, z int, y int, x0 int, x1 int, label int"
    runs = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving_saturation(runs).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "tracks array<struct<id:int,status:string,first:int,last:int,seen:int,lost:int,n:bigint,z:double,y:double,x:double>>"
OUT = "series string, scan_index int, label_id int, track_id int"


def stream_tracks(clusters: DataFrame, distance: float = 1000.0) -> DataFrame:
    """Forward tracks of clusters(series, scan_index, label_id, n, cog_z, cog_y, cog_x) that arrive scan by scan.

    State per series: its tracks, no more than clusters were ever seeded. New tracks are made in the first scan only, since a
    stream has no last one. Clusters of a scan have to arrive together."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, fresh = Tracker(distance), not state.exists
        if state.exists:
            for t in state.get[0]:
                tracker.tracks[t[0]] = {"status": t[1], "first_seen": t[2], "last_seen": t[3], "timesteps_seen": t[4], "timesteps_lost": t[5], "final_voxels": t[6], "cog": list(t[7:10])}
        pdf = pd.concat(list(frames)).sort_values(["scan_index", "label_id"])
        out = []
        for scan, part in pdf.groupby("scan_index"):
            got = tracker.step(int(scan), list(part[["n", "cog_z", "cog_y", "cog_x"]].itertuples(index=False, name=None)), fresh)
            fresh = False
            out += [(key[0], int(scan), int(label), track) for label, track in zip(part["label_id"], got, strict=True)]
        state.update(([(t, s["status"], s["first_seen"], s["last_seen"], s["timesteps_seen"], s["timesteps_lost"], int(s["final_voxels"]), *map(float, s["cog"])) for t, s in tracker.tracks.items()],))
        yield pd.DataFrame(out, columns=["series", "scan_index", "label_id", "track_id"]).astype({"track_id": "Int32"})

    return clusters.groupBy("series").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: Where typed state lives.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ACTIVE = "last_seen int, seen int, first_seen int, n bigint, cog_z double, cog_y double, cog_x double"
TRACK = "series string, track_id int, status string, first_seen int, last_seen int, timesteps_seen int, timesteps_lost int, final_voxels bigint, cog_z double, cog_y double, cog_x double"


class TrackState(StatefulProcessor):
    """Forward tracks of one series at a time. State: a map of the tracks that are still followed and the last scan; a lost track
    is told once and leaves the state, and with ``days`` what nothing came for in so many days expires."""

    def __init__(self, distance: float, days: int | None):
        self.distance, self.life = distance, days and days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id int", ACTIVE, self.life)
        self.last = handle.getValueState("last", "scan_index int", self.life)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["scan_index", "label_id"])
        known = self.last.get()[0] if self.last.exists() else None
        tracker, first = Tracker(self.distance), known is None
        for (t,), (last, seen, begun, n, *cog) in self.tracks.iterator():
            tracker.tracks[t] = {"status": "active", "first_seen": begun, "last_seen": last, "timesteps_seen": seen, "timesteps_lost": 0, "final_voxels": n, "cog": cog}
        held = set(tracker.tracks)
        for scan, part in frame.groupby("scan_index"):
            if known is None or scan > known:  # an earlier scan comes too late to be tracked
                tracker.step(int(scan), list(part[["n", "cog_z", "cog_y", "cog_x"]].itertuples(index=False, name=None)), first)
                known, first = int(scan), False
        self.last.update((known,))
        out = []
        for t, s in tracker.tracks.items():
            if s["status"] == "active":
                self.tracks.updateValue((t,), (s["last_seen"], s["timesteps_seen"], s["first_seen"], int(s["final_voxels"]), *map(float, s["cog"])))
            elif t in held:
                self.tracks.removeKey((t,))
            out.append((key[0], t, s["status"], s["first_seen"], s["last_seen"], s["timesteps_seen"], s["timesteps_lost"], int(s["final_voxels"]), *map(float, s["cog"])))
        columns = [c.split()[0] for c in TRACK.split(", ")]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def arriving_tracks(clusters: DataFrame, distance: float = 1000.0, days: int | None = None) -> DataFrame:
    """Tracks of a stream of clusters(series, scan_index, label_id, n, cog_z, cog_y, cog_x), a row for every track that a batch
    followed. Scans arrive in order and each in one batch, which may hold several; new tracks begin in a series' first scan.
    Needs the state store of ``ROCKS``. Expiry (``days``) goes by the clock, so it is for streams that go on; a run over what is there
    would never end with it."""
    carried = (sys.modules[__name__], boxes)  # by value: the driver's helper of the state store starts without the program's search path
    for module in carried:
        cloudpickle.register_pickle_by_value(module)
    try:
        return clusters.groupBy("series").transformWithStateInPandas(TrackState(distance, days), TRACK, "update", "processingTime" if days else "none")
    finally:
        for module in carried:
            cloudpickle.unregister_pickle_by_value(module)
