"""The map as keyed state on a stream: objects get ids, are fused, merged and deleted in the order of event time.

Events (scene, seq, ts, kind, track, other, x, y, z, weight) may come in any order within the watermark's delay.  A scene keeps those that
may still be overtaken, and one timer for the first of them; when the watermark has passed it, all that are due are
applied in the order of (ts, seq) and the objects that changed are put out.  So the map depends on the events alone, not on how
they arrive or are cut into batches.  Events behind the watermark are dropped.

``seen``: a track's object takes in a position; a track that is new, or whose object was deleted, gets the next id.  ``merge``: of the two tracks' objects the one with the
smaller id takes in the other, which stays as a row that isn't active and names its winner; both tracks then lead to it.  ``gone``: the object is
deleted softly, its track forgotten.  ``end`` changes nothing; as the last event of all it lets the watermark pass the others.

The state of a scene is its objects, tracks and waiting events, in the state store and not in memory: a call reads the objects it needs.  Events wait in
chunks, one for each batch of rows that came, so that they are no calls of the store by themselves; a call reads the chunks that hold events that are due.  Changes are
written by batch under a folder, a batch that is run again replaces itself, and ``compact`` joins them into one snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "scene string, seq long, ts timestamp, kind string, track string, other string, x double, y double, z double, weight double"
OBJECTS = "scene string, object_idx long, at long, seq long, x double, y double, z double, weight double, n long, active boolean, redirect long"
_OBJECT = "x double, y double, z double, weight double, n long, active boolean, redirect long"
_TEXTS, _NUMBERS = ("kind", "track", "other"), {"x": 0.0, "y": 0.0, "z": 0.0, "weight": 1.0}
#: Events that are applied, and changed objects that are put out, at once.
SLICE = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rules:
    """What an event does to a scene; ``objects`` and ``tracks`` are mappings, lists of values by id and ids by track."""

    def __init__(self, objects: Any, tracks: Any, following: int):
        self.objects, self.tracks, self.following = objects, tracks, following
        self.changed: dict[int, tuple[int, int]] = {}

    def _end(self, i: int) -> int:
        at = i
        while (to := self.objects[at][6]) is not None:
            at = to
        return at

    def _of(self, track: str | None) -> int | None:
        """The track's active object; its pointer is moved on to the winner."""
        i = self.tracks.get(track)
        if i is None:
            return None
        end = self._end(i)
        if not self.objects[end][5]:
            return None
        if end != i:
            self.tracks[track] = end
        return end

    def _put(self, i: int, value: list, when: tuple[int, int]) -> None:
        self.objects[i] = value
        self.changed[i] = when

    def apply(self, when: tuple[int, int], kind: str, track: str | None, other: str | None, at: list[float], weight: float) -> None:
        i = self._of(track)
        if kind == "seen" and track is not None:
            if i is None:
                self.tracks[track] = self.following
                self._put(self.following, [*at, weight, 1, True, None], when)
                self.following += 1
            else:
                self._put(i, self._fused(self.objects[i], [*at, weight, 1]), when)
        elif kind == "merge" and i is not None:
            j = self._of(other)
            if j is not None and j != i:
                winner, loser = min(i, j), max(i, j)
                self._put(winner, self._fused(self.objects[winner], self.objects[loser]), when)
                self._put(loser, [*self.objects[loser][:5], False, winner], when)
        elif kind == "gone" and i is not None:
            self._put(i, [*self.objects[i][:5], False, None], when)
            self.tracks.pop(track)

    @staticmethod
    def _fused(a: list, b: list) -> list:
        w = a[3] + b[3]
        return [*((p * a[3] + q * b[3]) / w if w else p for p, q in zip(a[:3], b[:3], strict=True)), w, a[4] + b[4], True, None]


class _Stored(dict):
    """A mapping of the state store: what is read is kept for the call, what is set is written at its end."""

    def __init__(self, state, one: bool):
        super().__init__()
        self.state, self.one, self.dirty, self.dropped = state, one, set(), set()

    def __missing__(self, key):
        value = self.get(key)
        if value is None:
            raise KeyError(key)
        return value

    def get(self, key, default=None):
        if key in self or key in self.dropped or key is None:
            return super().get(key, default)
        if not self.state.containsKey((key,)):
            return default
        found = self.state.getValue((key,))
        value = found[0] if self.one else list(found)
        super().__setitem__(key, value)
        return value

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self.dirty.add(key)
        self.dropped.discard(key)

    def pop(self, key, default=None):
        self.dirty.discard(key)
        self.dropped.add(key)
        return super().pop(key, default)

    def save(self) -> None:
        for key in self.dirty:
            value = self[key]
            self.state.updateValue((key,), (value,) if self.one else tuple(value))
        for key in self.dropped:
            if self.state.containsKey((key,)):
                self.state.removeKey((key,))


def _chunk(batch: pd.DataFrame, behind: int) -> pa.Table:
    """A batch's events after the watermark: at (ms), seq, texts, and numbers with what stands for a missing one."""
    at = batch["ts"].to_numpy("datetime64[ns]").astype(np.int64) // 1_000_000
    batch, at = batch[at > behind], at[at > behind]
    text = {c: pa.array([None if pd.isna(v) else str(v) for v in batch[c]], pa.string()) for c in _TEXTS}
    number = {c: batch[c].astype("float64").fillna(absent).to_numpy() for c, absent in _NUMBERS.items()}
    return pa.table({"at": at, "seq": batch["seq"].to_numpy(np.int64), **text, **number})


def _packed(events: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, events.schema) as out:
        out.write_table(events)
    return sink.getvalue().to_pybytes()


def _in_order(events: pa.Table) -> Iterator[dict]:
    """The events by (at, seq); of those sent again the one that came last."""
    at, seq = (events.column(c).to_numpy() for c in ("at", "seq"))
    order = np.lexsort((seq, at))
    at, seq = at[order], seq[order]
    order = order[np.append((at[1:] != at[:-1]) | (seq[1:] != seq[:-1]), True)[: len(order)]]
    for i in range(0, len(order), SLICE):
        yield from events.take(pa.array(order[i : i + SLICE])).to_pylist()


class LiveMap(StatefulProcessor):
    """A scene's state: chunks of waiting events, each one's first time, objects, tracks, the next numbers and the timer that is set."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk long", "events binary")
        self.first = handle.getMapState("first", "chunk long", "at long")
        self.chunk = handle.getValueState("chunk", "chunk long")
        self.objects = handle.getMapState("objects", "object_idx long", _OBJECT)
        self.tracks = handle.getMapState("tracks", "track string", "object_idx long")
        self.following = handle.getValueState("following", "object_idx long")
        self.timer = handle.getValueState("timer", "at long")

    def _wait_for(self, at: int) -> None:
        """One timer, for the first event that waits."""
        if self.timer.exists():
            (now,) = self.timer.get()
            if now <= at:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _keep(self, chunk: int, events: pa.Table) -> int:
        first = int(events.column("at").to_numpy().min())
        self.waiting.updateValue((chunk,), (_packed(events),))
        self.first.updateValue((chunk,), (first,))
        return first

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        behind = timerValues.getCurrentWatermarkInMs()
        chunk = start = self.chunk.get()[0] if self.chunk.exists() else 0
        first = []
        for batch in rows:
            events = _chunk(batch, behind)
            if events.num_rows:
                first.append(self._keep(chunk, events))
                chunk += 1
        if chunk > start:
            self.chunk.update((chunk,))
            self._wait_for(min(first))
        return iter([])

    def _due(self, passed: int) -> tuple[pa.Table | None, list[int]]:
        """The events that are due, in the order they came, taken out of the chunks; and the first times of what stays."""
        due, later = [], []
        for chunk, first in sorted((k[0], v[0]) for k, v in self.first.iterator()):
            if first > passed:
                later.append(first)
                continue
            events = pa.ipc.open_stream(self.waiting.getValue((chunk,))[0]).read_all()
            now = events.column("at").to_numpy() <= passed
            due.append(events.filter(pa.array(now)))
            if now.all():
                self.waiting.removeKey((chunk,))
                self.first.removeKey((chunk,))
            else:
                later.append(self._keep(chunk, events.filter(pa.array(~now))))
        return (pa.concat_tables(due) if due else None), later

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        due, later = self._due(passed)
        rules = Rules(_Stored(self.objects, False), _Stored(self.tracks, True), self.following.get()[0] if self.following.exists() else 0)
        for e in _in_order(due) if due is not None else ():
            rules.apply((e["at"], e["seq"]), e["kind"], e["track"], e["other"], [e["x"], e["y"], e["z"]], e["weight"])
        rules.objects.save()
        rules.tracks.save()
        self.following.update((rules.following,))
        if later:
            self._wait_for(min(later))
        changed = sorted(rules.changed)
        for i in range(0, len(changed), SLICE):
            rows = [(key[0], k, *rules.changed[k], *rules.objects[k]) for k in changed[i : i + SLICE]]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OBJECTS.split(", ")])
            yield out.astype({"redirect": "Int64", "n": "int64", "active": "bool"})


def changes(events: DataFrame, delay: str) -> DataFrame:
    """OBJECTS rows of a stream of EVENTS: each object after each time it changed, in the order of event time."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy("scene").transformWithStateInPandas(statefulProcessor=LiveMap(), outputStructType=OBJECTS, outputMode="Update", timeMode="EventTime")


def start(events: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Keeps the map of a stream of events under ``folder``."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    return changes(events, delay).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _children(spark: SparkSession, folder: str, mark: str) -> list[int]:
    """The numbers n of folders mark=n that are whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n, at in names if n.startswith(f"{mark}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """The map as it is: each object's latest row, from the last snapshot and the batches after it."""
    upto = max(_children(spark, f"{folder}/snapshots", "upto"), default=-1)
    parts = [f"{folder}/changes/batch={b}" for b in _children(spark, f"{folder}/changes", "batch") if b > upto]
    rows = spark.read.schema(OBJECTS).parquet(*([f"{folder}/snapshots/upto={upto}"] if upto >= 0 else []), *parts) if parts or upto >= 0 else spark.createDataFrame([], OBJECTS)
    rest = [c for c in rows.columns if c not in ("scene", "object_idx")]
    latest = rows.groupBy("scene", "object_idx").agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("r"))
    return latest.select("scene", "object_idx", "r.*")


def compact(spark: SparkSession, folder: str) -> int:
    """Writes a snapshot of all batches so far, then removes what it holds; the number of the last batch in it.

    A reader takes the newest whole snapshot, so it doesn't matter where this is broken off.
    """
    batches = _children(spark, f"{folder}/changes", "batch")
    last = max(batches, default=-1)
    old = _children(spark, f"{folder}/snapshots", "upto")
    if last > max(old, default=-1):
        objects(spark, folder).write.mode("overwrite").parquet(f"{folder}/snapshots/upto={last}")
    done = [f"{folder}/changes/batch={b}" for b in batches if b <= last] + [f"{folder}/snapshots/upto={n}" for n in old if n < last]
    for name in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return last


def captions(requests: DataFrame, answers: DataFrame, wait: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Requests (object_idx, asked, image) of a stream with the answers (object_idx, answered, image, caption) that came within ``wait``; null where none did.

    An answer that is sent again within the watermark's delay counts once; answers and requests behind the watermark are dropped, and an unanswered request
    is put out once the watermark has passed all answers it might have got.
    """
    r = requests.withWatermark("asked", delay)
    a = answers.withWatermark("answered", delay).dropDuplicatesWithinWatermark(["object_idx", "image"]).select(F.col("object_idx").alias("_object"), F.col("image").alias("_image"), "answered", "caption")
    within = (F.col("object_idx") == F.col("_object")) & (F.col("image") == F.col("_image")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {wait}"))
    return r.join(a, within, "leftOuter").drop("_object", "_image")
