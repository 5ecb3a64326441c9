"""Keyed map state and late captions on streams: the same map for any order of arrival, restarts, compaction."""

import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest

from loomap.streaming import live

START = datetime(2024, 1, 1)


def events(seed, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choices(["seen", "merge", "gone"], [8, 1, 1])[0]
        out.append((rng.choice("ab"), i, START + timedelta(seconds=rng.randrange(0, 3600)), kind, rng.choice("pqrstuv"), rng.choice("pqrstuv"), rng.uniform(-5, 5), rng.uniform(-5, 5), 1.0, rng.choice([1.0, 2.5])))
    return out


def plain(rows):
    """One scene after another, events in order; written anew with sets of tracks in place of redirects."""
    out = {}
    for scene in sorted({r[0] for r in rows}):
        objects, tracks = [], {}
        for _, _, _, kind, track, other, x, y, z, w in sorted((r for r in rows if r[0] == scene), key=lambda r: (r[2], r[1])):
            i = tracks.get(track)
            if kind == "seen" and i is None:
                tracks[track] = len(objects)
                objects.append({"p": [x, y, z], "w": w, "n": 1, "active": True, "redirect": None})
            elif kind == "seen":
                o = objects[i]
                o.update(p=[(a * o["w"] + b * w) / (o["w"] + w) for a, b in zip(o["p"], (x, y, z), strict=True)], w=o["w"] + w, n=o["n"] + 1)
            elif kind == "merge" and i is not None and tracks.get(other) not in (None, i):
                a, b = sorted((i, tracks[other]))
                o, q = objects[a], objects[b]
                o.update(p=[(s * o["w"] + t * q["w"]) / (o["w"] + q["w"]) for s, t in zip(o["p"], q["p"], strict=True)], w=o["w"] + q["w"], n=o["n"] + q["n"])
                q.update(active=False, redirect=a)
                tracks = {t: a if k == b else k for t, k in tracks.items()}
            elif kind == "gone" and i is not None:
                objects[i]["active"] = False
                tracks = {t: k for t, k in tracks.items() if k != i}
        for i, o in enumerate(objects):
            out[scene, i] = ([round(v, 6) for v in o["p"]], round(o["w"], 6), o["n"], o["active"], o["redirect"])
    return out


def feed(spark, rows, folder):
    spark.createDataFrame(rows, live.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def found(spark, folder):
    return {(r.scene, r.object_idx): ([round(v, 6) for v in (r.x, r.y, r.z)], round(r.weight, 6), r.n, r.active, r.redirect) for r in live.objects(spark, folder).collect()}


END = [(s, 10**9, START + timedelta(days=1), "end", None, None, None, None, None, None) for s in "ab"]


@pytest.mark.parametrize("order", ["sorted", "shuffled", "backwards"])
def test_any_order_of_arrival(spark, tmp_path, order):
    """Batches in whatever order within the delay give one map, the same as a plain loop; a restart goes on where it was."""
    rows = events(4)
    arrival = {"sorted": sorted(rows, key=lambda r: r[2]), "shuffled": random.Random(1).sample(rows, len(rows)), "backwards": sorted(rows, key=lambda r: r[2], reverse=True)}[order]
    source, folder, checkpoint = (str(tmp_path / d) for d in ("in", "map", "cp"))
    feed(spark, arrival[:80], source)
    live.start(stream(spark, source), folder, checkpoint, "2 hours").awaitTermination()
    assert found(spark, folder) == {}  # nothing is sure yet
    feed(spark, arrival[80:] + arrival[:20], source)  # some events are sent again
    live.start(stream(spark, source), folder, checkpoint, "2 hours").awaitTermination()
    feed(spark, END, source)
    live.start(stream(spark, source), folder, checkpoint, "2 hours").awaitTermination()
    assert found(spark, folder) == plain(rows)


def test_in_steps_with_compaction(spark, tmp_path):
    """With a short delay the map grows batch by batch; snapshots replace the batches and change nothing; what is too late is dropped."""
    rows = sorted(events(9), key=lambda r: r[2])
    source, folder, checkpoint = (str(tmp_path / d) for d in ("in", "map", "cp"))
    for k in range(0, len(rows), 40):
        feed(spark, rows[k : k + 40], source)
        live.start(stream(spark, source), folder, checkpoint, "1 minute").awaitTermination()
        if k in (40, 80):
            before = found(spark, folder)
            assert before and live.compact(spark, folder) >= 0
            assert found(spark, folder) == before and len(live._children(spark, f"{folder}/changes", "batch")) == 0 and len(live._children(spark, f"{folder}/snapshots", "upto")) == 1
    feed(spark, END, source)
    live.start(stream(spark, source), folder, checkpoint, "1 minute").awaitTermination()
    feed(spark, [("a", 10**6, START, "seen", "late", None, 0.0, 0.0, 0.0, 1.0)], source)
    live.start(stream(spark, source), folder, checkpoint, "1 minute").awaitTermination()
    assert found(spark, folder) == plain(rows)


def test_captions_of_a_stream(spark, tmp_path):
    """Answers in time are joined, sent again they count once; a late one leaves its request without, one behind the watermark is dropped."""
    t = lambda m: START + timedelta(minutes=m)
    asked = "object_idx long, asked timestamp, image string"
    said = "object_idx long, answered timestamp, image string, caption string"
    r, a, cp = (str(tmp_path / d) for d in ("r", "a", "cp"))
    streams = lambda: live.captions(spark.readStream.schema(asked).parquet(r), spark.readStream.schema(said).parquet(a), "30 minutes", "1 hour")

    def run():
        streams().writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    put = lambda rows, schema, folder: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([(1, t(0), "i"), (2, t(1), "i"), (3, t(2), "i"), (4, t(3), "i")], asked, r)
    put([(1, t(5), "i", "a chair"), (1, t(6), "i", "a chair"), (3, t(50), "i", "too late"), (9, t(5), "i", "never asked")], said, a)
    run()
    put([(2, t(20), "i", "a lamp"), (1, t(7), "i", "a chair again")], said, a)
    run()
    put([(5, t(600), "i")], asked, r)
    put([(6, t(600), "i", "of another")], said, a)
    run()
    put([(4, t(10), "i", "behind the watermark")], said, a)
    put([(7, t(601), "i")], asked, r)
    run()
    got = sorted((x.object_idx, x.caption) for x in spark.read.schema(asked + ", answered timestamp, caption string").parquet(f"{tmp_path}/out").collect())
    assert [g for g in got if g[0] < 5] == [(1, "a chair"), (2, "a lamp"), (3, None), (4, None)]


class _Map(dict):
    """A map state that counts its calls."""

    calls = 0

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def removeKey(self, key):
        self.calls += 1
        self.pop(key)

    def iterator(self):
        return iter(list(self.items()))


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.maps, self.timers = [], set()

    def getMapState(self, *a):
        self.maps.append(_Map())
        return self.maps[-1]

    def getValueState(self, *a):
        return _Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_waiting_events_are_no_calls_by_themselves():
    """2,000 events of three tracks in four batches: the store is asked a few times, not for each event; the last to come of an event's versions counts."""
    rows = [("a", i, START + timedelta(seconds=i), "seen", "pqr"[i % 3], None, 1.0 * i, 0.0, None, 1.0) for i in range(2000)]
    random.Random(3).shuffle(rows)
    batches = [pd.DataFrame(rows[i : i + 500], columns=[c.split()[0] for c in live.EVENTS.split(", ")]) for i in range(0, 2000, 500)]
    batches.append(pd.DataFrame([("a", 0, START, "seen", "p", None, 600.0, 0.0, None, 1.0)], columns=batches[0].columns))
    handle, machine = _Handle(), live.LiveMap()
    machine.init(handle)
    assert list(machine.handleInputRows(("a",), iter(batches), _Watermark(0))) == []
    ms = lambda s: int((START + timedelta(seconds=s)).replace(tzinfo=UTC).timestamp() * 1000)
    assert handle.timers == {ms(0)}
    out = []
    for at in (ms(999), ms(5000)):
        handle.timers.clear()
        out.append(pd.concat(machine.handleExpiredTimer(("a",), _Watermark(at), None)))
    assert [o.n.tolist() for o in out] == [[334, 333, 333], [667, 667, 666]]
    assert out[1].x.tolist() == pytest.approx([(sum(range(0, 2000, 3)) + 600) / 667, sum(range(1, 2000, 3)) / 667, sum(range(2, 2000, 3)) / 666])
    assert sum(m.calls for m in handle.maps) < 100 and not handle.timers and not machine.waiting
