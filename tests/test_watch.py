"""The watch loop on its own, and as a stream against its plain form."""

import datetime
import json
import random

from tessera.streaming import watch

AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
BASE = int(AT.timestamp() * 1000)


def test_changes_are_gathered_and_scans_come_back():
    change = lambda at, path: (at, "change", path)
    got = watch.replay([change(0, "a"), change(100, "b"), change(250, "a")], 10_000)
    assert [a[:3] for a in got] == [(0, "scan", []), (450, "refresh", ["a", "b"])]
    busy = watch.replay([change(k * 150, f"f{k}") for k in range(12)], 5000)
    assert [a[:2] for a in busy] == [(0, "scan"), (1000, "refresh"), (1850, "refresh")]
    assert [a[:2] for a in watch.replay([change(0, "a")], 130_000)] == [(0, "scan"), (200, "refresh"), (60_000, "scan"), (120_000, "scan")]
    assert [a[:2] for a in watch.replay([change(0, "a"), (5000, "root", None)], 10_000)] == [(0, "scan"), (200, "refresh"), (5200, "scan")]
    assert [a[:2] for a in watch.replay([change(0, "a"), (5000, "scan_failed", None)], 10_000)] == [(0, "scan"), (200, "refresh"), (5000, "scan")]


def test_failures_wait_longer_each_time():
    signals, at = [(0, "change", "a")], 1000
    for _ in range(8):
        signals.append((at, "failed", None))
        at += 100_000
    retries = [a for a in watch.replay(signals, at, reconcile=10**9) if a[1] == "retry"]
    assert [a[4] for a in retries] == [1000, 2000, 4000, 8000, 16_000, 30_000, 30_000, 30_000] and [a[3] for a in retries] == list(range(1, 9))
    got = watch.replay([(0, "change", "a"), (500, "failed", None), (600, "change", "b"), (700, "change", "c")], 3000)
    assert [a[:3] for a in got] == [(0, "scan", []), (200, "refresh", ["a"]), (500, "retry", []), (1500, "refresh", ["b", "c"])]
    calm = watch.replay([(0, "change", "a"), (500, "failed", None), (600, "done", None), (700, "failed", None)], 800)
    assert calm[-1][3:] == (1, 1000)


def test_the_stream_gives_the_plain_forms_actions(spark, tmp_path):
    r = random.Random(12)
    rows = [(f"p{r.randrange(3)}", r.randrange(0, 200_000), r.choices(watch.SIGNALS, [20, 1, 2, 2, 1])[0], f"f{r.randrange(5)}") for _ in range(150)]
    end = 1_000_000
    rows.sort(key=lambda x: x[1] + r.randrange(4000))
    drop = lambda name, part: (tmp_path / "in" / name).write_text("".join(json.dumps({"project_id": p, "at": (AT + datetime.timedelta(milliseconds=at)).isoformat(), "kind": k, "path": f}) + "\n" for p, at, k, f in part))
    (tmp_path / "in").mkdir()
    for k in range(4):
        drop(f"{k}.json", rows[k * 40 : (k + 1) * 40])
    # Signals of another project move the watermark on, so that all timers up to it have fired.
    drop("8.json", [("end", end, "done", None)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        signals = spark.readStream.schema(watch.SIGNAL_ROWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        actions = watch.watch_actions(signals, "10 seconds")
        actions.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for p in ("p0", "p1", "p2"):
        own = [(BASE + at, k, f) for q, at, k, f in rows if q == p]
        want = [a for a in watch.replay(own, BASE + end - 10_000)]
        assert sorted((g["at"], g["action"], list(g["paths"]), g["attempt"], g["delay"]) for g in got if g["project_id"] == p) == sorted(want)
