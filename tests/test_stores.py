"""Paged reads, the keyed store, files and slots."""

import json
import os

import pytest
from pyspark.sql import functions as F

from terravia.sources import blobs, documents, paged, store
from terravia.streaming import slots


def pages(folder, tiles):
    """tiles: number -> list of pages, each (features, more) or a text."""
    for tile, some in tiles.items():
        for k, page in enumerate(some):
            path = folder / f"tile={tile}" / f"page={k}"
            path.mkdir(parents=True)
            text = page if isinstance(page, str) else json.dumps({"features": [{"id": i} for i in page[0]], "exceededTransferLimit": page[1]})
            (path / "part-0.txt").write_text(text)
    return f"file://{folder}"


def read(spark, path, **options):
    paged.register(spark)
    reader = spark.read.format(paged.NAME).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def ids(df):
    return sorted((r.tile, r.page, r.nth, json.loads(r.feature)["id"]) for r in df.collect())


def test_pages_until_a_short_one(spark, tmp_path):
    path = pages(tmp_path, {1: [([1, 2], True), ([3, 4], True), ([5], True)], 2: [([6, 7], False), "never read"], 3: [([], False)]})
    assert ids(read(spark, path, page_size=2)) == [(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 3), (1, 1, 1, 4), (1, 2, 0, 5), (2, 0, 0, 6), (2, 0, 1, 7)]
    assert read(spark, f"file://{tmp_path}/none").count() == 0


def test_a_bad_page_is_no_end(spark, tmp_path):
    path = pages(tmp_path, {1: [([1, 2], True)], 2: [([3], False)], 3: ["<html>busy</html>"], 4: ['{"error": {"code": 500}}'], 5: ['{"features": 1}'], 6: ['{"features": [']})
    for tile, says in ((1, "tile 1, page 1"), (3, "no JSON"), (4, "500"), (5, "no list of features"), (6, "broken JSON")):
        with pytest.raises(Exception, match=says):
            read(spark, path, page_size=2).where(F.col("tile") == tile).collect()
    assert ids(read(spark, path, page_size=2).where("tile = 2")) == [(2, 0, 0, 3)]


def test_a_filter_skips_partitions(spark, tmp_path):
    path = pages(tmp_path, {k: [([k], False)] for k in range(8)})
    assert read(spark, path).rdd.getNumPartitions() == 8
    some = read(spark, path).where(F.col("tile").isin(2, 5) & (F.col("nth") == 0))
    assert some.rdd.getNumPartitions() == 2 and ids(some) == [(2, 0, 0, 2), (5, 0, 0, 5)]
    one = read(spark, path).where("tile = 3 AND tile IN (3, 4)")
    assert one.rdd.getNumPartitions() == 1 and ids(one) == [(3, 0, 0, 3)]


def test_mirrors_are_asked_in_turn(spark, tmp_path):
    first = pages(tmp_path / "a", {1: ["<html>", ([9], False)], 2: [([2], False)]})
    second = pages(tmp_path / "b", {1: [([1], False)], 2: ["never asked"]})
    assert ids(read(spark, first, mirrors=second)) == [(1, 0, 0, 1), (2, 0, 0, 2)]


def test_attempts_and_pauses():
    def failing(log, name, until, error=paged.PageError):
        def call():
            log.append(name)
            if log.count(name) < until:
                raise error(name)
            return {"by": name}

        return call

    log, slept = [], []
    assert paged.persistent([failing(log, "a", 99), failing(log, "b", 2)], 3, 20.0, slept.append) == {"by": "b"}
    assert log == ["a", "a", "a", "b", "b"] and slept == [20.0, 40.0, 20.0]
    log, slept = [], []
    with pytest.raises(paged.PageError, match="nobody could answer; last: b"):
        paged.persistent([failing(log, "a", 99), failing(log, "b", 99)], 2, 1.0, slept.append)
    assert slept == [1.0, 1.0], "no pause after the last attempt"
    log = []
    with pytest.raises(paged.RefusedError):
        paged.persistent([failing(log, "a", 99, paged.RefusedError), failing(log, "b", 1)], 4, 1.0, slept.append)
    assert log == ["a"]


def files_of(path):
    return {os.path.relpath(f"{d}/{f}", path): os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


ROWS = "key string, v long, at long"


def test_store_put_twice_writes_once(spark, tmp_path):
    path = str(tmp_path / "s")
    uri = f"file://{path}"
    rows = spark.createDataFrame([(f"u{i}/x", i, 1) for i in range(200)], ROWS)
    assert store.put(rows, uri, 8) == 200
    before = files_of(path)
    assert len(before) == 8
    assert store.put(rows.repartition(5), uri, 8) == 0 and files_of(path) == before
    assert store.put(spark.createDataFrame([("u7/x", 70, 2), ("new", 1, 2)], ROWS), uri, 8) == 2
    after = files_of(path)
    touched = {p.split("/")[0] for p in set(after) ^ set(before)} | {p.split("/")[0] for p in after if p in before and after[p] != before[p]}
    assert len(touched) <= 2, "other folders keep their files"
    got = {r.key: r.v for r in store.get(spark, uri).collect()}
    assert got == {f"u{i}/x": 70 if i == 7 else i for i in range(200)} | {"new": 1}


def test_store_keys_ties_delete_and_sweep(spark, tmp_path):
    uri = f"file://{tmp_path}/s"
    store.put(spark.createDataFrame([("a/./b", 1, 5), ("a//b", 9, 4), ("c", 3, 1), ("c", 4, 1), ("d", 5, 9)], ROWS), uri, 4)
    assert {(r.key, r.v) for r in store.get(spark, uri).collect()} == {("a/b", 1), ("c", 4), ("d", 5)}
    for bad in ("../x", "/x", None, ""):
        with pytest.raises(Exception, match="leaves the store"):
            store.put(spark.createDataFrame([(bad, 1, 1)], ROWS), uri, 4)
    assert store.sweep(spark, uri, 5, 4) == 1 and store.delete(spark.createDataFrame([("d",), ("zzz",)], "key string"), uri, 4) == 1
    assert [(r.key, r.v) for r in store.get(spark, uri).collect()] == [("a/b", 1)]
    assert store.delete(spark.createDataFrame([("d",)], "key string"), f"file://{tmp_path}/none") == 0


def test_blobs_are_whole_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", "one"), ("a/b/y.txt", "é"), ("z", "")], "key string, content string")
    root = f"file://{tmp_path}/r"
    assert blobs.write(rows, root) == 3 and blobs.write(rows.repartition(3), root) == 3
    assert sorted(os.path.relpath(f"{d}/{f}", tmp_path / "r") for d, _, names in os.walk(tmp_path / "r") for f in names if not f.endswith(".crc")) == ["a/b/y.txt", "a/x.txt", "z"]
    assert (tmp_path / "r/a/b/y.txt").read_text() == "é"
    with pytest.raises(Exception, match="leaves the store"):
        blobs.write(spark.createDataFrame([("../q", "x")], "key string, content string"), root)


def test_manifest_asset_is_idempotent(spark):
    rows = spark.createDataFrame([('{"id":"r","built":"b","assets":{"labels.json":{"sha256":"o","bytes":1}},"sources":[]}', "labels.json", "new", 7), ("no json", "labels.json", "new", 7), ('{"id":"s"}', "labels.json", "n", 1)], "manifest string, name string, sha string, bytes long")
    once = documents.with_asset(rows, ("Names", "via", "free"))
    twice = documents.with_asset(once, ("Names", "via", "free"))
    assert [r.manifest for r in once.collect()] == [r.manifest for r in twice.collect()]
    first = json.loads(once.collect()[0].manifest)
    assert first == {"id": "r", "built": "b", "assets": {"labels.json": {"sha256": "new", "bytes": 7}}, "sources": [{"dataset": "Names", "via": "via", "license": "free"}]}
    assert once.collect()[1].manifest == "no json"


def walked(events, n):
    """First come, first served, event by event."""
    out = {}
    for pool in {e[0] for e in events}:
        free, waiting = n, []
        for _, jid, kind, at in sorted((e for e in events if e[0] == pool), key=lambda e: (e[3], e[2] == "submit", e[1])):
            if kind == "submit":
                waiting.append(jid)
            else:
                free += 1
            while free > 0 and waiting:
                out[pool, waiting.pop(0)] = at
                free -= 1
    return out


def queue_events(seed=3, jobs=60):
    """Submissions and, for most jobs, an end after their start."""
    import random

    r, events = random.Random(seed), []
    for pool in (1, 2):
        at, running, waiting, free, k = 1_000_000, [], [], 3, pool * 1000
        for _ in range(jobs):
            at += r.randrange(1000, 60_000)
            while running and running[0][0] <= at:
                end, jid = running.pop(0)
                events.append((pool, jid, r.choice(["done", "error"]), end))
                free += 1
                if waiting:
                    running = sorted([*running, (end + r.randrange(30_000, 400_000), waiting.pop(0))])
                    free -= 1
            k += 1
            events.append((pool, k, "submit", at))
            if free > 0:
                running = sorted([*running, (at + r.randrange(30_000, 400_000), k)])
                free -= 1
            else:
                waiting.append(k)
    return events


def test_slots_batch(spark):
    events = queue_events()
    got = {(r.pool, r.jid): r.at for r in slots.started(spark.createDataFrame(events, "pool long, jid long, kind string, at long"), 3).collect()}
    assert got == walked(events, 3) and len(got) > 50


def test_slots_stream_is_its_batch_twin_under_late_events(spark, tmp_path):
    events = queue_events()
    end = max(e[3] for e in events)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ordered = sorted(events, key=lambda e: e[3])
    # files in order of time, but a tenth of the events come in the file after theirs; then two files that only move the watermark on
    size = len(ordered) // 5 + 1
    files = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    late = [[e for j, e in enumerate(f) if j % 10 == 5] for f in files]
    dealt = [[e for j, e in enumerate(f) if j % 10 != 5] + (late[i - 1] if i else []) for i, f in enumerate(files)] + [late[-1]]
    dealt += [[(99, 1, "submit", end + 4_000_000)], [(99, 2, "submit", end + 8_000_000)], [(99, 3, "submit", end + 200_000_000)], [(99, 4, "submit", end + 400_000_000)]]
    path = tmp_path / "in"
    for i, rows in enumerate(dealt):
        frame = spark.createDataFrame(rows, "pool long, jid long, kind string, at long").withColumn("ts", F.timestamp_millis("at"))
        frame.coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("part-*.parquet"):
            if not f.name.startswith("part-9"):
                f.rename(path / f"part-9{i:03d}.parquet")
                os.utime(path / f"part-9{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "pool long, jid long, kind string, at long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    found = slots.states(stream, 3, ttl_ms=86_400_000, late="1 hour")
    q = found.writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("slots").where("pool < 99").collect()
    running = {(r.pool, r.jid): r.at for r in rows if r.state == "running"}
    twin = {(r.pool, r.jid): r.at for r in slots.started(spark.createDataFrame(events, "pool long, jid long, kind string, at long"), 3).collect()}
    assert running == twin
    ended = {(e[0], e[1]) for e in events if e[2] != "submit"}
    assert {(r.pool, r.jid) for r in rows if r.state in slots.FINISHED} == ended
    assert {(r.pool, r.jid) for r in rows if r.state == "forgotten"} == ended, "after their time to live"
