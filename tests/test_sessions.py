"""Session state as batches and as streams, against plain Python."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rookery.streaming import folds, session


def plain_folds(gestures, parent):
    """Two plain sets a session."""
    kids = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)

    def under(n):
        yield n
        for k in kids.get(n, []):
            yield from under(k)

    sets = {}
    for _, who, box, deep, reading in gestures:
        folded, packed = sets.setdefault(who, (set(), set()))
        if reading:
            packed.clear()
            packed |= folded
        elif box in parent:
            keys = set(under(box)) if deep else {box}
            if box not in folded:
                folded |= keys
            else:
                folded -= keys
                packed -= keys
    return {w: (f, p) for w, (f, p) in sets.items()}


def some_gestures(seed, n, boxes):
    r = random.Random(seed)
    parent = {b: (r.randrange(b) if b and r.random() < 0.9 else None) for b in range(boxes)}
    return parent, [(k, r.randrange(4), r.choice([*range(boxes), 999]), r.random() < 0.3, r.random() < 0.15) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_sets_in_batch_and_stream(spark, tmp_path, seed):
    parent, gestures = some_gestures(seed, 160, 40)
    want = plain_folds(gestures, parent)
    tree = spark.createDataFrame(list(parent.items()), "node long, parent long")
    boxes = folds.numbered(tree)
    number = {x.node: (x.lo, x.hi) for x in boxes.collect()}
    assert sorted(lo for lo, _ in number.values()) == list(range(40))
    for n, p in parent.items():
        lo, hi = number[n]
        assert hi - lo == 1 + sum(b - a for m, (a, b) in number.items() if parent[m] == n)
        assert p is None or number[p][0] < lo and hi <= number[p][1]
    names = ["k", "who", "box", "deep", "reading"]
    for part in range(4):
        pd.DataFrame(gestures[part * 40 : part * 40 + 40], columns=names).to_parquet(tmp_path / f"{part}.parquet")
    df = spark.read.parquet(f"file://{tmp_path}").repartition(3)
    ranges = folds.fold_sets(df, boxes, session="who", order=["k"])
    got = {w: (set(), set()) for w in want}
    for x in folds.boxes_in(ranges, boxes).collect():
        got[x.session][x.packed].add(x.node)
    assert got == want
    assert folds.fold_sets(df.limit(0), boxes, session="who", order=["k"]).isEmpty()
    assert folds.numbered(tree.limit(0)).isEmpty()

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}")
    q = folds.stream_fold_sets(stream, boxes, session="who", order=["k"]).writeStream.outputMode("update").foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"file://{tmp_path}/out/{k}")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for x in spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/out").orderBy("batch").collect():
        last[x.session] = (x.folded, x.packed)
    node = {lo: n for n, (lo, _) in number.items()}
    as_set = lambda b: {node[k] for lo, hi in zip(b[::2], b[1::2], strict=True) for k in range(lo, hi)}
    assert {w: tuple(map(as_set, s)) for w, s in last.items()} == want


def test_ranges_are_a_set():
    r = random.Random(5)
    ranges, plain = folds.Ranges(), set()
    for _ in range(3000):
        lo = r.randrange(60)
        hi, on = lo + r.randrange(1, 20), r.random() < 0.5
        ranges.put(lo, hi, on)
        plain = plain | set(range(lo, hi)) if on else plain - set(range(lo, hi))
        assert {n for n in range(90) if n in ranges} == plain
        assert ranges.bounds == sorted(set(ranges.bounds))


def test_settled_as_a_stream_is_the_batch(spark, tmp_path):
    r = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, r.randrange(5), start + datetime.timedelta(milliseconds=r.choice([k * 40, k * 40, k * 40 // 400 * 400])), r.choice([0.09, 0.24])) for k in range(400)]
    end = [(1000 + w, w, start + datetime.timedelta(hours=1), 0.09) for w in range(5)] + [(2000, 9, start + datetime.timedelta(hours=2), 0.09)]
    batch = spark.createDataFrame(rows + end[:-1], "id long, who long, at timestamp_ntz, wait double")
    seconds = batch.withColumn("sec", F.unix_micros(F.col("at").cast("timestamp")) / 1e6)
    want = {(x.who, x.id) for x in session.settled(seconds, session="who", at="sec", order=["id"], wait="wait").select("who", "id").collect()}
    schema = "id long, who long, at timestamp, wait double"
    parts = [rows[k : k + 40] for k in range(0, 400, 40)]
    for part in parts:
        r.shuffle(part)  # late by up to forty events
    for k, part in enumerate([*parts, end, end[-1:], end[-1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:02d}")
        stream_dir = f"{tmp_path}/in/*"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{stream_dir}")
    q = session.stream_settled(stream, session="who", at="at", order=["id"], wait="wait", late="5 seconds").writeStream.outputMode("append").format("memory").queryName("settled").start()
    q.processAllAvailable()
    q.stop()
    got = [(int(x.session), x.id) for x in spark.table("settled").collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[1] < 2000} == want
