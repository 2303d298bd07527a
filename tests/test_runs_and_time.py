"""Streams cut anywhere, batches committed once, memos, retention, time joins, mergeable summaries."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import lifecycle, rollup, temporal
from vellum.sources import memo, retention
from vellum.streaming import frames
from vellum.streaming.commits import BatchSink

TEXT = '﻿: hello\ndata: {"type":"start","n":1}\n\n\n\ndata:{"type":"é😀","n":2}\ndata: ignored\n\nid: 3\n\ndata: {"broken\n\ndata: 7\n\nevent: x\ndata:  {"type":"done","n":3} \n\ndata: {"type":"late"'
SCHEMA = "type string, n int"


def test_frames_of_every_cut(spark, tmp_path):
    """One stream in two chunks for every byte, and one in single bytes, over several micro-batches, give the events of the whole."""
    data = TEXT.encode()
    rows = [(cut, i, part) for cut in range(len(data) + 1) for i, part in enumerate((data[:cut], data[cut:]))]
    rows += [(9999, i, data[i : i + 1]) for i in range(len(data))] + [(9999, len(data), None)]
    for lot in (lambda r: r[0] != 9999 and r[1] == 0 or r[0] == 9999 and r[1] < 50, lambda r: not (r[0] != 9999 and r[1] == 0 or r[0] == 9999 and r[1] < 50)):
        spark.createDataFrame([r for r in rows if lot(r)], "stream int, seq int, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("stream int, seq int, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    q = frames.event_stream(stream, SCHEMA).writeStream.format("memory").queryName("cuts").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("select * from cuts").collect():
        got.setdefault(r.stream, []).append((r.frame_idx, r.event.type if r.event else None, r.event.n if r.event else None))
    whole = spark.createDataFrame([(TEXT.lstrip("﻿"),)], "t string")
    want = [(r.frame_idx, r.event.type if r.event else None, r.event.n if r.event else None) for r in lifecycle.event_frames(whole, "t", SCHEMA).orderBy("frame_idx").collect()]
    assert len(want) == 4 and set(got) == {*range(len(data) + 1), 9999}
    assert all(sorted(g) == want for g in got.values())


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 0, "progress", None), (1, 1, "done", None), (2, 0, "error", "first"), (2, 1, "error", ""), (3, 0, "progress", "x"), (4, 0, "done", None), (4, 1, "error", "late")], "s int, frame_idx int, t string, e string")
    assert dict(map(tuple, frames.outcome(df, "s", F.col("t"), F.col("e")).collect())) == {1: "done", 2: "conversion failed", 3: "conversion ended unexpectedly", 4: "late"}


def test_batches_are_committed_once(spark, tmp_path):
    """A batch fails at each step of its commit; started again, no row is lost, doubled or moved between the tables."""
    t0 = datetime.datetime(2024, 1, 1)
    minutes = [(0, 5, 30), (10, 19, 60), (45, 51, None, 55), (52, 200)]
    for i, lot in enumerate(minutes):
        rows = [(100 * i + k, None if m is None else t0 + datetime.timedelta(minutes=m)) for k, m in enumerate(lot)]
        spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for fail_at in (None, "rows", "late", "marks"):
        sink = BatchSink(str(tmp_path / f"out-{fail_at}"))
        broken = []

        def step(batch, batch_id, sink=sink, fail_at=fail_at, broken=broken):
            sink(batch, batch_id)
            if fail_at and batch_id == 2 and not broken:
                broken.append(1)  # as if killed before this step: what follows it is undone, and files stay half written
                for later in ("rows", "late", "marks")[("rows", "late", "marks").index(fail_at) :]:
                    os.remove(str(tmp_path / f"out-{fail_at}/{later}/batch_id=2/_SUCCESS"))
                raise RuntimeError("killed")

        def start(step=step, fail_at=fail_at):
            stream = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
            return stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / f"state-{fail_at}")).trigger(availableNow=True).start()

        if fail_at:
            with pytest.raises(Exception):
                start().awaitTermination()
            assert sink.committed(spark) == ([0, 1] if fail_at else [0, 1, 2, 3])
        start().awaitTermination()
        assert sink.committed(spark) == [0, 1, 2, 3]
        rows = sorted((r.batch_id, r.id) for r in sink.read(spark).collect())
        late = sorted((r.batch_id, r.id) for r in sink.read(spark, "late").collect())
        assert rows == [(0, 0), (0, 1), (0, 2), (1, 102), (2, 201), (2, 203), (3, 300), (3, 301)]
        assert late == [(1, 100), (1, 101), (2, 200), (2, 202)]


def test_a_second_run_redoes_what_changed(spark, tmp_path, monkeypatch):
    calls = []

    def compute(asked):
        calls.append(sorted((r.path, r.mtime) for r in asked.collect()))
        pictures = F.when(F.col("path") == "none", F.array().cast("array<string>")).otherwise(F.array(F.concat("path", F.lit(".png"))))
        return asked.withColumns({"artefacts": pictures, "pages": F.col("mtime") * 10})

    files = lambda *rows: spark.createDataFrame([(p, m, 1, None) for p, m in rows], "path string, mtime long, size long, work_dir string")
    m = memo.Memo(spark, str(tmp_path / "m"))
    answer = lambda df: sorted((r.path, r.mtime, r.pages, r.redone) for r in df.collect())
    assert answer(m.run(files(("a", 1), ("a", 1), ("b", 1), ("none", 1)), compute)) == [("a", 1, 10, True), ("b", 1, 10, True), ("none", 1, 10, True)]
    again = memo.Memo(spark, str(tmp_path / "m"))  # as a new session would
    assert answer(again.run(files(("a", 1), ("b", 2), ("none", 1)), compute)) == [("a", 1, 10, False), ("b", 2, 20, True), ("none", 1, 10, True)]
    gone = spark.createDataFrame([("b.png",)], "path string")
    assert answer(again.run(files(("a", 1), ("b", 2)), compute, gone)) == [("a", 1, 10, True), ("b", 2, 20, False)]
    assert calls == [[("a", 1), ("b", 1), ("none", 1)], [("b", 2), ("none", 1)], [("a", 1)]]
    before = sorted(r.path for r in again.current().collect())
    monkeypatch.setattr(memo.Memo, "_publish", lambda self, version: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        again.run(files(("c", 1)), compute)
    monkeypatch.undo()
    (tmp_path / "m/pointers/0000000099").touch()  # killed between creating a pointer and writing it
    assert sorted(r.path for r in memo.Memo(spark, str(tmp_path / "m")).current().collect()) == before
    assert answer(again.run(files(("b", 1), ("d", 1)), compute)) == [("b", 1, 10, False), ("d", 1, 10, True)]


def test_retention_removes_files(spark, tmp_path):
    rows = [(i, datetime.date(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, day date")
    for t in ("all", "alerts"):
        df.write.partitionBy("day").parquet(str(tmp_path / "logs" / t))
    now = datetime.datetime(2024, 1, 30, 12)
    files = lambda: sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "logs") for f in names)
    assert files() == 62
    gone = retention.prune_days(spark, str(tmp_path / "logs"), now)
    assert len(gone) == 2 * 15 and files() == 32 and retention.prune_days(spark, str(tmp_path / "logs"), now) == []
    left = {r.id for r in spark.read.parquet(str(tmp_path / "logs/all")).collect()}
    assert left == {*range(15, 30), 99}
    (tmp_path / "loose/sub").mkdir(parents=True)
    for name, age in (("old.log", 15), ("new.log", 13), ("sub/old.log", 30)):
        (tmp_path / "loose" / name).write_text("x")
        os.utime(tmp_path / "loose" / name, (1_700_000_000 - age * 86_400,) * 2)
    for want in ([str(tmp_path / "loose/old.log")], []):
        assert retention.prune_files(spark, [str(tmp_path / "loose"), str(tmp_path / "absent")], 1_700_000_000_000) == want


def test_interval_join(spark):
    r = random.Random(3)
    points = [(r.choice([1, 1, 1, 2, None]), i, r.choice([r.randint(-5000, 5000), 2**40 + i, None])) for i in range(400)]
    intervals = [(r.choice([1, 2, None]), i, a, a + r.choice([0, 1, 2, 3, 64, 65, 1000, 2**41, -5])) for i in range(150) for a in [r.randint(-5000, 5000)]] + [(1, 900, None, 5), (1, 901, 5, None), (1, 902, -(2**50), 2**50)]
    want = sorted((p[1], i[1]) for p in points for i in intervals if p[0] == i[0] and p[2] is not None and i[2] is not None and i[3] is not None and i[2] <= p[2] < i[3])
    got = temporal.interval_join(spark.createDataFrame(points, "k int, p int, t long"), spark.createDataFrame(intervals, "k int, i int, a long, z long"), ["k"], "t", "a", "z")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.p, x.i) for x in got.collect()) == want and len(want) > 1000
    assert temporal.interval_join(spark.createDataFrame(points, "k int, p int, t long"), spark.createDataFrame([], "k int, i int, a long, z long"), ["k"], "t", "a", "z").count() == 0


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_as_of_join(spark, width):
    r = random.Random(width)
    left = [(r.choice([1, 2, 3, None]), i, r.choice([r.randint(0, 1000), None])) for i in range(300)]
    right = [(r.choice([1, 2, None]), r.choice([r.randint(0, 900), None]), r.choice([5, None, i])) for i in range(60)]
    def last(k, t):
        good = [(b[1], b[2] is not None, b[2] or 0) for b in right if b[0] == k and b[1] is not None and t is not None and b[1] <= t]
        best = max(good, default=None)
        return (best[0], best[2] if best[1] else None) if best else (None, None)

    df = temporal.as_of_join(spark.createDataFrame(left, "k int, i int, t int"), spark.createDataFrame(right, "k int, t int, v int").withColumn("rt", F.col("t")), ["k"], "t", ["rt", "v"], width)
    assert {(x.i, x.rt, x.v) for x in df.collect()} == {(i, *last(k, t)) for k, i, t in left} and df.count() == len(left)


def test_merged_summaries_equal_recomputed_ones(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 30).cast("int").alias("day"), (F.col("id") % 3).alias("kind"), (F.pmod(F.hash("id"), F.lit(10_000)) / 100).alias("v"), F.pmod(F.hash("id", F.lit(1)), F.lit(5000)).alias("who"))
    path = str(tmp_path / "states")
    rollup.store(rollup.states(df.where("day < 20"), ["day", "kind"], F.col("v"), F.col("who")), path)
    rollup.store(rollup.states(df.where("day >= 15"), ["day", "kind"], F.col("v"), F.col("who")), path)  # five days again, ten new ones
    stored = spark.read.parquet(path)
    merged = {r.kind: r for r in rollup.figures(rollup.merge(stored.where("day between 3 and 27"), ["kind"], rollup=True)).collect()}
    some = df.where("day between 3 and 27")
    exact = {r.kind: r for r in some.rollup("kind").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(28,6)")).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_distinct("who").alias("users")).collect()}
    assert set(merged) == set(exact) == {None, 0, 1, 2}
    for k, m in merged.items():
        assert (m.n, m.total, m.least, m.most) == (exact[k].n, exact[k].total, exact[k].least, exact[k].most)
        assert abs(m["distinct"] - exact[k].users) < 0.05 * exact[k].users
        low = some.where(F.lit(True) if k is None else F.col("kind") == k).where(F.col("v") <= m.quantiles[0]).count()
        assert abs(low / m.n - 0.5) < 0.035


def test_folders_of_an_application(spark, tmp_path):
    from vellum.session import listed, remove, scratch, shared_folder

    assert scratch(spark).startswith(shared_folder(spark)) and spark.sparkContext.applicationId in scratch(spark)
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.txt").write_text("12345")
    assert sorted((f.name, f.is_folder, f.is_folder or f.size) for f in listed(spark, str(tmp_path / "a"))) == [("b", True, True), ("x.txt", False, 5)]
    assert remove(spark, str(tmp_path / "a")) and not remove(spark, str(tmp_path / "a")) and listed(spark, str(tmp_path / "a")) == []
