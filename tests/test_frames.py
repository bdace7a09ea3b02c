"""Commit log, tables on it, frame cubes and the recorder: races, repeats, gaps, aborted writes, pushed conditions."""

import concurrent.futures as futures
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.sources import commits, frames


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    frames.register(spark)


def stores(spark):
    return [commits.LocalStore(), commits.HadoopStore(spark)]


def test_a_file_is_created_once_and_whole(spark, tmp_path):
    for k, store in enumerate(stores(spark)):
        at = f"{tmp_path}/{k}/log/00000000000000000001.json"
        assert store.create(at, b"first") and not store.create(at, b"second")
        assert store.read(at) == b"first" and store.names(f"{tmp_path}/{k}/log") == [os.path.basename(at)]
        store.delete(at)
        store.delete(at)
        assert store.names(f"{tmp_path}/{k}/log") == [] and store.names(f"{tmp_path}/none") == []


def test_only_one_of_many_writers_gets_a_version(spark, tmp_path):
    for k, store in enumerate(stores(spark)):
        with futures.ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda n: store.create(f"{tmp_path}/{k}/one", str(n).encode()), range(16)))
        assert sum(won) == 1 and store.read(f"{tmp_path}/{k}/one") == str(won.index(True)).encode()


def test_no_change_is_lost_or_doubled(tmp_path):
    def write(name):
        log = commits.Log(str(tmp_path))
        for n in range(20):
            log.change(lambda s: s | {"all": [*s.get("all", []), f"{name}{n}"]})

    with futures.ThreadPoolExecutor(4) as pool:
        list(pool.map(write, "abcd"))
    version, state = commits.Log(str(tmp_path)).newest()
    assert version == 80 and sorted(state["all"]) == sorted(f"{a}{n}" for a in "abcd" for n in range(20))
    assert [x for x in state["all"] if x[0] == "a"] == [f"a{n}" for n in range(20)]


def test_a_refused_change_leaves_no_version(tmp_path):
    log = commits.Log(str(tmp_path))
    log.change(lambda s: {"n": 1})

    def refuse(state):
        raise ValueError("no")

    with pytest.raises(ValueError):
        log.change(refuse)
    assert log.change(lambda s: None) == (1, {"n": 1}) and log.versions() == [1]
    assert all(n.endswith(".json") for n in os.listdir(tmp_path))


def test_a_writer_that_loses_sees_what_the_other_left(tmp_path):
    log, other, seen = commits.Log(str(tmp_path)), commits.Log(str(tmp_path)), []

    def make(state):
        seen.append(state.get("n", 0))
        if len(seen) == 1:
            other.change(lambda s: {"n": 5})
        return {"n": state.get("n", 0) + 1}

    assert log.change(make) == (2, {"n": 6}) and seen == [0, 5]


def test_stores_whose_rename_overwrites_are_refused():
    with pytest.raises(ValueError):
        commits.store("s3://bucket/log")


ROW = "k long, v string"


def test_table_appends_batches_once_and_replaces_whole(spark, tmp_path):
    table, rows = commits.Table(spark, str(tmp_path / "t")), spark.range(10).selectExpr("id AS k", "'a' AS v")
    assert table.read(ROW).count() == 0
    table.append(rows, "w", 0)
    table.append(rows, "w", 0)
    table.append(rows, "w", 1)
    assert table.read(ROW).count() == 20
    before = table.read(ROW)
    version = table.replace(table.read(ROW).distinct())
    assert table.read(ROW).count() == 10 and before.count() == 20
    assert table.read(ROW, version - 1).count() == 20
    assert len(table.vacuum()) == 2 and table.read(ROW).count() == 10


def test_replace_after_another_write_is_refused(spark, tmp_path):
    table, other = (commits.Table(spark, str(tmp_path / "t")) for _ in range(2))
    rows = spark.range(3).selectExpr("id AS k", "'a' AS v")
    table.append(rows)
    write = table._write

    def late(df, **options):
        folder = write(df, **options)
        other.append(rows)
        return folder

    table._write = late
    with pytest.raises(commits.Stale):
        table.replace(rows.limit(1))
    assert table.read(ROW).count() == 6


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    rows = spark.range(5).selectExpr("id AS k", "'a' AS v")

    def write(n):
        return [commits.Table(spark, str(tmp_path / "t")).append(rows, f"w{n}", b) for b in (0, 1, 1)]

    with futures.ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    assert commits.Table(spark, str(tmp_path / "t")).read(ROW).count() == 30


# --- cubes -----------------------------------------------------------------------------------------------------------


def put(path, sequence, numbers, height=3, width=4, compressed=False):
    values = np.arange(len(numbers) * height * width, dtype=np.float32).reshape(len(numbers), height, width)
    content = frames.cube(values, np.array(numbers), 60.0 * np.array(numbers), sequence)
    if compressed:
        import io

        held = np.load(io.BytesIO(content))
        out = io.BytesIO()
        np.savez_compressed(out, **{n: held[n] for n in held.files})
        content = out.getvalue()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(content)
    return {(sequence, n, r, c): float(values[k, r, c]) for k, n in enumerate(numbers) for r in range(height) for c in range(width)}


def pixels(df):
    return {(r.sequence_id, r.frame_idx, r.row_idx, r.col_idx): r.intensity for r in df.collect()}


@pytest.mark.parametrize("share", [1, 500, 1 << 26])
def test_cubes_are_read_as_pixels_and_as_frames(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(frames, "SHARE_BYTES", share)
    wanted = put(f"{tmp_path}/c/a.npz", "a", range(5)) | put(f"{tmp_path}/c/deep/b.npz", "b", [7, 9, 10], compressed=True)
    read = spark.read.format("frames").load(f"{tmp_path}/c")
    assert pixels(read) == wanted
    whole = spark.read.format("frames").option("rows", "frames").load(f"file://{tmp_path}/c").collect()
    assert {(r.sequence_id, r.frame_idx, r.time_s, r.height, r.width) for r in whole} == {(s, n, 60.0 * n, 3, 4) for s, n, _, _ in wanted}
    assert all(r.intensity[4] == wanted[(r.sequence_id, r.frame_idx, 1, 0)] for r in whole)


def test_conditions_reach_the_source(spark, tmp_path):
    wanted = put(f"{tmp_path}/a.npz", "a", range(20)) | put(f"{tmp_path}/b.npz", "b", range(20))
    read = spark.read.format("frames").load(str(tmp_path))
    cases = [
        (F.col("frame_idx") == 3, lambda s, n: n == 3),
        (F.col("frame_idx").isin(3, 5, 99), lambda s, n: n in (3, 5)),
        ((F.col("frame_idx") >= 4) & (F.col("frame_idx") < 6), lambda s, n: 4 <= n < 6),
        ((F.col("frame_idx") > 17) & (F.col("sequence_id") == "b"), lambda s, n: n > 17 and s == "b"),
        ((F.col("sequence_id") == "a") & (F.col("sequence_id") == "b"), lambda s, n: False),
        ((F.col("frame_idx") % 7 == 0) & (F.col("frame_idx") <= 15), lambda s, n: n % 7 == 0 and n <= 15),
        ((F.col("frame_idx") == 1) | (F.col("sequence_id") == "b"), lambda s, n: n == 1 or s == "b"),
    ]
    for condition, chosen in cases:
        kept = {k: v for k, v in wanted.items() if chosen(*k[:2])}
        pushed = spark.read.format("frames").option("push", "true").load(str(tmp_path))
        assert pixels(pushed.filter(condition)) == pixels(read.filter(condition)) == kept
    both = read.filter(cases[0][0]).unionByName(read.filter(cases[3][0]))
    assert both.count() == 2 * 12 + 2 * 12
    assert pixels(frames.scan(spark, str(tmp_path), ["b"], 3, 4)) == {k: v for k, v in wanted.items() if k[0] == "b" and k[1] in (3, 4)}
    assert frames.scan(spark, str(tmp_path), []).count() == 0 and frames.scan(spark, str(tmp_path), last=0).count() == 24
    reader = frames.PushedFramesReader(str(tmp_path), True, None, frames.Wanted())
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([EqualTo(("frame_idx",), 3), GreaterThan(("time_s",), 1.0), StringContains(("sequence_id",), "a")]))
    assert left == [GreaterThan(("time_s",), 1.0), StringContains(("sequence_id",), "a")] and reader.wanted.numbers == {3}
    plan = spark.read.format("frames").option("push", "true").load(str(tmp_path)).filter("frame_idx = 3 AND row_idx = 1")._jdf.queryExecution().executedPlan().toString()
    above = next(line for line in plan.split("\n") if "Filter" in line)
    assert "row_idx" in above and "frame_idx" not in above, plan


def test_only_chosen_frames_are_read(tmp_path, monkeypatch):
    put(f"{tmp_path}/a.npz", "a", range(30))
    reader, taken = frames.FramesReader(str(tmp_path), True, None, frames.Wanted()), []
    reader.wanted.numbers = frozenset([4, 21])
    frame = frames.Cube.frame
    monkeypatch.setattr(frames.Cube, "frame", lambda self, place: taken.append(place) or frame(self, place))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 24 and taken == [4, 21]


@pytest.mark.parametrize("content", [b"", b"PK no zip", None])
def test_files_that_are_no_cubes_fail(spark, tmp_path, content):
    with open(f"{tmp_path}/x.npz", "wb") as file:
        if content is None:
            np.savez(file, intensity=np.zeros((1, 2, 2)))
        else:
            file.write(content)
    with pytest.raises(Exception, match="no cube of frames"):
        spark.read.format("frames").load(str(tmp_path)).collect()


def test_an_empty_folder_has_no_frames(spark, tmp_path):
    assert spark.read.format("frames").load(str(tmp_path)).count() == 0


# --- recorder --------------------------------------------------------------------------------------------------------


def made(spark, sequence, numbers, height=2, width=3):
    rows = [(sequence, n, 60.0 * n, height, width, [float(n * 100 + k) for k in range(height * width)]) for n in numbers]
    return spark.createDataFrame(rows, frames.ROWS)


def record(df, path, **options):
    df.write.format("frames").mode("append").options(**options).save(path)


def stored(spark, path, **options):
    return sorted((r.sequence_id, r.frame_idx) for r in spark.read.format("frames").options(rows="frames", **options).load(path).collect())


def test_recording_goes_on_in_order_and_can_be_read_back(spark, tmp_path):
    path = str(tmp_path / "run")
    record(made(spark, "a", range(4)).repartition(3), path)
    record(made(spark, "a", range(4, 6)).unionByName(made(spark, "b", range(2))).repartition(4), path)
    assert stored(spark, path) == [("a", n) for n in range(6)] + [("b", 0), ("b", 1)]
    assert stored(spark, path, version=1) == [("a", n) for n in range(4)]
    back = spark.read.format("frames").load(path).filter("frame_idx = 5 AND sequence_id = 'a'")
    assert pixels(back) == {("a", 5, k // 3, k % 3): 500.0 + k for k in range(6)}
    rows = {r.sequence_id: r for r in frames.index(spark, [path, str(tmp_path / "none")]).collect()}
    assert (rows["a"].frames, rows["a"].low, rows["a"].high, rows["a"].end_s, rows["a"].version) == (6, 0.0, 505.0, 300.0, 2)
    assert rows["a"].mean == pytest.approx(252.5)


@pytest.mark.parametrize("numbers", [[3], [1, 2], [0, 2], [0, 0], [-1, 0]])
def test_frames_that_are_not_next_are_refused_whole(spark, tmp_path, numbers):
    path = str(tmp_path / "run")
    record(made(spark, "b", [0]), path)
    with pytest.raises(Exception, match="is next"):
        record(made(spark, "b", [1]).unionByName(made(spark, "a", numbers)), path)
    assert stored(spark, path) == [("b", 0)] and len(glob.glob(f"{path}/parts/*")) == 1
    record(made(spark, "b", [1]).unionByName(made(spark, "a", [0])), path)
    assert stored(spark, path) == [("a", 0), ("b", 0), ("b", 1)]


def test_a_repeated_batch_is_recorded_once(spark, tmp_path):
    path = str(tmp_path / "run")
    for batch, numbers in ((0, [0, 1]), (0, [0, 1]), (1, [2]), (1, [2]), (0, [0, 1])):
        record(made(spark, "a", numbers), path, writer="w", batch=str(batch))
    assert stored(spark, path) == [("a", n) for n in range(3)] and len(glob.glob(f"{path}/parts/*")) == len(frames.parts(path))


def test_a_failed_task_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "run")
    bad = made(spark, "a", [0, 1]).unionByName(made(spark, "a", [2]).withColumn("height", F.lit(9))).repartition(3)
    with pytest.raises(Exception, match="has 6 values"):
        record(bad, path)
    assert frames.parts(path) is None and stored(spark, path) == []
    with pytest.raises(Exception, match="needs sequence_id"):
        record(made(spark, "a", [0]).withColumn("sequence_id", F.lit(None).cast("string")), path)
    record(made(spark, "a", [0, 1]), path)
    assert stored(spark, path) == [("a", 0), ("a", 1)]


def test_overwriting_and_other_columns_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="never overwritten"):
        made(spark, "a", [0]).write.format("frames").mode("overwrite").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="frames are written as"):
        spark.range(1).write.format("frames").mode("append").save(str(tmp_path / "x"))


def test_long_recordings_keep_their_full_list_now_and_then(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    monkeypatch.setattr(frames, "FULL_LIST", 4)
    for n in range(11):
        part = frames.FramesWriter(path, None, None)
        rows = pa_rows("a", n)
        part.commit([part.write(iter([rows])), None])
        assert [p["first"] for p in frames.parts(path)] == list(range(n + 1))
    assert [p["first"] for p in frames.parts(path, 6)] == list(range(6))
    sizes = [len(json.load(open(f))["parts"]) for f in sorted(glob.glob(f"{path}/log/*"))]
    assert sizes == [1, 1, 1, 4, 1, 1, 1, 8, 1, 1, 1]


def pa_rows(sequence, n):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"sequence_id": [sequence], "frame_idx": [n], "time_s": [None], "height": pa.array([1], pa.int32()), "width": pa.array([2], pa.int32()), "intensity": pa.array([[1.0, float("nan")]], pa.list_(pa.float32()))})


def test_a_stream_records_each_batch_once(spark, tmp_path):
    path, source = str(tmp_path / "run"), str(tmp_path / "in")
    for k in range(3):
        made(spark, "a", [2 * k, 2 * k + 1]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frames.ROWS).parquet(source)
        query = stream.writeStream.format("frames").option("checkpointLocation", str(tmp_path / "state")).option("path", path).trigger(availableNow=True).start()
        query.awaitTermination()
        assert stored(spark, path) == [("a", n) for n in range(2 * k + 2)]
    # The sink has the last batch, the query has lost that it ended: after a restart the batch comes again.
    last = max(glob.glob(f"{tmp_path}/state/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.unlink(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.unlink(crc)
    stream = spark.readStream.schema(frames.ROWS).parquet(source)
    stream.writeStream.format("frames").option("checkpointLocation", str(tmp_path / "state")).option("path", path).trigger(availableNow=True).start().awaitTermination()
    assert stored(spark, path) == [("a", n) for n in range(6)] and len(glob.glob(f"{path}/parts/*")) == len(frames.parts(path))


def test_frames_are_assembled_from_pixels(spark):
    rows = [("a", 0, 0.0, r, c, float(10 * r + c)) for r in range(3) for c in range(2) if (r, c) not in ((0, 0), (1, 1), (2, 1))]
    df = spark.createDataFrame(rows, frames.PIXELS)
    got = frames.assemble(df, 3, 2, -1.0).first()
    assert got.intensity == [-1.0, 1.0, 10.0, -1.0, 20.0, -1.0] and (got.height, got.width) == (3, 2)
    with pytest.raises(Exception, match="outside"):
        frames.assemble(df, 2, 2).collect()
