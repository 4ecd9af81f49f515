"""Windows over cut-up episodes against the plain ones; record files and named sources."""

from __future__ import annotations

import datetime
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import blocks as B
from kinelake.operators import episodes as E
from kinelake.operators import statistics as S
from kinelake.sources import records, registry


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for e, n in [(0, 400), (1, 1), (2, 37), (3, 16), (None, 9), (5, 64)]:  # one episode holds most steps
        value = 0.0
        for k in range(n):
            value += rng.choice([0, 0, 0, 0.5, 5]) if rng.random() < 0.9 else 50
            rows.append((e, k, t0 + datetime.timedelta(seconds=k * 7 + rng.randrange(5)), value, rng.choice(["a", "b", None]), rng.random() < 0.97))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "e int, step int, ts timestamp, value double, kind string, there boolean").cache()


def same(a, b, *columns):
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    got, want = rows(a), rows(b)
    assert got == want and want


SIZES = (1, 3, 16, 1000)


@pytest.mark.parametrize("size", SIZES)
def test_cut_windows_are_the_plain_ones(events, size):
    blocks, v = B.Strided("e", "step", size), F.array("value")
    assert B.largest(events.where("e IS NOT NULL"), blocks) <= size
    same(B.with_idle(events, blocks, v, 1.0), E.with_idle(events, "e", "step", v, 1.0), "e", "step", "idle")
    idle = E.with_idle(events, "e", "step", v, 1.0).cache()
    same(B.runs(idle, blocks, "idle"), E.runs(idle, "e", "step", "idle"), "e", "idle", "start", "length")
    for args in ((1.0, 7, 16, 10), (1.0, 2, 3, 0), (100.0, 1, 1, 0)):
        same(B.keep_ranges(events, blocks, v, *args), E.keep_ranges(events, "e", "step", v, *args), "e", "start", "end")
    for horizon in (1, 4, 40):
        same(B.action_chunks(events, blocks, "value", horizon), E.action_chunks(events, "e", "step", "value", horizon), "e", "step", "chunk")
    frames = events.where("there").select("e", "step", (F.col("value") * 2).alias("frame"))
    s = events.select("e", "step")
    same(B.joined_until_missing(s, frames, blocks), E.joined_until_missing(s, frames, "e", "step"), "e", "step", "frame")
    for n in (2, 5, 50):
        a, b = (df.withColumn("rate", F.round("rate", 9)) for df in (B.arrival_rate(events, blocks, "ts", n), E.arrival_rate(events, "e", "ts", n)))
        same(a, b, "e", "step", "rate")
    a, b = (df.withColumn("average", F.round("average", 6)) for df in (B.moving_average(events, blocks, "value", 0.9), S.moving_average(events, "e", "step", "value", 0.9)))
    same(a, b, "e", "average")


def test_a_null_flag_or_action_counts_as_itself(events):
    blocks = B.Strided("e", "step", 4)
    same(B.runs(events, blocks, "kind"), E.runs(events, "e", "step", "kind"), "e", "kind", "start", "length")


@pytest.mark.parametrize("most", SIZES)
def test_cuts_of_any_order(events, most):
    cuts = B.cut_points(events, "e", "ts", most)
    if most < 100:
        assert cuts.points and B.largest(events.where("e IS NOT NULL"), cuts) <= 3 * most + 2
    else:
        assert not cuts.points
    same(B.with_step_index(events, cuts, "n"), E.with_step_index(events, "e", "ts", "n"), "e", "step", "n")
    kinds = {"total": ("sum", F.col("step")), "least": ("min", F.col("value")), "seen": ("last", F.col("kind"))}
    ahead, rest = "(PARTITION BY e ORDER BY ts ROWS UNBOUNDED PRECEDING)", "(PARTITION BY e ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    plain = events.selectExpr("e", "step", f"sum(step) OVER {ahead} AS total", f"min(value) OVER {ahead} AS least", f"last(kind, true) OVER {ahead} AS seen")
    same(B.running(events, cuts, kinds), plain, "e", "step", "total", "least", "seen")
    back = events.selectExpr("e", "step", f"sum(step) OVER {rest} AS total", f"last(kind, true) OVER {rest} AS seen")
    same(B.running(events, cuts, {k: kinds[k] for k in ("total", "seen")}, backwards=True, own=False), back, "e", "step", "total", "seen")
    left, right = events.where("kind = 'a'").select("step", "e", "ts"), events.where("kind = 'b'").select("e", (F.date_trunc("minute", "ts")).alias("ts"), "value").dropDuplicates(["e", "ts"])
    same(B.as_of(left, right, "e", "ts", "value", most), E.as_of(left, right, "e", "ts", "value"), "e", "step", "value")


def test_hot_episode_is_many_tasks(spark):
    steps = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 400).alias("e"), F.col("id").alias("ts"))
    cuts = B.cut_points(steps, "e", "ts", 500)
    assert B.largest(steps, cuts) <= 1500
    numbered = B.with_step_index(steps, cuts)
    assert numbered.where("e = 0").agg(F.max("step")).first()[0] == steps.where("e = 0").count() - 1
    assert B.largest(numbered, B.Strided("e", "step", 500)) <= 500


def plain_crc(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c_known_values():
    rng = np.random.default_rng(0)
    spans = [b"", b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), *[rng.integers(0, 256, n, np.uint8).tobytes() for n in (1, 63, 64, 65, 127, 128, 129, 1000, 4097)]]
    size = np.array(list(map(len, spans)))
    got = records.crc32c(np.frombuffer(b"".join(spans), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [plain_crc(s) for s in spans]
    assert [hex(x) for x in got[1:5]] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43", "0x46dd794e"]  # published check values


def test_varints_and_features_by_hand():
    assert records.varints(np.frombuffer(b"\x00\x7f\x80\x01\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01", np.uint8)).tolist() == [0, 127, 128, -1]
    # features { feature { key: "a" value { int64_list { value: 3 value: 300 } } } }, not packed; and the same packed
    for body in (b"\x0a\x0e\x0a\x0c\x0a\x01a\x12\x07\x1a\x05\x08\x03\x08\xac\x02", b"\x0a\x0e\x0a\x0c\x0a\x01a\x12\x07\x1a\x05\x0a\x03\x03\xac\x02"):
        schema = records.probed(body)
        assert schema.simpleString() == "struct<a:array<bigint>>"
        assert records.decode([body, b""], schema).to_pylist() == [{"a": [3, 300]}, {"a": None}]
    unpacked_floats = b"\x0a\x13\x0a\x11\x0a\x01f\x12\x0c\x12\x0a\x0d\x00\x00\x80\x3f\x0d\x00\x00\x00\xc0"
    assert records.decode([unpacked_floats], records.probed(unpacked_floats)).to_pylist() == [{"f": [1.0, -2.0]}]
    with pytest.raises(records.Corrupt):
        records.features(b"\x0a\x50\x0a")


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


def read_in_splits(data, step, **more):
    return [b for lo in range(0, len(data), step) for batch in records.read_records(Bytes(data), len(data), lo, min(lo + step, len(data)), **more) for b in batch]


def test_records_split_at_any_byte():
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.choice([0, 1, 11, 12, 200, 3000])) for _ in range(60)]
    bodies[7] = records.frame([b"a record file", b"within a record"])
    data = records.frame(bodies)
    (n,) = struct.unpack_from("<Q", data)
    assert n == len(bodies[0])
    for step in (400, 1000, 4096, 10**6):
        for slab in (64, 500, 1 << 20):
            assert read_in_splits(data, step, slab=slab) == bodies


def test_corrupt_records_are_refused_or_skipped():
    bodies = [bytes([i]) * 500 for i in range(20)]
    data = bytearray(records.frame(bodies))
    data[5 * 516 + 100] ^= 1  # a body
    data[9 * 516] ^= 1  # a length
    for step in (700, 10**6):
        with pytest.raises(records.Corrupt):
            read_in_splits(bytes(data), step)
        assert read_in_splits(bytes(data), step, skip_corrupt=True) == [b for i, b in enumerate(bodies) if i not in (5, 9)]
    cut = bytes(records.frame(bodies))[:-300]
    with pytest.raises(records.Corrupt):
        read_in_splits(cut, 10**6)
    assert read_in_splits(cut, 10**6, skip_corrupt=True) == bodies[:-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records"))
    rows = [(i, [i * 0.5, -1.0], [f"go {i}"], [2**40 + i, -i], i % 2 == 0, None if i % 5 else "x", bytes([i])) for i in range(200)]
    schema = "episode long, state array<float>, prompt array<string>, ids array<long>, done boolean, note string, raw binary"
    df = spark.createDataFrame(rows, schema)
    registry.write_records(df, path, files=8)
    return path, df


def test_records_written_and_read_back(spark, folder):
    path, df = folder
    for split in (300, 1 << 20):
        back = spark.read.format("episode_records").schema(df.schema).option("splitBytes", split).load(path)
        same(back, df, *df.columns)
    probed = spark.read.format("episode_records").load(path)
    assert dict(probed.dtypes)["ids"] == "array<bigint>" and probed.where("element_at(episode, 1) = 3").select("prompt").first()[0] == [b"go 3"]


def test_episode_filters_leave_files_unopened(spark, folder):
    path, df = folder
    back = spark.read.format("episode_records").schema(df.schema).load(path)
    assert back.rdd.getNumPartitions() == 8
    one = back.where("episode = 60")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    few = back.where("episode >= 20 AND episode < 40 AND done")
    assert few.rdd.getNumPartitions() <= 3 and few.count() == 10
    assert back.where("episode IN (1, 199)").rdd.getNumPartitions() == 2
    assert back.where("episode > 5000").count() == 0  # no file is left


def test_named_sources(spark, folder, tmp_path):
    path, _ = folder
    rows = registry.open_source(spark, "field_arm", path).where("episode < 25")
    assert rows.columns == ["episode", "joint_position", "gripper_position", "actions", "prompt"] and rows.count() == 25
    steps = spark.range(1000).selectExpr("id div 10 AS episode_index", "id % 10 AS frame_index", "0L AS task_index", "array(float(id)) AS state", "array(float(1)) AS actions", "id AS unread")
    steps.coalesce(1).write.option("parquet.block.size", 2048).parquet(str(tmp_path / "p"))
    own = registry.open_source(spark, "two_arm", str(tmp_path / "p"))
    assert own.count() == 1000 and own.where("episode_index = 7").count() == 10 and "unread" not in own.columns
    fake = registry.open_source(spark, "fake", rows=50, seed=3, size=4, partitions=3)
    again = registry.open_source(spark, "fake", rows=50, seed=3, size=4, partitions=7)
    same(fake, again, "state", "actions")
    assert fake.where("size(state) = 4 AND forall(state, x -> x >= -1 AND x < 1)").count() == 50
    with pytest.raises(ValueError):
        registry.open_source(spark, "nowhere")
    with pytest.raises(ValueError):
        registry.add_source("fake", registry.Source("episode_parquet"))


def test_an_append_adds_files_and_an_overwrite_replaces_them(spark, tmp_path):
    path = str(tmp_path / "r")
    a = spark.range(5).selectExpr("id AS episode")
    for mode, n in (("append", 5), ("append", 10), ("overwrite", 5)):
        registry.write_records(a, path, files=2, mode=mode)
        assert spark.read.format("episode_records").schema("episode long").load(path).count() == n
