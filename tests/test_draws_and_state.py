"""Permutations, noise, mergeable statistics, time windows, versions of folders, and the broker with timers."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from kinelake.functions import noise
from kinelake.operators import blocks as B
from kinelake.operators import shuffle, sketch
from kinelake.operators import time_windows as W
from kinelake.sources import versions
from kinelake.streaming import broker


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 100, 1009, 4001])
def test_permutations_are_bijections_and_differ(spark, n):
    rows = spark.range(n).select("id", *[shuffle.Permutation(n, s, e).place(F.col("id")).alias(f"p{s}{e}") for s, e in ((0, 0), (0, 1), (5, 0))]).collect()
    for c in ("p00", "p01", "p50"):
        assert sorted(r[c] for r in rows) == list(range(n))
    if n > 90:
        assert len({tuple(r[c] for r in rows) for c in ("p00", "p01", "p50")}) == 3
        assert sum(r.p00 == r.id for r in rows) < n / 10 and abs(sum((r.p00 - r.id) for r in rows[: n // 2])) > 0
        # far from the identity: the mean move of a random order is a third of n
        assert abs(sum(abs(r.p00 - r.id) for r in rows) / n - n / 3) < 1.2 * n**0.5
        # neighbours part
        assert sum(abs(a.p00 - b.p00) for a, b in zip(rows, rows[1:])) / n > 0.2 * n


def test_permutation_of_a_great_number(spark):
    n = 10**12 + 39
    got = spark.range(n - 500, n).select(shuffle.Permutation(n, 1).place(F.col("id")).alias("p")).collect()
    assert len({r.p for r in got}) == 500 and all(0 <= r.p < n for r in got)


@pytest.mark.parametrize("n, size", [(10, 100), (1000, 64), (1024, 64), (999, 1000), (5, 1)])
def test_buffered_shuffles_stay_near(spark, n, size):
    for epoch in (0, 1):
        rows = shuffle.buffered(spark.range(n), "id", n, size, 3, epoch).collect()
        assert sorted(r.place for r in rows) == list(range(n))
        assert all(abs(r.place - r.id) < max(size, 1) or n <= size for r in rows)


def test_epochs_have_full_batches_and_no_range_sort(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    rows = shuffle.epochs(df, "k", 10, 3, 1).collect()
    for e in range(3):
        own = [r for r in rows if r.epoch == e]
        assert sorted(r.place for r in own) == list(range(100)) and {r.batch for r in own} == set(range(10))
    plan = shuffle.shuffled(spark.range(1000), "id", 1000)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    with pytest.raises(ValueError):
        shuffle.epochs(df, "k", 200, 1)


def test_noise_is_the_inverse_and_has_the_moments(spark):
    us = [1e-9, 1e-4, 0.01, 0.02424, 0.02426, 0.3, 0.5, 0.77, 0.97574, 0.97576, 0.999999]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", noise.normal_of(F.col("u")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.u), rel=2e-9, abs=1e-9)
    n = 40_000
    for uniform in (noise.uniform_at, noise.uniform_by_digest):
        rows = spark.range(n // 4).select(F.explode(noise.normal_vector(4, 3, "x", F.col("id"), uniform=uniform)).alias("z"))
        m = rows.agg(F.avg("z").alias("a"), F.var_pop("z").alias("b"), F.skewness("z").alias("c"), F.kurtosis("z").alias("d")).first()
        assert abs(m.a) < 0.02 and abs(m.b - 1) < 0.03 and abs(m.c) < 0.05 and abs(m.d) < 0.12
    t = spark.range(n).select(noise.flow_time(1, F.col("id")).alias("t")).agg(F.avg("t"), F.min("t"), F.max("t")).first()
    assert abs(t[0] - (0.6 * 0.999 + 0.001)) < 0.005 and 0.001 <= t[1] and t[2] <= 1.0


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(300).select("id", F.expr("transform(sequence(1, 3), i -> array(double(i), 0D))").alias("actions"))
    z = noise.noise_like(F.col("actions"), 9, F.col("id")).alias("z")
    a = {r.id: r.z for r in df.repartition(2).select("id", z).collect()}
    b = {r.id: r.z for r in df.repartition(7).select("id", z).collect()}
    assert a == b and len({x for v in a.values() for row in v for x in row}) == 1800
    assert all(len(v) == 3 and all(len(r) == 2 for r in v) for v in a.values())


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 37).alias("part"), (noise.normal_of(noise.uniform_at(1, "s", F.col("id"))) * 3 + F.col("id") % 37 * 1e6).alias("x"))
    k = 256
    parts = sketch.states(rows, ["g", "part"], k)
    got = {r.g: r for r in sketch.merged(sketch.merged(parts.union(parts.limit(0)), ["g", "part"], k), ["g"], k).withColumn("q", F.kll_sketch_get_quantile_double("sketch", F.lit(0.99))).collect()}
    want = rows.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    for w in want:
        r = got[w.g]
        assert r.n == w.n and r.low == w.low and r.high == w.high
        assert r["mean"] == pytest.approx(w["mean"], rel=1e-12) and r.m2 / r.n == pytest.approx(w.v, rel=1e-9)
        rank = rows.where((F.col("g") == w.g) & (F.col("x") <= r.q)).count() / w.n
        assert abs(rank - 0.99) <= sketch.rank_error(k)
    assert sketch.rank_error(2048) < 0.002


def test_micro_batches_leave_states_that_merge(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.range(k * 100, k * 100 + 100).select(F.lit("a").alias("key"), F.col("id").cast("double").alias("x")).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("key string, x double").option("maxFilesPerTrigger", 1).parquet(source)
        sketch.keep_states(stream, out, ["key"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        r = sketch.statistics(sketch.read_states(spark, out, ["key"]), ["key"]).first()
        assert (r.n, r["mean"], r.q01, r.q99) == (400, 199.5, 3.0, 395.0) and r["std"] == pytest.approx(math.sqrt((400**2 - 1) / 12))


def plain_nearest(frames, t, tolerance):
    best = min(frames, key=lambda f: (abs(f[0] - t), f[0]), default=None)
    return best if best and abs(best[0] - t) <= tolerance else None


@pytest.mark.parametrize("most", [2, 10, 1000])
def test_time_windows_against_a_plain_search(spark, most):
    rng = random.Random(most)
    data = {e: sorted(rng.sample(range(1000), n)) for e, n in ((0, 1), (1, 40), (2, 7))}
    df = spark.createDataFrame([(e, float(t), t * 10) for e, ts in data.items() for t in ts], "e int, t double, v int")
    offsets, tolerance = [-300.0, -2.5, 0.0, 1.0, 17.0, 5000.0], 9.0
    got = {(r.e, r.t, r.k): (r.v, r.is_pad) for r in W.at_offsets(df, "e", "t", "v", offsets, tolerance, most).collect()}
    for e, ts in data.items():
        for t in ts:
            for k, o in enumerate(offsets):
                pad = t + o < ts[0] - tolerance or t + o > ts[-1] + tolerance
                hit = plain_nearest([(x, x * 10) for x in ts], min(max(t + o, ts[0]), ts[-1]), tolerance)
                assert got[e, t, k] == (hit[1] if hit else None, pad)
    assert len(got) == 48 * 6
    one = W.stacked(W.at_offsets(df, "e", "t", "v", [0.0, 0.0], tolerance, most), ["e", "t"], F.col("v")).where("e = 0").first()
    assert list(one.window) == [data[0][0] * 10] * 2


@pytest.mark.parametrize("size", [1, 4, 100])
def test_frame_windows_clamp_and_say_so(spark, size):
    df = spark.createDataFrame([(e, s, e * 100 + s) for e, n in ((0, 1), (1, 23)) for s in range(n)], "e int, step int, v int")
    offsets = [-6, 0, 3, 1, -1]
    got = {(r.e, r.step): (list(r.window), list(r.window_is_pad)) for r in W.at_frames(df, B.Strided("e", "step", size), "v", offsets).collect()}
    for (e, s), (window, pad) in got.items():
        n = 1 if e == 0 else 23
        assert window == [e * 100 + min(max(s + o, 0), n - 1) for o in offsets] and pad == [not 0 <= s + o < n for o in offsets]
    assert len(got) == 24 and W.offsets_in_frames([0, 0.1, -0.5], 30) == [0, 3, -15]


class Died(Exception):
    pass


def test_versions_appear_at_once(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"))
    assert v.version() == versions.NOTHING
    with pytest.raises(FileNotFoundError):
        v.read("a")
    first = v.replace({"a": spark.range(3), "b": spark.range(5)}, note="one")
    assert first.number == 0 and v.read("a").count() == 3 and v.version().extra == {"note": "one"}

    def die(*_):
        raise Died

    broken = versions.Versions(spark, str(tmp_path / "v"))
    broken._publish = die  # all files are written, and the writer ends before the manifest has its name
    with pytest.raises(Died):
        broken.replace({"a": spark.range(100)})
    assert v.read("a").count() == 3 and v.numbers() == [0]
    assert v.append({"a": spark.range(4)}).number == 1 and v.read("a").count() == 7 and v.read("b").count() == 5
    assert v.read("a", 0).count() == 3
    # two writers find the same number free; the second one goes on top of the first
    late = versions.Versions(spark, str(tmp_path / "v"))
    seen, stale = late.version, v.version()
    late.version = lambda number=None, told=[stale]: told.pop() if told and number is None else seen(number)
    v.append({"a": spark.range(1)})
    assert late.append({"a": spark.range(2)}).number == 3 and v.read("a").count() == 10
    v.expire(1)
    assert v.numbers() == [3] and v.read("a").count() == 10 and v.read("b").count() == 5
    assert len(list((tmp_path / "v" / "data").iterdir())) == 4


def test_a_repeated_micro_batch_is_written_once(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"))
    for run, batch in (("r", 0), ("r", 1), ("r", 1), ("r", 0), ("s", 0)):
        v.append({"m": spark.range(10)}, run, batch)
    assert v.read("m").count() == 30 and v.version().batches == {"r": 1, "s": 0}
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(10).coalesce(1).write.mode("append").parquet(source)
    for checkpoint in ("c1", "c2"):  # the second query has lost its checkpoint, and sends all batches again
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        versions.write_stream(stream, str(tmp_path / "w"), "m", "run").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        assert versions.Versions(spark, str(tmp_path / "w")).read("m").count() == 30


def test_broker_expires_restarts_and_takes_empty_chunks(spark, tmp_path):
    broker.use_state_store(spark)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    schema = "episode string, step long, chunk array<double>, second long"
    begun = spark.createDataFrame([("under way", [7.0, 8.0, 9.0], 1, 1_001_000)], "key string, chunk array<double>, used int, at long")

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds(F.col("second") + 1000))
        made = broker.broker_with_timers(stream, 2, 30, "episode", "step", "chunk", "ts", initial=begun)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(out).collect()]
        return sorted(got, key=repr)

    def new(old, now):
        left = list(now)
        for r in old:
            left.remove(r)
        return left

    a = send(("e", 0, [1.0, 2.0, 3.0], 0), ("e", 1, [10.0], 1), ("e", 2, [4.0], 2), ("f", 0, [], 1), ("f", 1, [5.0], 2), ("under way", 5, [1.0], 2))
    assert set(a) == {("e", 0, 0, 1.0, "given"), ("e", 1, 1, 2.0, "given"), ("e", 2, 0, 4.0, "given"), ("f", 0, 0, None, "none"), ("f", 1, 0, 5.0, "given"), ("under way", 5, 1, 8.0, "given")}
    # each call is a restart from the checkpoint: e's chunk is used up; null chunks give nothing
    b = send(("e", 3, None, 3), ("e", 4, [6.0, 6.5], 4))
    assert set(new(a, b)) == {("e", 3, 0, None, "none"), ("e", 4, 0, 6.0, "given")}
    # g moves time on by more than 30 s: the quiet episodes end
    c = send(("g", 0, [1.0], 100))
    d = send(("g", 1, [2.0], 101))
    assert {("e", None, None, None, "ended"), ("f", None, None, None, "ended"), ("under way", None, None, None, "ended")} <= set(new(b, d))
    e = send(("e", 5, [9.0], 102))
    assert set(new(d, e)) == {("e", 5, 0, 9.0, "given")} and c
