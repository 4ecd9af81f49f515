"""Parts that no query reaches: example rows, scales, stamps, streams of latest and first values."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from kinelake.functions import encodings, text
from kinelake.operators import episodes as E
from kinelake.operators import reshape
from kinelake.plans import pipelines as P
from kinelake.sources import examples, files
from kinelake.streaming import episodes as live


def test_example_rows_go_through_their_pipelines(spark):
    for make, name in ((examples.two_arm_rows, "two_arm_flow"), (examples.table_arm_rows, "table_arm_flow"), (examples.field_arm_rows, "field_arm_flow_discrete")):
        df = make(spark, 3, 1, 6)
        out = P.pipeline(name, model=P.model_group("flow", 32, size=(6, 6))).incoming()(df).collect()
        assert len(out) == 3 and all(set(r.image) == set(P.FLOW_VIEWS) and r.image_mask["base_0_rgb"] and r.image_mask["left_wrist_0_rgb"] for r in out)
        first = [bytes(r.image["base_0_rgb"].data) for r in out]
        assert len(set(first)) == 3 and all(len(b) == 108 for b in first)
        assert sorted(map(repr, df.collect())) == sorted(map(repr, make(spark, 3, 1, 6).repartition(2).collect()))
    assert examples.two_arm_rows(spark, 1, side=4).first().state == [1.0] * 14
    v = examples.table_arm_rows(spark, 50, side=2).select(F.explode("observation/state").alias("v")).agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert 0 < v[0] and v[1] < 1 and abs(v[2] - 0.5) < 0.06


def test_ones(spark):
    r = spark.range(1).select(*files.ones({"state": 3, "actions": 2})).first()
    assert r.state == [1.0] * 3 and r.actions == [1.0] * 2


def test_adapter_scales():
    assert encodings.adapter_scale(16, 4) == 4 and encodings.adapter_scale(16, 4, stabilised=True) == 8


def test_stamps(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 3, 5, 7, 8, 9),)], "t timestamp_ntz")
    assert df.select(text.stamp(F.col("t"))).first()[0] == "2024_03_05_07:08:09"


def test_depth_cameras_go(spark):
    views = F.create_map(*[F.lit(x) for k in ("top", "top_depth", "depth") for x in (k, 1)])
    assert spark.range(1).select(reshape.without_depth(views)).first()[0] == {"top": 1}


def test_one_choice_an_episode(spark):
    df = spark.range(900).select((F.col("id") % 60).alias("e")).withColumn("c", E.chosen_once(F.col("e"), [F.lit(x) for x in "abc"], 2))
    assert df.groupBy("e").agg(F.countDistinct("c").alias("n")).where("n <> 1").isEmpty()
    counts = {r.c: r["count"] for r in df.select("e", "c").distinct().groupBy("c").count().collect()}
    assert set(counts) == set("abc") and min(counts.values()) >= 8


def test_sampled_steps_draw_without_replacement(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("e"), F.col("id").alias("s"))
    rows = E.sampled_steps(df, "e", "s", 5, 7).collect()
    assert len({r.s for r in rows}) == 15 and all(sum(r.e == e for r in rows) == 5 for e in range(3))
    least = E.sampled_steps(df, "e", "s", 2, draw=-F.col("s")).collect()
    assert {r.s for r in least} == {94, 95, 96, 97, 98, 99}


@pytest.fixture
def stream(spark, tmp_path):
    source = str(tmp_path / "in")
    t0 = datetime.datetime(2024, 1, 1)
    for k in range(3):
        rows = [(e, t0 + datetime.timedelta(seconds=10 * k + e), float(10 * k + e)) for e in (0, 1)]
        spark.createDataFrame([*rows, rows[0]], "e int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(source)

    def run(make, mode, name):
        df = live.with_event_time(spark.readStream.schema("e int, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(source), "ts", "1 hour")
        q = make(df).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    return run


def test_streams_of_latest_first_and_running_values(stream):
    assert {(r.e, r.value) for r in stream(lambda d: live.latest(d, "e", "ts", "value"), "complete", "latest_values")} == {(0, 20.0), (1, 21.0)}
    assert len(stream(lambda d: live.first_seen(d, "e", "value"), "append", "first_values")) == 6
    stats = {r.e: r for r in stream(lambda d: live.running_stats(d.withColumn("x", F.col("value")), "e"), "complete", "running_values")}
    assert (stats[0].n, stats[0].low, stats[0].high) == (6, 0.0, 20.0) and stats[1].n == 3 and stats[1]["mean"] == pytest.approx(11.0)
