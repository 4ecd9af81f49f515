"""Bounds, errors and files that the tables' queries do not reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kinelake.functions import encodings, robots, text
from kinelake.operators import sampling
from kinelake.sources import files


def test_grippers_go_there_and_back(spark):
    for g in (robots.LEADER, robots.FOLLOWER):
        x = F.lit(0.3)
        row = spark.range(1).select(g.position_share(g.position_of(x)), g.joint_share(g.joint_of(x)), g.position_share(g.position_at(g.joint_of(x))), g.joint_share(g.joint_at(g.position_of(x)))).first()
        assert all(abs(v - 0.3) < 1e-12 for v in row) and g.joint[0] < g.joint_mid < g.joint[1]
    ends = spark.range(1).select(robots.followed_position(F.lit(robots.LEADER.position[1])), robots.followed_joint(F.lit(robots.LEADER.joint[0]))).first()
    assert ends[0] == pytest.approx(robots.FOLLOWER.position[1]) and ends[1] == pytest.approx(robots.FOLLOWER.joint[0])


def test_codebooks():
    assert encodings.codebook_bins("fsq", 1024) == (8, 5, 5, 5) and encodings.codebook_bins("square", 4096) == (64, 64) and encodings.codebook_bins("signs", 8) == (2, 2, 2)
    for kind, size in (("fsq", 1000), ("fsq", 512), ("square", 512), ("other", 1024)):
        with pytest.raises(ValueError):
            encodings.codebook_bins(kind, size)
    with pytest.raises(ValueError):
        encodings.sincos_grid(F.lit(0), F.lit(0), 6)


def test_bytes(spark):
    assert spark.range(1).select(text.from_bytes(F.encode(F.lit("h\u00e9 \u65e5"), "UTF-8"))).first()[0] == "h\u00e9 \u65e5"


def test_drawn_codes_follow_the_probabilities(spark):
    n = 20_000
    p = spark.range(n).select(sampling.chosen_code(F.array(F.lit(0.0), F.log(F.lit(3.0))), 1.0, sampling.uniform(F.col("id"), 1)).alias("c"))
    assert abs(p.agg(F.avg("c")).first()[0] - 0.75) < 0.02


def test_loader(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        sampling.loaded(df, "id", 11)
    assert sampling.loaded(df, "id", 4, 3).count() == 24
    assert sampling.batches(df, "id", 4, most_rows=7).count() == 4


def test_corrupt_files_are_left_out_when_asked(spark, tmp_path):
    folder = f"{tmp_path}/steps"
    spark.range(5).coalesce(1).write.parquet(folder)
    (tmp_path / "steps" / "bad.parquet").write_bytes(b"not a table")
    schema = spark.range(1).schema
    assert files.read_steps(spark, folder, schema, skip_corrupt=True).count() == 5
    with pytest.raises(Exception):
        files.read_steps(spark, folder, schema).collect()


def test_dataset_info_and_windows(spark, tmp_path):
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "info.json").write_text(json.dumps({"fps": 50, "other": [1]}, indent=1))
    (meta / "tasks.jsonl").write_text('{"task_index": 0, "task": "lift"}\n{"task_index": 1, "task": "put"}\n')
    assert files.read_dataset_info(spark, str(tmp_path)) == (50.0, {0: "lift", 1: "put"})
    assert files.window_steps([0.0, 0.02, 0.98], 50) == [0, 1, 49]
    with pytest.raises(ValueError):
        files.window_steps([0.03], 50)


def test_probe_and_lines(spark, tmp_path):
    df = spark.sql("SELECT named_struct('images', named_struct('top', 1, 'top_depth', 2), 'qvel', array(0.0D)) AS observations, 1 AS action")
    assert files.probed(df.schema) == (["top"], True, False) and files.probed(spark.range(1).schema) == ([], False, False)
    for _ in range(2):
        files.write_lines(df.select("action", "observations.qvel"), f"{tmp_path}/lines")
    assert [r.action for r in spark.read.json(f"{tmp_path}/lines").collect()] == [1, 1]
