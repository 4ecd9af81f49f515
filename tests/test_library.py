"""Literal vectors, errors, round trips and streams."""

from __future__ import annotations

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import arrays, encodings, images, robots, text
from kinelake.operators import episodes, numbering, reshape, sampling, statistics
from kinelake.plans import pipelines
from kinelake.sources import codec, files
from kinelake.streaming import episodes as live


def one(df, column):
    return df.select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def unit(spark):
    return spark.range(1)


def lit2(rows):
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def test_delta_and_absolute(unit):
    state, actions = arrays.vector([1.0, 2.0, 3.0]), lit2([[3, 4, 5], [5, 6, 7]])
    delta = arrays.delta_actions(lit2([[3, 4], [5, 6]]), state, [False, True])
    assert one(unit, delta) == [[3, 2], [5, 4]]
    assert one(unit, arrays.delta_actions(actions, state, [False, True])) == [[3, 2, 5], [5, 4, 7]]
    assert one(unit, arrays.absolute_actions(actions, state, [False, True])) == [[3, 6, 5], [5, 8, 7]]
    assert one(unit, arrays.delta_actions(actions, state, None)) == [[3, 4, 5], [5, 6, 7]]
    assert arrays.bool_mask(2, -2, 2) == [True, True, False, False, True, True] and arrays.bool_mask(2, 0, 2) == [True] * 4


def test_padding_and_unnormalising_beyond_the_statistics(unit):
    x = arrays.vector([0.5, -0.5, 1.0])
    assert one(unit, arrays.pad_to(x, 5, F.lit(0.0))) == [0.5, -0.5, 1.0, 0.0, 0.0] and one(unit, arrays.pad_to(x, 2, F.lit(0.0))) == [0.5, -0.5, 1.0]
    assert one(unit, arrays.fit_to(x, 2, F.lit(0.0))) == [0.5, -0.5] and one(unit, arrays.valid_mask(x, 5)) == [True] * 3 + [False] * 2
    got = one(unit, arrays.unnormalize_z(x, [1.0, 2.0], [2.0, 3.0]))
    assert np.allclose(got, [0.5 * (2 + 1e-6) + 1, -0.5 * (3 + 1e-6) + 2, 1 + 1e-6])
    assert np.allclose(one(unit, arrays.unnormalize_q(x, [0.0, 0.0], [1.0, 2.0])), [0.75, 0.5, 1.0], atol=1e-5)
    assert one(unit, arrays.align_right(arrays.vector([1, 2, 0, 0]), F.lit(2))) == [0, 0, 1, 2] and one(unit, arrays.every(arrays.vector([1, 2, 3, 4, 5]), 2)) == [1, 3, 5]
    assert one(unit, arrays.put_at(arrays.vector([1, 2, 3]), F.lit(1), F.lit(9))) == [1, 9, 3]


def test_digitize_edges(unit):
    values = [-1.5, -1.0, -1e-17, 0.0, 0.999, 1.0, 2.0, math.nan]
    assert one(unit, F.array(*[encodings.digitize(F.lit(v)) for v in values])) == [-1, 0, 127, 128, 255, 255, 255, 255]
    rng = random.Random(1)
    xs = [rng.uniform(-1.2, 1.2) for _ in range(300)] + [i / 128 - 1 for i in range(256)] + [np.nextafter(i / 128 - 1, -2) for i in range(256)]
    want = [int(v) for v in np.digitize(xs, np.linspace(-1, 1, 257)[:-1]) - 1]
    assert one(unit, F.transform(arrays.vector([float(x) for x in xs]), lambda v: encodings.digitize(v))) == want


def test_codes(unit):
    for i in (0, 7, 123, 999):
        assert one(unit, encodings.codebook_index(encodings.codebook_levels(F.lit(i), (8, 5, 5, 5)), (8, 5, 5, 5))) == i
        assert one(unit, encodings.bits_index(encodings.bits_vector(F.lit(i), 10))) == i
    assert one(unit, encodings.token_to_action(encodings.token_to_action(F.lit(5), 1000), 1000)) == 5
    assert one(unit, encodings.block_mask(F.lit(5), F.lit(3), 2, 4)) is True
    with pytest.raises(ValueError):
        encodings.sincos(F.lit(1), 3, 1, 2)


def test_robots(unit):
    for g in (0.1, 0.5, 0.9):
        assert abs(one(unit, robots.gripper_from_angular_inverse(robots.gripper_from_angular(F.lit(g)))) - g) < 1e-12
    assert one(unit, robots.axis_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == [0, 0, 0]
    assert np.allclose(one(unit, robots.axis_angle(F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.5)), F.lit(math.cos(0.5)))), [0, 0, 1])
    assert one(unit, robots.clip_action(arrays.vector([2.0, -3.0, 0.7]))) == [1, -1, 1]


def test_text(unit):
    assert one(unit, text.clean_prompt(F.lit("  Pick_up\nthe Cup 　\x1f"))) == "Pick up the Cup" and one(unit, text.lower_prompt(F.lit(" Pick_Up\nit "))) == "pick up\nit"
    assert one(unit, text.action_part(F.lit("Task: x; Action: 1 2 3 | rest"))) == "1 2 3" and one(unit, text.action_part(F.lit("none"))) is None
    assert one(unit, text.last_part(F.lit("a_b_ep7.x.h5"))) == "ep7" and one(unit, text.slug(F.lit("a b c"))) == "a_b_c"
    assert one(unit, text.action_prompt(F.lit(" go_on "), arrays.vector([0.0, 1.0]))) == "Task: go on, State: 128 255;\nAction: "


def test_rename_and_paths(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', 2) AS a, 3 AS d")
    assert reshape.leaves(reshape.rename(df, {"a/b": "a/c", "a/c": None}).schema).keys() == {"a/c", "d"}
    with pytest.raises(ValueError, match="Key 'a/c' already exists in output"):
        reshape.rename(df, {"a/b": "a/c"})
    with pytest.raises(ValueError, match="alias|under a leaf"):
        reshape.rename(df, {"d": "a"})
    assert reshape.rename(df, {"a": None}).schema == df.schema and reshape.rename(df, {"a/.+": None}).columns == ["d"]
    assert reshape.leaves(reshape.rename(df, {"(.+)/c": r"\1/x"}).schema).keys() == {"a/b", "a/x", "d"}
    assert reshape.unflatten(reshape.flatten(df)).schema == df.schema
    packed = reshape.repack(spark.sql("SELECT named_struct('c', 1) AS b, named_struct('f', 2) AS e"), {"a": {"b": "b/c"}, "d": "e/f"})
    assert packed.first().asDict(True) == {"a": {"b": 1}, "d": 2}
    with pytest.raises(KeyError):
        reshape.repack(df, {"x": "no/path"})
    assert reshape.apply_leaves(df, {"a/b": lambda c: c + 1}).first().a.b == 2
    with pytest.raises(ValueError):
        reshape.apply_leaves(df, {"x": lambda c: c}, strict=True)
    assert reshape.select_paths(df, "a/.*") == ["a/b", "a/c"] and reshape.schema_difference(df.schema, df.select("d").schema).keys() == {"a/b", "a/c"}
    with pytest.raises(ValueError):
        reshape.require(df, {"x"})
    with pytest.raises(ValueError):
        reshape.require(df, {"d"}, {"d"})
    assert reshape.without_strings(spark.sql("SELECT 'a' AS s, 1 AS n")).columns == ["n"]


def test_task_prompt(spark):
    df = spark.createDataFrame([(1,)], "task_index int")
    assert reshape.with_task_prompt(df, {1: "Hello, world!"}).first().prompt == "Hello, world!"
    with pytest.raises(Exception, match="task_index=2 not found in task mapping"):
        reshape.with_task_prompt(spark.createDataFrame([(2,)], "task_index int"), {1: "x"}).collect()
    with pytest.raises(ValueError):
        reshape.with_task_prompt(df.withColumnRenamed("task_index", "t"), {1: "x"})
    assert reshape.with_default_prompt(df, "go").first().prompt == "go" and reshape.with_default_prompt(df, None).columns == ["task_index"]


def test_keep_ranges_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for e in range(30):
        n = int(rng.integers(1, 120))
        v = np.cumsum(rng.random((n, 2)) * (rng.random(n) < rng.choice([0.2, 0.6, 0.95]))[:, None], axis=0)
        rows += [(e, i, v[i].tolist()) for i in range(n)]
        idle = np.r_[False, (np.abs(np.diff(v, axis=0)) < 1e-3).all(1)]

        def stretches(flag):
            edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(int), 0]))
            return list(zip(edge[::2], edge[1::2]))

        keep = np.ones(n, bool)
        for a, b in stretches(idle):
            if b - a >= 7:
                keep[a:b] = False
        want |= {(e, int(a), int(b) - 10) for a, b in stretches(keep) if b - a >= 16}
    df = spark.createDataFrame(rows, "e int, t int, v array<double>")
    got = episodes.keep_ranges(df, "e", "t", F.col("v"))
    assert {tuple(r) for r in got.collect()} == want and want
    assert episodes.allow_frames(df, None, "e", "t").count() == len(rows)
    kept = episodes.allow_frames(df, got, "e", "t").count()
    assert kept == sum(b - a for _, a, b in want)


def test_chunks_at_the_end(spark):
    df = spark.createDataFrame([(0, i, i) for i in range(5)], "e int, t int, a int")
    got = {r.t: r.chunk for r in episodes.action_chunks(df, "e", "t", "a", 4).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [1, 2, 3, 4], 2: [2, 3, 4, 4], 3: [3, 4, 4, 4], 4: [4] * 4}


def test_norm_stats(spark):
    a = np.arange(12).reshape(4, 3)
    df = spark.createDataFrame([(r.tolist(),) for r in a.astype(float)], "state array<double>")
    got = {r.dim: r for r in statistics.norm_stats(statistics.vector_values(df, "state")).collect()}
    assert all(np.isclose(got[d]["mean"], a[:, d].mean()) and np.isclose(got[d]["std"], a[:, d].std()) for d in range(3))
    b = np.random.default_rng(0).random((2, 3, 4))
    nested = spark.createDataFrame([(x.tolist(),) for x in b], "v array<array<double>>")
    got = {r.dim: r for r in statistics.norm_stats(statistics.vector_values(nested, "v")).collect()}
    assert all(np.isclose(got[d]["mean"], b.reshape(-1, 4)[:, d].mean()) and got[d]["n"] == 6 for d in range(4))
    with pytest.raises(Exception, match="two values"):
        statistics.checked_stats(statistics.norm_stats(statistics.vector_values(df.limit(1), "state"))).collect()


def test_numbering_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(k,) for k in [None] * 5 + [3] * 40 + list(range(50))], "k long")
    got = numbering.with_row_index(df, "k").orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(95)) and [r.k for r in got][:5] == [None] * 5
    assert [r.k for r in got][5:] == sorted(r.k for r in got[5:])
    assert numbering.with_row_index(df.limit(0), "k").count() == 0
    assert sampling.rank_shard(df, "k", 2, 0).count() == 47 and sampling.repeated(df, 3).count() == 285
    with pytest.raises(ValueError):
        sampling.weighted_mix(df, "k", "k", {"a": 0.5}, 10)


def test_images(spark):
    rng = np.random.default_rng(0)
    for shape, out in (((10, 10), (20, 20)), ((30, 30), (15, 15)), ((50, 50), (50, 50)), ((256, 320), (60, 80))):
        assert images.resize_with_pad(np.zeros((*shape, 3), np.uint8), *out).shape == (*out, 3)
        assert not images.resize_with_pad(np.zeros((*shape, 3), np.uint8), *out).any()
    a = rng.integers(0, 256, (8, 6, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, images.to_row(a)), (2, None)], f"id int, image {images.IMAGE}")
    for f, want in ((images.flipped_channels, a[:, :, ::-1]), (images.turned, a[::-1, ::-1]), (images.left_half, a[:, :3]), (images.right_half, a[:, 3:])):
        got = {r.id: r.v for r in df.select("id", f(F.col("image")).alias("v")).collect()}
        assert (images.to_array(got[1]) == want).all() and got[2] is None
    x = df.where("id = 1").select(images.scaled(F.col("image")).alias("v"), images.beside(F.col("image"), F.col("image")).alias("w"), images.augmented(F.col("image"), F.col("id")).alias("g")).first()
    assert np.allclose(x.v, a.ravel() / 255 * 2 - 1, atol=1e-6) and (x.w.height, x.w.width) == (8, 12) and (x.g.height, x.g.width) == (8, 6)
    black, there = images.or_black(F.col("image"), 8, 6)
    assert [(r.t, any(r.b.data)) for r in df.orderBy("id").select(black.alias("b"), there.alias("t")).collect()] == [(True, True), (False, False)]


def test_wire_round_trip():
    for v in (np.zeros(()), np.arange(6, dtype=np.int16).reshape(2, 3), np.array([np.nan, np.inf, -np.inf]), np.array([True, False]), np.array(["ab", "c"])):
        w = codec.pack_array(v)
        assert np.array_equal(codec.unpack_array(**w), v, equal_nan=v.dtype.kind == "f")
    for bad in (np.array([object()]), np.array([1j])):
        with pytest.raises(ValueError):
            codec.pack_array(bad)


def test_files(spark, tmp_path):
    d = f"file://{tmp_path}"
    stats = spark.createDataFrame([("state", [1.0], [2.0], [0.0], [3.0])], "key string, mean array<double>, std array<double>, q01 array<double>, q99 array<double>")
    files.write_norm_stats(spark, f"{d}/assets", stats)
    assert files.read_norm_stats(spark, f"{d}/assets").collect() == stats.collect()
    with pytest.raises(FileNotFoundError):
        files.read_norm_stats(spark, f"{d}/none")
    files.write_text(spark, f"{d}/ranges.json", '{"a--b": [[0, 6], [9, 9]], "c--d": []}')
    assert [tuple(r) for r in files.read_ranges(spark, f"{d}/ranges.json").collect()] == [("a--b", 0, 6), ("a--b", 9, 9)]
    files.write_ranges(spark.createDataFrame([(1, 5, 9), (1, 0, 3)], "episode int, start int, end int"), f"{d}/lines")
    assert sorted(tuple(r) for r in files.read_range_lines(spark, f"{d}/lines").collect()) == [("1", 0, 3), ("1", 5, 9)]
    steps = files.fake_steps(spark, 100, {"state": 3}, {"tokens": 2}, 1).withColumn("episode_index", F.col("id") % 5).withColumn("frame_index", F.col("id"))
    files.write_steps(steps, f"{d}/steps")
    back = files.read_steps(spark, f"{d}/steps")
    assert back.count() == 100 and all(-1 <= v < 1 for r in back.collect() for v in r.state)
    assert files.find_files(spark, f"{d}/steps", "*.parquet").count() >= 1
    long = files.frames_of(files.equal_lengths(spark.sql("SELECT 1 AS e, array(1, 2) AS a, array(3, 4) AS b"), "a", "b"), "a", "b")
    assert [(r.step, r.a, r.b) for r in long.collect()] == [(0, 1, 3), (1, 2, 4)]
    with pytest.raises(Exception, match="different lengths"):
        files.equal_lengths(spark.sql("SELECT array(1) AS a, array(3, 4) AS b"), "a", "b").collect()
    rec = files.recorded(spark.sql("SELECT 0 AS step, array(1.0, 2.0) AS state, array(3.0) AS actions"), ["state"], ["actions"])
    assert rec.columns == ["step", "inputs/state", "outputs/actions"] and files.by_axis(rec, "inputs/state").count() == 2
    files.append_metrics(spark.sql("SELECT 1 AS step, 0.5 AS loss, CAST(NULL AS DOUBLE) AS lr"), f"{d}/metrics", "run", "step", "loss", "lr")
    assert spark.read.parquet(f"{d}/metrics").count() == 1
    files.write_eval(spark.sql("SELECT 1.0 AS success, 3 AS duration, 'v' AS video_filename"), f"{d}/eval")
    assert files.read_eval(spark, f"{d}/eval").first().success == 1.0
    rules = {"a/.*": datetime(2025, 1, 1), "a/b": datetime(2020, 1, 1)}
    old = files.stale(F.lit("a/b/c"), F.lit(datetime(2024, 1, 1)), rules)
    assert one(spark.range(1), old) is True and one(spark.range(1), files.stale(F.lit("x"), F.lit(datetime(2024, 1, 1)), rules)) is False
    assert files.next_index(spark.createDataFrame([("out_3.mp4",), ("out_12.mp4",), ("x",)], "n string"), "n").first().next == 13


def test_pipelines_undo_themselves(spark):
    stats = {"state": {"mean": [0.1] * 14, "std": [0.5] * 14, "q01": [-1.0] * 14, "q99": [1.0] * 14}}
    stats["actions"] = stats["state"]
    state, action = [0.1 * i - 0.6 for i in range(14)], [[0.05 * (i + k) - 0.3 for i in range(14)] for k in range(3)]
    df = spark.createDataFrame([(state, action, " Pick_it ")], "state array<double>, actions array<array<double>>, prompt string")
    for name in ("two_arm_flow", "two_arm_flow_discrete"):
        p = pipelines.pipeline(name, stats=stats, robot=pipelines.two_arm(adapt=False))
        there = df.transform(p.training())
        row = there.first()
        assert len(row.state) == 32 and len(row.actions[0]) == 32 and "prompt" not in there.columns and row.prompt_text.startswith(("Pick it", "Task: Pick it, State: "))
        back = there.transform(p.outgoing()).first()
        assert np.allclose(back.actions, action, atol=1e-6)
    with pytest.raises(ValueError, match="did you mean 'two_arm_flow'"):
        pipelines.pipeline("two_arm_flaw")
    assert pipelines.pipeline("fake").for_stats()(df).columns == ["state", "actions"]
    with pytest.raises(ValueError):
        df.select("prompt").transform(pipelines.unnormalize(stats, False))
    g = pipelines.Group((1,), (2,)).push([3], [4])
    assert g.inputs == (1, 3) and g.outputs == (4, 2)


def test_broker_stream(spark, tmp_path):
    rows = [("a", i, [float(10 * i + k) for k in range(4)]) for i in range(7)] + [("b", i, [float(i)] * 2) for i in range(3)]
    spark.createDataFrame(rows, "episode string, step long, chunk array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("episode string, step long, chunk array<double>").parquet(f"{tmp_path}/in")
    q = live.broker_stream(stream, 3).writeStream.format("memory").queryName("broker").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.step): (r.offset, r.action) for r in spark.table("broker").collect()}
    assert [got["a", i] for i in range(7)] == [(0, 0.0), (1, 1.0), (2, 2.0), (0, 30.0), (1, 31.0), (2, 32.0), (0, 60.0)]
    assert [got["b", i] for i in range(3)] == [(0, 0.0), (1, 0.0), (0, 2.0)]


def test_event_time_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    stream = live.with_event_time(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), "ts", "1 hour")
    q = live.tumbling(stream, "ts", "1 hour", "event_type").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = live.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "event_type")
    assert {(str(r.start), r.event_type, r.n) for r in spark.table("hours").collect()} == {(str(r.start), r.event_type, r.n) for r in want.collect()}


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_piece_tokens(spark, unit):
    import sentencepiece

    from kinelake.functions import tokenizers as tok

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = spark.createDataFrame([(" pick_it ", [0.0, 0.5], [3, 4]), (None, [0.1], None)], "prompt string, state array<double>, codes array<int>")
    ids = [sp.bos_id(), *sp.encode("pick it"), *sp.encode("\n")]
    got = df.select(tok.prompt_tokens(F.col("prompt"), PIECES, 12).alias("v")).first().v
    assert got.tokens == (ids + [0] * 12)[:12] and got.mask == [i < len(ids) for i in range(12)]
    v = df.select(tok.action_sequence(F.col("prompt"), F.col("state"), F.col("codes"), PIECES, 32_000, 64).alias("v")).first().v
    prefix = [sp.bos_id(), *sp.encode("Task: pick it, State: 128 192;\n")]
    suffix = [*sp.encode("Action: "), 32_000 - 1 - 128 - 3, 32_000 - 1 - 128 - 4, *sp.encode("|"), sp.eos_id()]
    assert v.tokens[: len(prefix) + len(suffix)] == prefix + suffix and v.ar[: len(prefix) + 1] == [0] * len(prefix) + [1] and sum(v.loss) == len(suffix)
    assert one(unit, tok.piece_text(F.lit(sp.encode("some words")), PIECES)) == "some words"
    assert one(unit, tok.action_codes(F.lit("no actions here"), PIECES, 32_000)) == []
    assert one(unit, tok.action_codes(F.lit("x Action: ab| c"), PIECES, 32_000)) == [32_000 - 129 - t for t in sp.encode("ab")]
    assert one(unit, tok.codes_to_chunk(F.array(*[F.lit(128)] * 4), 2, 2)) == [[0, 0], [0, 0]] and one(unit, tok.codes_to_chunk(F.array(F.lit(255)), 1, 2)) == [[0, 0]]


def test_model_masks(unit):
    got = one(unit, arrays.model_masks(F.array(F.lit(True), F.lit(False)), 2, F.array(F.lit(True), F.lit(False)), 3, True))
    assert got.valid == [True, True, False, False, True, False] + [True] * 4 and got.ar == [0] * 6 + [1, 1, 0, 0]
    seen = one(unit, arrays.attention_mask(F.array(*[F.lit(True)] * 4), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(0))))
    assert seen == [[True, True, False, False]] * 2 + [[True] * 4] * 2


def test_convert(spark):
    from kinelake.sources import convert

    a = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "episode_index long, frame_index int, g double")
    b = spark.createDataFrame([(0, 0, False)], "episode_index long, frame_index int, movement_enabled boolean")
    both = convert.united([a, b])
    assert sorted(r.episode_index for r in both.collect()) == [0, 1, 2] and convert.moving_steps(both).count() == 2
    notes = spark.createDataFrame([(1, "fold")], "episode_index long, note string")
    assert {r.episode_index: r.task for r in convert.with_task(a, notes, "episode_index").collect()} == {0: "Do something", 1: "fold"}
    assert convert.with_task(a, constant="x").first().task == "x"
    assert convert.with_actions(a.withColumn("v", F.array(F.lit(9.0))), "v", "g").first().actions == [9.0, 1.0]
    px = np.zeros((4, 4, 3), np.uint8)
    px[:, :, 0] = 200
    frames = spark.createDataFrame([(0, 0, 0, images.to_row(px)), (0, 0, 1, images.to_row(px))], f"episode_index long, frame_index int, camera int, image {images.IMAGE}")
    got = convert.with_cameras(a, frames, F.when(F.col("camera") == 0, "wrist").otherwise("side"), "episode_index", "frame_index", 2, 2).collect()
    assert len(got) == 1 and set(got[0].images) == {"wrist", "side"} and images.to_array(got[0].images["wrist"])[0, 0].tolist() == [0, 0, 200]
    small = spark.createDataFrame([(0, {"a": images.to_row(px), "b": None})], f"id int, m map<string,{images.IMAGE}>")
    r = small.select(images.resized_map(F.col("m"), 2, 2).alias("m"), images.with_masks(F.col("m"), None).alias("k")).first()
    assert (r.m["a"].height, r.m["b"], r.k) == (2, None, {"a": True, "b": True})
