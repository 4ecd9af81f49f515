"""Whole pipelines with pictures and tokens, observations, the statistics job, and masks over long texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import arrays, images
from kinelake.operators import masks
from kinelake.plans import norm_job, observations
from kinelake.plans import pipelines as P
from kinelake.sources import codec, files, registry

RNG = np.random.default_rng(0)
HWC = RNG.integers(0, 256, (5, 8, 3), np.uint8)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def tokens_of(text):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def image_of(v):
    return images.to_array(v)


@pytest.fixture(scope="module")
def table_rows(spark):
    row = (images.to_row(HWC), images.to_row(HWC[::-1]), [0.1 * i for i in range(8)], [[0.5] * 7, [1.0] * 7], " stack_cups\n")
    return spark.createDataFrame([row], f"image {images.IMAGE}, wrist_image {images.IMAGE}, state array<double>, actions array<array<double>>, prompt string")


def test_table_arm_through_views_and_tokens(spark, table_rows):
    import sentencepiece

    tokens = P.Tokens(MODEL, 16)
    made = P.pipeline("table_arm_flow", model=P.model_group("flow", 32, size=(16, 16), tokens=tokens)).training()(table_rows).first()
    assert set(made.image) == set(P.FLOW_VIEWS) and made.image_mask == {"base_0_rgb": True, "left_wrist_0_rgb": True, "right_wrist_0_rgb": False}
    assert (image_of(made.image["base_0_rgb"]) == images.resize_with_pad(HWC, 16, 16)).all() and not image_of(made.image["right_wrist_0_rgb"]).any()
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [own.bos_id(), *own.encode("stack cups"), *own.encode("\n")]
    assert made.tokenized_prompt == (ids + [0] * 16)[:16] and made.tokenized_prompt_mask == [True] * len(ids) + [False] * (16 - len(ids))
    assert len(made.state) == 32 and all(len(a) == 32 for a in made.actions) and "prompt" not in made.asDict()
    # a token model counts the missing view as there
    seen = P.pipeline("table_arm_tokens", model=P.model_group("tokens", 7, size=None)).training()(table_rows).first()
    assert seen.image_mask["right_wrist_0_rgb"] and seen.prompt_text.startswith("Task: stack cups, State: ")


def test_field_arm_views_by_model(spark):
    floats = (HWC.transpose(2, 0, 1) / 255).astype(np.float32)
    row = (images.to_row(HWC.transpose(2, 0, 1)), (3, 5, 8, floats.ravel().tolist()), [0.1] * 7, 0.25, "open")
    names = f"`observation/exterior_image_1_left` {images.IMAGE}, `observation/wrist_image_left` {images.FLOAT_IMAGE}, `observation/joint_position` array<double>, `observation/gripper_position` double, prompt string"
    df = spark.createDataFrame([row], names)
    flow = P.pipeline("field_arm_flow_discrete", stats=None, model=P.model_group("flow_discrete", 32, size=None)).incoming()(df).first()
    assert (image_of(flow.image["base_0_rgb"]) == HWC).all() and flow.state[:8] == [0.1] * 7 + [0.25] and flow.image_mask["left_wrist_0_rgb"]
    wrist = image_of(flow.image["left_wrist_0_rgb"])
    assert wrist.shape == HWC.shape and np.abs(wrist.astype(int) - HWC).max() <= 1  # floats are cut to whole numbers
    tokens = P.pipeline("field_arm_tokens", model=P.model_group("tokens", 8, size=None)).incoming()(df).first()
    assert list(tokens.image) == list(P.TOKEN_VIEWS) and not image_of(tokens.image["base_1_rgb"]).any() and tokens.image_mask == dict.fromkeys(P.TOKEN_VIEWS, True)


def test_two_arm_cameras(spark):
    chw = images.to_row(HWC.transpose(2, 0, 1))
    df = spark.createDataFrame([(0, {"cam_high": chw, "cam_right_wrist": chw}, [0.3] * 14, "x"), (1, {"cam_high": chw, "cam_low": chw}, [0.3] * 14, "y")], f"id int, images map<string,{images.IMAGE}>, state array<double>, prompt string")
    data = P.pipeline("two_arm_flow", model=P.model_group("flow", 32, size=None))
    got = {r.id: r for r in data.incoming()(df).collect()}
    assert got[0].image_mask == {"base_0_rgb": True, "left_wrist_0_rgb": False, "right_wrist_0_rgb": True} and not any(got[1].image_mask[v] for v in P.FLOW_VIEWS[1:])
    assert (image_of(got[0].image["right_wrist_0_rgb"]) == HWC).all() and image_of(got[1].image["left_wrist_0_rgb"]).shape == HWC.shape
    with pytest.raises(Exception, match="a camera that this robot doesn't have"):
        data.incoming()(df.withColumn("images", F.map_concat("images", F.create_map(F.lit("cam_odd"), F.col("images")["cam_high"])))).collect()
    with pytest.raises(Exception, match="no picture for base_0_rgb"):
        data.incoming()(df.withColumn("images", F.map_filter("images", lambda k, _: k != "cam_high"))).collect()
    named = df.select("id", F.struct(F.col("images")["cam_high"].alias("cam_high"), F.col("images")["cam_high"].alias("cam_odd")).alias("images"), "state", "prompt")
    with pytest.raises(ValueError, match="cam_odd"):
        data.incoming()(named)
    # the dataset's names are repacked for training alone
    stored = df.where("id = 0").select(F.col("images")["cam_high"].alias("observation.images.top"), F.col("state").alias("observation.state"), F.array("state").alias("action"))
    made = P.pipeline("two_arm_flow", model=P.model_group("flow", 32, "fold", None)).training()(stored).first()
    assert made.prompt_text == "fold\n" and len(made.actions[0]) == 32
    with pytest.raises(KeyError):  # a dataset's table has to have all its columns
        data.training()(stored.drop("action"))
    assert data.training()(df.where("id = 0")).count() == 1  # in the robot's terms already


def test_token_models_go_out_as_chunks(spark):
    tokens = P.Tokens(MODEL, 64, horizon=2, dims=2)
    df = spark.createDataFrame([([0.1, 0.2], "go", [3, 200, 7, 0])], "state array<double>, prompt string, action_codes array<int>")
    group = P.model_group("tokens", 2, size=None, tokens=tokens)
    made = P.compose(group.inputs)(df).first()
    assert len(made.tokenized_prompt) == len(made.token_ar_mask) == len(made.token_loss_mask) == 64
    assert sum(made.token_loss_mask) == sum(made.token_ar_mask) > 4 and not made.token_loss_mask[0]
    nothing = spark.createDataFrame([([0.0, 0.0],)], "state array<double>").withColumn("actions", F.array(*[F.lit(i) for i in (5, 6)]))
    assert P.compose(group.outputs)(nothing).first().actions == [[0.0, 0.0]] * 2
    # ids whose text holds codes: the pieces between "Action: " and the bar, each a code by its distance from the vocabulary's end
    ids = tokens_of("Action: w x y z|")
    own = spark.createDataFrame([(ids, [0.0, 0.0])], "actions array<int>, state array<double>")
    codes = [32_000 - 1 - 128 - t for t in tokens_of("w x y z")]
    chunk = P.compose(group.outputs)(own).first().actions
    assert np.allclose(np.ravel(chunk), [c / 256 * 2 - 1 for c in codes[:4]])


def test_names_come_once():
    one = ("fake", P.Data())
    assert set(P.by_name([one])) == {"fake"}
    with pytest.raises(ValueError, match="fake"):
        P.by_name([one, one])
    assert {d.source for d in P.PIPELINES.values()} <= set(registry.SOURCES)


def test_a_pipeline_reads_its_source(spark, tmp_path):
    rows = spark.range(6).selectExpr("id AS episode", "array(float(id), 1F, 1F, 1F, 1F, 1F, 1F) AS joint_position", "array(0.5F) AS gripper_position", "array(1F) AS actions", "array('go') AS prompt")
    registry.write_records(rows, str(tmp_path / "r"), files=3)
    df = P.pipeline("field_arm_flow_discrete").read(spark, str(tmp_path / "r")).where("episode = 4").withColumn("prompt", F.get("prompt", F.lit(0)))
    made = P.compose(P.pipeline("field_arm_flow_discrete", model=P.model_group("flow", 32, size=None)).robot.inputs)(df.drop("actions")).first()
    assert made.state == [4.0, 1, 1, 1, 1, 1, 1, 0.5]
    assert P.pipeline("fake").read(spark, rows=5).count() == 5


def test_observations_from_and_to_records(spark, table_rows):
    record = P.pipeline("table_arm_flow", model=P.model_group("flow", 32, size=None, tokens=P.Tokens(MODEL, 8))).training()(table_rows)
    seen = observations.from_record(record)
    assert seen.columns == ["images", "image_masks", "state", "tokenized_prompt", "tokenized_prompt_mask", "actions"]
    r = seen.first()
    assert np.allclose(np.array(r.images["base_0_rgb"].data).reshape(HWC.shape), HWC / 255 * 2 - 1, atol=1e-6)
    back = observations.to_record(seen)
    assert back.columns == ["image", "image_mask", "state", *observations.OPTIONAL, "actions"] and back.first().token_ar_mask is None
    # floats are taken as they are
    assert observations.from_record(back.drop("token_ar_mask", "token_loss_mask")).first().images["base_0_rgb"] == r.images["base_0_rgb"]
    for odd in ("tokenized_prompt", "tokenized_prompt_mask"):
        with pytest.raises(ValueError, match="come together"):
            observations.from_record(record.drop(odd))
    with pytest.raises(ValueError, match="missing"):
        observations.from_record(record.drop("image_mask"))


def test_observations_made_ready(spark):
    row = images.to_row(HWC)
    df = spark.createDataFrame([(i, {"base_0_rgb": row, "left_wrist_0_rgb": row, "right_wrist_0_rgb": row, "odd": row}, {"base_0_rgb": False}, [0.0]) for i in range(3)], f"id int, image map<string,{images.IMAGE}>, image_mask map<string,boolean>, state array<double>")
    r = observations.ready(df, size=(6, 6)).first()
    assert set(r.image) == set(P.FLOW_VIEWS) and all((v.height, v.width) == (6, 6) for v in r.image.values())
    assert r.image_mask == {"base_0_rgb": False, "left_wrist_0_rgb": True, "right_wrist_0_rgb": True}
    assert observations.ready(df.drop("image_mask"), size=(6, 6)).first().image_mask["base_0_rgb"]
    with pytest.raises(Exception, match="lack one of"):
        observations.ready(df.withColumn("image", F.map_filter("image", lambda k, _: k != "left_wrist_0_rgb"))).collect()
    a, b = (sorted((r.id, bytes(r.image["base_0_rgb"].data)) for r in observations.ready(df.repartition(n), "id", True, size=(6, 6)).collect()) for n in (1, 3))
    assert a == b and len({x for _, x in a}) == 3
    with pytest.raises(ValueError):
        observations.ready(df, train=True)


@pytest.mark.parametrize("sketched", [False, True])
def test_statistics_job_writes_what_it_then_reads(spark, tmp_path, sketched):
    n = 103
    df = spark.range(n).select("id", F.array(*[F.col("id") * (d + 1.0) for d in range(8)]).alias("state"), F.array(F.array(*[F.col("id") * 1.0 + d for d in range(7)]), F.array(*[F.col("id") * 2.0 for d in range(7)])).alias("actions"), F.lit("p").alias("prompt"), F.lit("x").alias("image"), F.lit("x").alias("wrist_image"))
    data = P.pipeline("table_arm_flow", repack=P.Group((lambda d: d.select("state", "actions", "prompt"),)))
    made = norm_job.run(df, data, str(tmp_path), "id", batch=10, sketched=sketched)
    left = np.arange(100)
    assert np.allclose(made.stats["state"]["mean"], [left.mean() * (d + 1) for d in range(8)]) and np.allclose(made.stats["state"]["std"], [left.std() * (d + 1) for d in range(8)])
    assert np.allclose(made.stats["actions"]["mean"][0], np.concatenate([left, 2 * left]).mean())
    assert abs(made.stats["state"]["q99"][0] - 98) <= 1 and set(norm_job.loaded_stats(spark, str(tmp_path))) == {"state", "actions"}
    x = made.training()(df).where("prompt_text = 'p\\n'").first()
    assert len(x.state) == 32 and x.state[0] == pytest.approx((0 - made.stats["state"]["mean"][0]) / (made.stats["state"]["std"][0] + 1e-6))
    few = norm_job.counted_rows(df, "id", 10, 35)
    ids = {r.id for r in few.collect()}
    assert len(ids) == 30 and ids != set(range(30)) and ids == {r.id for r in norm_job.counted_rows(df.repartition(5), "id", 10, 35).collect()}
    with pytest.raises(FileNotFoundError):
        norm_job.loaded_stats(spark, str(tmp_path / "nowhere"))


def test_a_file_is_replaced_at_once(spark, tmp_path):
    for text in ("one", "two"):
        files.write_text(spark, str(tmp_path / "f.txt"), text)
        assert (tmp_path / "f.txt").read_text() == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["f.txt"]


def test_masks_of_a_long_text(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit("t").alias("t"), F.col("id").cast("int").alias("i"))
    valid, breaks = F.col("i") % 7 != 3, (F.col("i") >= 10_000).cast("int") * (F.col("i") % 3 == 0).cast("int")
    got = {r.i: r for r in masks.visible(rows, ["t"], "i", valid, breaks).where("i IN (0, 3, 9999, 10000, 29999, 20001)").collect()}
    v = np.arange(n) % 7 != 3
    starts = [i for i in range(10_000, n) if i % 3 == 0]
    for i, r in got.items():
        end = next((s for s in starts if s > i), n)
        assert r.end == end and r.seen == (int(v[:end].sum()) if v[i] else 0)
    small = spark.createDataFrame([([True, True, False, True], [0, 1, 0, 1]), ([], []), (None, None)], "v array<boolean>, b array<int>")
    m = [r.m for r in small.select(arrays.attention_mask(F.col("v"), F.col("b")).alias("m")).collect()]
    t, f = True, False
    assert m[0] == [[t, f, f, f], [t, t, f, f], [f, f, f, f], [t, t, f, t]] and m[1] == []
    assert small.select(arrays.prefix_sums(F.col("b")).alias("s")).first().s == [0, 1, 1, 2]


def test_arrays_on_the_wire_by_batches(spark):
    rows = [(0, [1.5, -2.0]), (1, []), (2, None), (3, [3.0, 4.0]), (4, [7.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>").coalesce(1)
    back = {r.id: r.v for r in df.select("id", codec.decoded(codec.encoded(F.col("v"))).alias("v")).collect()}
    assert back == dict(rows)
    mixed = spark.createDataFrame([(np.array([1, 2], "<i2").tobytes(), "<i2", [2]), (np.array([[1.0], [2.0]], "<f8").tobytes(), "<f8", [2, 1])], codec.WIRE)
    assert [list(r.v) for r in mixed.select(codec.decoded(F.struct("data", "dtype", "shape")).alias("v")).collect()] == [[1.0, 2.0], [1.0, 2.0]]
    with pytest.raises(ValueError):
        codec.encoded(F.col("v"), "O")


def test_training_frames_from_raw_trajectories(spark):
    from kinelake.functions import frames
    from kinelake.operators import blocks as B
    from kinelake.operators import trajectories as R

    png = [frames.png_file(np.full((2, 2, 3), v, np.uint8)) for v in (10, 20, 30)]
    rows = []
    for e, path in ((0, "a/success/x.h5"), (1, "a/failure/x.h5"), (2, "b/success/y.h5"), (3, None)):
        for s in range(6):
            rows.append((e, s, f"f{e}", path, ([s * 1.0] * 7, [-s * 1.0] * 7, [0.5]), (png[0], png[1], png[2], [e * 1.0] * 7, [0.1]), "one", "two", "three"))
    schema = (
        "e int, s int, folder string, path string, action_dict struct<joint_position:array<double>,joint_velocity:array<double>,gripper_position:array<double>>, "
        "observation struct<exterior_image_1_left:binary,exterior_image_2_left:binary,wrist_image_left:binary,joint_position:array<double>,gripper_position:array<double>>, "
        "language_instruction string, language_instruction_2 string, language_instruction_3 string"
    )
    df = spark.createDataFrame(rows, schema)
    ranges = spark.createDataFrame([(0, 1, 3), (2, 4, 6), (1, 0, 6)], "e int, start int, `end` int")
    got = R.training_frames(df, B.Strided("e", "s", 2), 3, ranges, folder="folder", file_path="path").collect()
    assert sorted((r.e, r.s) for r in got) == [(0, 1), (0, 2), (2, 4), (2, 5)]
    for r in got:
        assert [a[0] for a in r.actions] == [float(min(r.s + k, 5)) for k in range(3)] and r.actions[0][7] == 0.5
        assert r.step_id == f"f{r.e}--{'a' if r.e == 0 else 'b'}/success/{'x' if r.e == 0 else 'y'}.h5--{r.s}" and r.prompt in ("one", "two", "three")
        assert set(image_of(r.observation.image).ravel()) <= {10, 20} and set(image_of(r.observation.wrist_image).ravel()) == {30}
    for own in (0, 2):
        assert len({(r.prompt, bytes(r.observation.image.data)) for r in got if r.e == own}) == 1
    many = R.restructured(df.withColumn("e", F.expr("e * 6 + s")), "e", "s", "folder", "path", "joint_velocity")
    assert many.select("prompt").distinct().count() == 3 and many.select("observation.image").distinct().count() == 2
    assert many.agg(F.min(F.get("actions", F.lit(0)))).first()[0] == -5.0
    with pytest.raises(ValueError):
        R.restructured(df, "e", "s", "folder", "path", "torque")
    views = spark.range(1).select(R.cameras(F.create_map(*[F.lit(x) for k in ("top_depth", "stereo_1", "wrist") for x in (k, 1)]), ("depth", "stereo")).alias("v")).first().v
    assert views == {"wrist": 1}


def test_sampled_trajectories_by_hand(spark):
    from kinelake.operators import trajectories as R

    steps = spark.createDataFrame([(e, s, s % 4 != 1) for e, n in ((0, 50), (1, 3)) for s in range(n)], "e int, s int, m boolean")
    shown = steps.where("NOT (e = 0 AND s >= 40)").select("e", "s", (F.col("s") * 2).alias("frame"))
    whole = R.sampled_trajectories(steps, shown, "e", "s").collect()
    assert {(r.e, r.s) for r in whole} == {(0, s) for s in range(40)} | {(1, s) for s in range(3)}
    some = [(r.e, r.s) for r in R.sampled_trajectories(steps, shown, "e", "s", 10, 1.5, "m").collect()]
    assert all(s % 4 != 1 for _, s in some) and {s for e, s in some if e == 1} == {0, 2}
    assert 5 <= sum(e == 0 for e, _ in some) <= 10 and max(s for e, s in some if e == 0) < 40
    again = [(r.e, r.s) for r in R.sampled_trajectories(steps.repartition(7), shown, "e", "s", 10, 1.5, "m").collect()]
    assert sorted(again) == sorted(some)


def test_datasets_declare_what_they_hold(spark, tmp_path):
    from pyspark.sql import types as T

    from kinelake.sources import dataset

    features = T.StructType.fromDDL("episode_index long, frame_index long, state array<float>, task_index int")
    df = spark.range(40).selectExpr("id div 10 AS episode_index", "id % 10 AS frame_index", "array(double(id), 0D) AS state", "0L AS task_index")
    folder = str(tmp_path / "d")
    for _ in range(2):  # the second one replaces the first
        dataset.write_dataset(df, folder, features, 15, {0: "fold", 1: "pour"}, {"state": 2})
    assert files.read_dataset_info(spark, folder) == (15.0, {0: "fold", 1: "pour"})
    assert [(f.name, f.dataType) for f in dataset.read_features(spark, folder)] == [(f.name, f.dataType) for f in features]
    back = dataset.read_dataset(spark, folder)
    assert back.dtypes == [("episode_index", "bigint"), ("frame_index", "bigint"), ("state", "array<float>"), ("task_index", "int")] and back.count() == 40
    for bad, word in ((df.drop("state"), "missing"), (df.withColumn("more", F.lit(1)), "not declared"), (df.withColumn("state", F.lit("x")), "another type")):
        with pytest.raises(ValueError, match=word):
            dataset.write_dataset(bad, folder, features, 15)
    with pytest.raises(Exception, match="3 elements, not 2"):
        dataset.checked_sizes(df.withColumn("state", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))), {"state": 2}).collect()
    seen = {(r.episode_index, r.frame_index): r for r in dataset.read_windows(spark, folder, {"state": [-2 / 15, 0.0, 1 / 15, 4 / 15]}, block=3).collect()}
    for (e, f), r in seen.items():
        at = [f - 2, f, f + 1, f + 4]
        assert [v[0] for v in r.state] == [e * 10.0 + min(max(k, 0), 9) for k in at] and list(r.state_is_pad) == [not 0 <= k < 10 for k in at] and r.prompt == "fold"
    assert len(seen) == 40
    with pytest.raises(ValueError):
        dataset.read_windows(spark, folder, {"state": [0.05]})
    sizes = dataset.folder_sizes(files.find_files(spark, folder, "*.parquet"), len(tmp_path.parts) + 1).collect()
    assert [r.folder for r in sizes] == [f"{folder[1:]}/data"] and sizes[0].files >= 1 and sizes[0].bytes > 0


def test_checkpoints_by_environment(spark):
    from kinelake.sources import dataset

    df = spark.createDataFrame([("table",), ("field",)], "env string")
    known = {"table": ("a", "/c/a"), "field": ("b", "/c/b")}
    assert {tuple(r) for r in dataset.with_checkpoint(df, "env", known).collect()} == {("table", "a", "/c/a"), ("field", "b", "/c/b")}
    own = F.when(F.col("env") == "field", F.struct(F.lit("x").alias("config"), F.lit("/x").alias("checkpoint")))
    assert ("field", "x", "/x") in {tuple(r) for r in dataset.with_checkpoint(df, "env", known, own).collect()}
    with pytest.raises(Exception, match="no checkpoint for moon"):
        dataset.with_checkpoint(spark.createDataFrame([("moon",)], "env string"), "env", known).collect()
