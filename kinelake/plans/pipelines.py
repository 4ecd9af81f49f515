"""Transform groups and the registry of named pipelines.

A transform is a function from DataFrame to DataFrame, so a pipeline is one lazy plan. Going in: repack, the robot's
inputs, normalisation, the model's inputs. Going out, the inverses in reverse: the model's outputs, unnormalisation, the
robot's outputs, repack; state stays until absolute actions have been made from it.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import small_batches
from ..functions import arrays, images, robots, text, tokenizers
from ..operators import reshape

Transform = Callable[[DataFrame], DataFrame]


def compose(transforms: Sequence[Transform]) -> Transform:
    """From left to right."""
    return lambda df: reduce(lambda d, t: d.transform(t), transforms, df)


@dataclass(frozen=True)
class Group:
    inputs: tuple[Transform, ...] = ()
    outputs: tuple[Transform, ...] = ()

    def push(self, inputs: Sequence[Transform] = (), outputs: Sequence[Transform] = ()) -> Group:
        """Inputs go last, outputs first, so that outputs undo inputs in reverse."""
        return Group((*self.inputs, *inputs), (*outputs, *self.outputs))


def on(column: str, f: Callable[[Column], Column]) -> Transform:
    """f over a column, if the table has it."""
    return lambda df: df.withColumn(column, f(F.col(column))) if column in df.columns else df


def on_actions(f: Callable[[Column, Column], Column]) -> Transform:
    """f over actions and state, if there are actions."""
    return lambda df: df.withColumn("actions", f(F.col("actions"), F.col("state"))) if "actions" in df.columns else df


def normalize(stats: Mapping[str, Mapping[str, Sequence[float]]] | None, quantiles: bool, strict: bool = False) -> Transform:
    """Over the columns that stats has; strict fails for those that the table lacks. Without stats nothing happens."""
    return _scaled(stats, quantiles, strict, arrays.normalize_q, arrays.normalize_z)


def unnormalize(stats: Mapping[str, Mapping[str, Sequence[float]]] | None, quantiles: bool) -> Transform:
    """The inverse; always strict."""
    return _scaled(stats, quantiles, True, arrays.unnormalize_q, arrays.unnormalize_z)


def _scaled(stats, quantiles: bool, strict: bool, by_quantiles, by_deviation) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for key, s in (stats or {}).items():
            if key not in df.columns:
                if strict:
                    raise ValueError(f"no column {key}")
                continue
            if quantiles and ("q01" not in s or "q99" not in s):
                raise ValueError(f"{key} has no quantiles")
            f, a, b = (by_quantiles, s["q01"], s["q99"]) if quantiles else (by_deviation, s["mean"], s["std"])
            one = partial(_apply, f, a, b)
            nested = df.schema[key].dataType.simpleString().startswith("array<array<")
            df = df.withColumn(key, F.transform(key, lambda v: one(v)) if nested else one(F.col(key)))
        return df

    return run


def _apply(f, a, b, x: Column) -> Column:
    return f(x, a, b)


def pad(dims: int) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        df = df.withColumn("state", arrays.pad_to(F.col("state"), dims, F.lit(0.0)))
        return on("actions", lambda a: F.transform(a, lambda v: arrays.pad_to(v, dims, F.lit(0.0))))(df)

    return run


def default_prompt(prompt: str | None) -> Transform:
    return lambda df: reshape.with_default_prompt(df, prompt)


def prompt_text(discrete_state: bool) -> Transform:
    """The prompt as the model reads it, in place of the raw one; with a discrete state also the state's bins."""

    def run(df: DataFrame) -> DataFrame:
        if "prompt" not in df.columns:
            raise ValueError("prompt is required")
        own = text.action_prompt(F.col("prompt"), F.col("state")) if discrete_state else F.concat(text.clean_prompt(F.col("prompt")), F.lit("\n"))
        return df.withColumn("prompt_text", own).drop("prompt")

    return run


# The names of a model's views and of the robots' cameras, and what the datasets call their columns.
FLOW_VIEWS, TOKEN_VIEWS = ("base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb"), ("base_0_rgb", "base_1_rgb", "wrist_0_rgb")
TWO_ARM_CAMERAS = ("cam_high", "cam_low", "cam_left_wrist", "cam_right_wrist")
TWO_ARM_REPACK = {"images": {"cam_high": "observation.images.top"}, "state": "observation.state", "actions": "action"}
TABLE_ARM_REPACK = {"observation/image": "image", "observation/wrist_image": "wrist_image", "observation/state": "state", "actions": "actions", "prompt": "prompt"}
FIELD_ARM_REPACK = {
    "observation/exterior_image_1_left": "observation/image",
    "observation/wrist_image_left": "observation/wrist_image",
    "observation/joint_position": "observation/joint_position",
    "observation/gripper_position": "observation/gripper_position",
    "actions": "actions",
    "prompt": "prompt",
}


def repacked(structure: Mapping) -> Group:
    """What comes from a dataset under the names that a robot itself uses; not for requests at run time.

    A table that has none of the dataset's columns is taken to be in the robot's terms already; one with some of them has to
    have all.
    """

    def sources(node: Mapping) -> list[str]:
        return [x for v in node.values() for x in ([v] if isinstance(v, str) else sources(v))]

    def run(df: DataFrame) -> DataFrame:
        foreign = {s.split("/")[0] for s in sources(structure)}
        return reshape.repack(df, structure) if foreign & set(df.columns) else df

    return Group((run,))


def _picture(df: DataFrame, column: Column) -> Column:
    """A column's pictures as images; bytes as they are, floats in [0, 1] as bytes."""
    floats = "array<float>" in df.select(column.alias("v")).schema["v"].dataType.simpleString()
    return images.parsed(column, floats)


def _slots(df: DataFrame, views: Mapping[str, Column | None], always: bool) -> DataFrame:
    """df with image and image_mask, maps by view. The first view must be there; the others, where missing, are black like it.

    always: missing views count as there too, as token models take them.
    """
    small_batches(df.sparkSession)
    first, base = next(iter(views.items()))
    pictures = {k: None if v is None else _picture(df, v) for k, v in views.items()}
    base = F.coalesce(pictures[first], F.raise_error(F.lit(f"no picture for {first}")).cast(images.IMAGE))
    shown = {k: base if k == first else images.black_like(base) if v is None else F.coalesce(v, images.black_like(base)) for k, v in pictures.items()}
    masks = {k: F.lit(True) if always or k == first else F.lit(False) if v is None else views[k].isNotNull() for k, v in pictures.items()}
    pairs = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)])
    return df.withColumns({"image": pairs(shown), "image_mask": pairs(masks)})


def two_arm_views(df: DataFrame) -> DataFrame:
    """images (a struct or a map by camera) in a model's views; a camera that no such robot has is refused."""
    if "images" not in df.columns:
        return df
    kind = df.schema["images"].dataType
    if hasattr(kind, "fields"):
        if odd := set(kind.names) - set(TWO_ARM_CAMERAS):
            raise ValueError(f"no cameras of this robot: {sorted(odd)}")
        own = lambda c: F.col("images")[c] if c in kind.names else None
    else:
        checked = F.when(F.exists(F.map_keys("images"), lambda k: ~k.isin(*TWO_ARM_CAMERAS)), F.raise_error(F.lit("a camera that this robot doesn't have")).cast(kind)).otherwise(F.col("images"))
        df = df.withColumn("images", checked)
        own = lambda c: F.col("images")[c]
    return _slots(df, dict(zip(FLOW_VIEWS, map(own, ("cam_high", "cam_left_wrist", "cam_right_wrist")), strict=True)), False).drop("images")


def one_arm_views(base: str, wrist: str, model: str, wrist_last: bool) -> Transform:
    """Two cameras' columns in a model's views. model: as in model_group; wrist_last: a token model has the wrist as its third view."""
    tokens = model == "tokens"
    names = TOKEN_VIEWS if tokens and wrist_last else FLOW_VIEWS

    def run(df: DataFrame) -> DataFrame:
        if base not in df.columns:
            return df
        b, w = F.col(f"`{base}`"), F.col(f"`{wrist}`") if wrist in df.columns else None
        own = (b, None, w) if tokens and wrist_last else (b, w, None)
        return _slots(df, dict(zip(names, own, strict=True)), tokens).drop(base, wrist)

    return run


def resized_views(height: int, width: int) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        if "image" not in df.columns:
            return df
        small_batches(df.sparkSession)
        return df.withColumn("image", images.resized_map(F.col("image"), height, width))

    return run


@dataclass(frozen=True)
class Tokens:
    """How prompts become ids: the path of a SentencePiece model, which all executors reach, and the number of tokens.

    A tokenizer of one's own: a subclass with other `prompt`, `actions` and `chunk`. vocabulary: that of the ids that stand
    for action codes; horizon and dims: those of the chunk that codes make.
    """

    path: str
    size: int = 48
    vocabulary: int = 32_000
    horizon: int = 10
    dims: int = 8

    def prompt(self, df: DataFrame, discrete_state: bool) -> DataFrame:
        """tokenized_prompt and tokenized_prompt_mask in place of prompt."""
        if discrete_state:
            ids = tokenizers.piece_ids(text.action_prompt(F.col("prompt"), F.col("state")), self.path, begin=True)
            both = text.padded_tokens(ids, self.size, F.lit(0))
        else:
            both = tokenizers.prompt_tokens(F.col("prompt"), self.path, self.size)
        return df.withColumn("_t", both).withColumns({"tokenized_prompt": F.col("_t.tokens"), "tokenized_prompt_mask": F.col("_t.mask")}).drop("_t", "prompt")

    def actions(self, df: DataFrame) -> DataFrame:
        """The prompt, the state and, where there are codes, the actions as one sequence with its masks."""
        codes = F.col("action_codes") if "action_codes" in df.columns else F.lit(None).cast("array<int>")
        s = tokenizers.action_sequence(F.col("prompt"), F.col("state"), codes, self.path, self.vocabulary, self.size)
        named = {"tokenized_prompt": "tokens", "tokenized_prompt_mask": "mask", "token_ar_mask": "ar", "token_loss_mask": "loss"}
        return df.withColumn("_t", s).withColumns({k: F.col(f"_t.{v}") for k, v in named.items()}).drop("_t", "prompt", "action_codes")

    def chunk(self, df: DataFrame) -> DataFrame:
        """actions (a model's token ids) as a chunk."""
        if "actions" not in df.columns:
            return df
        said = df.withColumn("_text", tokenizers.piece_text(F.col("actions"), self.path))
        codes = said.withColumn("_codes", tokenizers.action_codes(F.col("_text"), self.path, self.vocabulary))
        return codes.withColumn("actions", tokenizers.codes_to_chunk(F.col("_codes"), self.horizon, self.dims)).drop("_text", "_codes")


@dataclass(frozen=True)
class Data:
    """What is read, in the model's terms."""

    source: str = "fake"
    repack: Group = Group()
    robot: Group = Group()
    model: Group = Group()
    stats: Mapping | None = None
    quantiles: bool = False
    mix: Mapping[str, float] = field(default_factory=dict)

    def training(self) -> Transform:
        return compose([*self.repack.inputs, *self.robot.inputs, normalize(self.stats, self.quantiles), *self.model.inputs])

    def for_stats(self) -> Transform:
        """What statistics are made of: before normalisation, without texts."""
        return compose([*self.repack.inputs, *self.robot.inputs, reshape.without_strings])

    def incoming(self, prompt: str | None = None, repack: Group = Group()) -> Transform:
        """For a robot's own requests, which already have its names: the dataset's repack is left out."""
        return compose([*repack.inputs, default_prompt(prompt), *self.robot.inputs, normalize(self.stats, self.quantiles), *self.model.inputs])

    def outgoing(self, repack: Group = Group()) -> Transform:
        return compose([*self.model.outputs, unnormalize(self.stats, self.quantiles), *self.robot.outputs, *repack.outputs])

    def read(self, spark: SparkSession, path: str | None = None, **options) -> DataFrame:
        """The named source's rows, from its folder."""
        from ..sources.registry import open_source

        return open_source(spark, self.source, path, **options)


def model_group(kind: str, dims: int, prompt: str | None = None, size: tuple[int, int] | None = (224, 224), tokens: Tokens | None = None) -> Group:
    """flow: prompt and padding; flow_discrete: the state in the prompt; tokens: a token model's prefix, without padding.

    Views, where there are any, get size. With tokens prompts become ids, and without it the text that would.
    """
    if kind not in ("flow", "flow_discrete", "tokens"):
        raise ValueError(kind)
    first = (default_prompt(prompt), *((resized_views(*size),) if size else ()))
    if kind == "tokens":
        if tokens:
            return Group((*first, _prompted(tokens.actions)), (tokens.chunk,))
        prefix = lambda df: df.withColumn("prompt_text", text.action_prefix(F.col("prompt"), F.col("state"))).drop("prompt")
        return Group((*first, prefix))
    own = _prompted(lambda df: tokens.prompt(df, kind == "flow_discrete")) if tokens else prompt_text(kind == "flow_discrete")
    return Group((*first, own, pad(dims)))


def _prompted(f: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        if "prompt" not in df.columns:
            raise ValueError("prompt is required")
        return f(df)

    return run


def delta_group(mask: Sequence[bool]) -> Group:
    """Actions relative to the state going in, absolute again going out."""
    return Group((on_actions(lambda a, s: arrays.delta_actions(a, s, mask)),), (on_actions(lambda a, s: arrays.absolute_actions(a, s, mask)),))


def _cut(dims: int) -> Transform:
    return on("actions", lambda a: arrays.first_dims(a, dims))


def two_arm(adapt: bool = True, delta: bool = True) -> Group:
    """14 joints and grippers of two arms; adapt converts them to the model's own."""
    own = Group((*((on("state", robots.decode_state), on("actions", robots.encode_actions_inverse)) if adapt else ()), two_arm_views), (_cut(14), *((on("actions", robots.encode_actions),) if adapt else ())))
    return own.push(delta_group(arrays.bool_mask(6, -1, 6, -1)).inputs, delta_group(arrays.bool_mask(6, -1, 6, -1)).outputs) if delta else own


def one_arm(dims: int, delta: Sequence[int] | None = None, model: str = "flow", base: str = "observation/image", wrist: str = "observation/wrist_image", wrist_last: bool = False) -> Group:
    """dims joints and a gripper; the state is observation/state, or joint and gripper positions in a row, where it isn't there yet."""

    def joined(df: DataFrame) -> DataFrame:
        if "state" in df.columns:
            return df
        if "observation/state" in df.columns:
            return df.withColumnRenamed("observation/state", "state")
        j, g = ((f"observation/{c}" if f"observation/{c}" in df.columns else c) for c in ("joint_position", "gripper_position"))
        grip = F.col(f"`{g}`") if df.schema[g].dataType.simpleString().startswith("array") else F.array(F.col(f"`{g}`"))
        return df.withColumn("state", F.concat(F.col(f"`{j}`"), grip)).drop(*[c for c in (j, g) if c.startswith("observation/")])

    own = Group((joined, one_arm_views(base, wrist, model, wrist_last)), (_cut(dims),))
    if delta is None:
        return own
    d = delta_group(arrays.bool_mask(*delta))
    return own.push(d.inputs, d.outputs)


def _field(delta: Sequence[int] | None = None, model: str = "flow") -> Group:
    return one_arm(8, delta, model, "observation/exterior_image_1_left", "observation/wrist_image_left", True)


_TWO, _TABLE, _FIELD = repacked(TWO_ARM_REPACK), repacked(TABLE_ARM_REPACK), repacked(FIELD_ARM_REPACK)
_NAMED: list[tuple[str, Data]] = [
    ("two_arm_flow", Data("two_arm", _TWO, two_arm(), model_group("flow", 32))),
    ("two_arm_flow_discrete", Data("two_arm", _TWO, two_arm(), model_group("flow_discrete", 32), quantiles=True)),
    ("table_arm_flow", Data("table_arm", _TABLE, one_arm(7), model_group("flow", 32))),
    ("table_arm_flow_delta", Data("table_arm", _TABLE, one_arm(7, (6, -1)), model_group("flow", 32))),
    ("table_arm_tokens", Data("table_arm", _TABLE, one_arm(7, model="tokens"), model_group("tokens", 7), quantiles=True)),
    ("field_arm_flow_discrete", Data("field_arm", _FIELD, _field((7, -1)), model_group("flow_discrete", 32), quantiles=True)),
    ("field_arm_tokens", Data("field_arm", _FIELD, _field(model="tokens"), model_group("tokens", 8), quantiles=True)),
    ("field_and_sim_mix", Data("field_arm", _FIELD, _field((7, -1)), model_group("flow_discrete", 32), quantiles=True, mix={"field": 0.9, "sim": 0.1})),
    ("fake", Data("fake", model=model_group("flow", 32, "be still"))),
]


def by_name(named: Sequence[tuple[str, Data]]) -> dict[str, Data]:
    """A registry; a name that comes twice is refused."""
    out = dict(named)
    if len(out) < len(named):
        names = [n for n, _ in named]
        raise ValueError(f"names that come twice: {sorted({n for n in names if names.count(n) > 1})}")
    return out


PIPELINES: dict[str, Data] = by_name(_NAMED)


def pipeline(name: str, **changes) -> Data:
    """A named pipeline, with fields changed; an unknown name's error has the nearest one."""
    if name not in PIPELINES:
        near = difflib.get_close_matches(name, PIPELINES, n=1, cutoff=0.0)
        raise ValueError(f"no pipeline '{name}'" + (f"; did you mean '{near[0]}'?" if near else ""))
    return replace(PIPELINES[name], **changes)
