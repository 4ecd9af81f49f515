"""Each robot's records through its whole pipeline, in and out again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images, robots
from ..plans import pipelines as P
from .registry import query, table

_SIZE = (4, 4)
_EPSILON = 1e-6


def _stats(dims: int) -> dict:
    own = {"mean": [0.01 * d for d in range(dims)], "std": [0.5 + 0.1 * d for d in range(dims)], "q01": [-1 - 0.1 * d for d in range(dims)], "q99": [1 + 0.2 * d for d in range(dims)]}
    return {"state": own, "actions": own}


def _cut(first: int, n: int) -> Column:
    return F.transform(F.slice("embedding", first + 1, n), lambda v: v.cast("double"))


def _chunk(first: int, dims: int, steps: int) -> Column:
    return F.array(*[_cut(first + k * dims, dims) for k in range(steps)])


def _view(channels_first: bool, turned: bool = False) -> Column:
    """4 x 4 colours of 48 elements, in one of two layouts."""
    samples = F.transform(F.slice("embedding", 1, 48), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") + 0.5)))
    view = images.to_uint8(samples, *((3, 4, 4) if channels_first else (4, 4, 3)))
    return images.turned(view) if turned else view


def _bytes_weighed(image: Column) -> Column:
    """The sum of each byte times its place, from 1."""
    byte = lambda i: F.conv(F.substring(F.hex(image["data"]), i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.length(image["data"])), F.lit(0).cast("long"), lambda a, i: a + byte(i) * i)


def _told(made: DataFrame, back: DataFrame) -> DataFrame:
    """Long rows: state, actions, each view (its bytes weighed, dim 0, and its mask, dim 1) and what goes out."""
    place = lambda df, part, column: df.select("vec_id", F.lit(part).alias("part"), F.posexplode(column).alias("step", "_a")).select("vec_id", "part", "step", F.posexplode("_a").alias("dim", "v"))
    # an outer explode: before a plain one Spark puts a filter on the map's size, which makes every view a second time
    views = made.select("vec_id", F.explode_outer("image").alias("part", "_i"), "image_mask").select("vec_id", "part", F.lit(0).alias("step"), F.posexplode(F.array(_bytes_weighed(F.col("_i")).cast("double"), F.col("image_mask")[F.col("part")].cast("double"))).alias("dim", "v"))
    rows = place(made, "state", F.array("state")).unionByName(place(made, "actions", "actions")).unionByName(views).unionByName(place(back, "out", "actions"))
    return rows.select("vec_id", "part", "step", "dim", F.round("v", 6).alias("v"))


def _both_ways(df: DataFrame, data: P.Data) -> tuple[DataFrame, DataFrame]:
    """What training sees, and what a robot gets for a model's output of half of each action."""
    made = data.training()(df)
    answer = made.withColumn("actions", F.transform("actions", lambda a: F.transform(a, lambda v: v * 0.5)))
    return made, data.outgoing()(answer)


_BYTE = "floor(255 * greatest(0, least(1, embedding[k + 1]::DOUBLE + 0.5)))"
#: Weighed bytes of the views, from elements in either layout, turned or not.
_FIRST, _LAST, _TURNED = f"sum({_BYTE} * (k % 16 * 3 + k // 16 + 1))", f"sum({_BYTE} * (k + 1))", f"sum({_BYTE} * ((15 - k // 3) * 3 + k % 3 + 1))"


def _views_sql(slots: list[tuple[str, str, str]]) -> str:
    """(view, weighed bytes, mask) as rows."""
    one = [f"SELECT vec_id, '{name}' AS part, 0 AS step, unnest([0, 1]) AS dim, unnest([CASE WHEN {shown} THEN {weighed} ELSE 0 END::DOUBLE, ({mask})::INTEGER::DOUBLE]) AS v FROM embeddings, range(48) k(k) GROUP BY vec_id" for name, weighed, shown, mask in slots]
    return " UNION ALL ".join(one)


def _ways_sql(dims: int, steps: int, own: str, joints: str, scaled: str, unscaled: str, raw: str, encoded: str, views: str) -> str:
    return f"""a AS (SELECT vec_id, s::INTEGER AS s, d::INTEGER AS dim, embedding[s * {dims} + d + 1]::DOUBLE AS x FROM embeddings, range({steps + 1}) s(s), range({dims}) d(d)),
r AS (SELECT vec_id, s, dim, {raw} AS x FROM a), o AS (SELECT vec_id, s, dim, {own} AS x FROM r),
b AS (SELECT o.vec_id, o.s, o.dim, o.x - CASE WHEN o.s > 0 AND {joints} THEN t.x ELSE 0 END AS x, t.x AS state FROM o JOIN o t ON t.vec_id = o.vec_id AND t.dim = o.dim AND t.s = 0),
n AS (SELECT *, {scaled} AS z FROM b), u AS (SELECT *, 0.5 * z AS y FROM n), w AS (SELECT *, {unscaled} + CASE WHEN {joints.replace('o.dim', 'dim')} THEN state ELSE 0 END AS g FROM u),
l AS (SELECT vec_id, CASE WHEN s = 0 THEN 'state' ELSE 'actions' END AS part, greatest(s - 1, 0) AS step, dim, z AS v FROM n UNION ALL
SELECT vec_id, CASE WHEN s = 0 THEN 'state' ELSE 'actions' END, greatest(s - 1, 0), d::INTEGER, 0 FROM embeddings, range({steps + 1}) s(s), range({dims}, 32) d(d) UNION ALL
SELECT vec_id, 'out', s - 1, dim, {encoded} FROM w WHERE s > 0 UNION ALL {views})"""


_BY_Z, _UN_Z = f"(x - 0.01 * dim) / (0.5 + 0.1 * dim + {_EPSILON})", f"y * (0.5 + 0.1 * dim + {_EPSILON}) + 0.01 * dim"
_BY_Q, _UN_Q = f"(x + 1 + 0.1 * dim) / (2 + 0.3 * dim + {_EPSILON}) * 2 - 1", f"(y + 1) / 2 * (2 + 0.3 * dim + {_EPSILON}) - 1 - 0.1 * dim"
_SIGNED = "x * [" + ", ".join(map(str, robots.JOINT_SIGNS)) + "][dim + 1]"
_OPEN = "(x * (0.05800 - 0.01844) + 0.01844)"
_TWO_OWN = f"""CASE WHEN dim NOT IN (6, 13) THEN {_SIGNED} WHEN s = 0 THEN (asin(greatest(-1, least(1, (0.022 * 0.022 + {_OPEN} * {_OPEN} - 0.036 * 0.036) / (2 * 0.022 * {_OPEN})))) - 0.5476) / (1.6296 - 0.5476) ELSE x * (1.4910 + 0.6213) - 0.6213 - 0.5476 END"""
_TWO_OUT = f"CASE WHEN dim IN (6, 13) THEN (g + 0.5476 + 0.6213) / (1.4910 + 0.6213) ELSE {_SIGNED.replace('x *', 'g *')} END"
_TWO_RAW = "CASE WHEN s = 0 AND dim IN (6, 13) THEN greatest(0.05, least(1, abs(x) * 2)) ELSE x END"
_TWO_VIEWS = _views_sql([("base_0_rgb", _FIRST, "true", "true"), ("left_wrist_0_rgb", _FIRST, "vec_id % 3 > 0", "vec_id % 3 > 0"), ("right_wrist_0_rgb", _FIRST, "false", "false")])


@query(f"WITH {_ways_sql(14, 3, _TWO_OWN, 'o.dim NOT IN (6, 13)', _BY_Z, _UN_Z, _TWO_RAW, _TWO_OUT, _TWO_VIEWS)} SELECT vec_id, part, step, dim, round(v, 6) AS v FROM l")
def two_arm_record(spark, sf_dir):
    """Channels-first pictures, of which one camera's are missing at times and one's always; joints turned, grippers converted, deltas, scaled, padded."""
    state = F.transform(_cut(0, 14), lambda v, i: F.when(i.isin(*robots.GRIPPERS), robots.clip(F.abs(v) * 2, 0.05, 1.0)).otherwise(v))
    view = _view(channels_first=True)
    e = table(spark, sf_dir, "embeddings").select("vec_id", view.alias("observation.images.top"), F.when(F.col("vec_id") % 3 > 0, view).alias("observation.images.left"), state.alias("observation.state"), _chunk(14, 14, 3).alias("action"))
    names = {**P.TWO_ARM_REPACK, "images": {**P.TWO_ARM_REPACK["images"], "cam_left_wrist": "observation.images.left"}, "vec_id": "vec_id"}
    data = P.pipeline("two_arm_flow", repack=P.repacked(names), model=P.model_group("flow", 32, "fold it", _SIZE), stats=_stats(14))
    return _told(*_both_ways(e, data))


_TABLE_VIEWS = _views_sql([("base_0_rgb", _LAST, "true", "true"), ("left_wrist_0_rgb", _TURNED, "true", "true"), ("right_wrist_0_rgb", _LAST, "false", "false")])


@query(f"WITH {_ways_sql(7, 4, 'x', 'o.dim < 6', _BY_Z, _UN_Z, 'x', 'g', _TABLE_VIEWS)} SELECT vec_id, part, step, dim, round(v, 6) AS v FROM l")
def table_arm_record(spark, sf_dir):
    """A third-person and a wrist view, a third one that is black; delta joints, scaled and padded."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", _view(False).alias("image"), _view(False, True).alias("wrist_image"), _cut(0, 7).alias("state"), _chunk(7, 7, 4).alias("actions"), F.lit("stack_the cups ").alias("prompt"))
    data = P.pipeline("table_arm_flow_delta", repack=P.repacked({**P.TABLE_ARM_REPACK, "vec_id": "vec_id"}), model=P.model_group("flow", 32, size=_SIZE), stats=_stats(7))
    return _told(*_both_ways(e, data))


_FIELD_WAYS = _ways_sql(8, 5, "x", "o.dim < 7", _BY_Q, _UN_Q, "x", "g", _TABLE_VIEWS)


def _field(spark, sf_dir) -> tuple[DataFrame, P.Data]:
    seen = F.struct(_view(False).alias("image"), _view(False, True).alias("wrist_image"), _cut(0, 7).alias("joint_position"), _cut(7, 1).alias("gripper_position"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", seen.alias("observation"), _chunk(8, 8, 5).alias("actions"), F.concat(F.lit(" open_drawer "), F.col("vec_id").cast("string")).alias("prompt"))
    data = P.pipeline("field_arm_flow_discrete", repack=P.repacked({**P.FIELD_ARM_REPACK, "vec_id": "vec_id"}), model=P.model_group("flow_discrete", 32, size=_SIZE), stats=_stats(8))
    return e, data


@query(f"WITH {_FIELD_WAYS} SELECT vec_id, part, step, dim, round(v, 6) AS v FROM l")
def field_arm_record(spark, sf_dir):
    """Nested observations, joints and gripper in two columns; scaled by quantiles."""
    return _told(*_both_ways(*_field(spark, sf_dir)))


@query(f"""WITH {_FIELD_WAYS}, t AS (SELECT vec_id, string_agg(greatest(-1, least(255, floor((z + 1) * 128)))::INTEGER::VARCHAR, ' ' ORDER BY dim) AS s FROM n WHERE s = 0 GROUP BY vec_id)
SELECT vec_id, 'Task: open drawer ' || vec_id || ', State: ' || s || ';' || chr(10) || 'Action: ' AS prompt_text FROM t""")
def field_arm_prompt(spark, sf_dir):
    """The prompt with the scaled state's bins, as that robot's pipeline makes it."""
    e, data = _field(spark, sf_dir)
    return data.training()(e).select("vec_id", "prompt_text")


@query(f"""WITH b AS (SELECT vec_id, k, {_BYTE} AS v FROM embeddings, range(48) k(k))
SELECT vec_id, sum(v * (k + 1))::BIGINT AS stored, sum(v * ((15 - k // 3) * 3 + k % 3 + 1))::BIGINT AS turned FROM b GROUP BY vec_id""")
def decoded_frames(spark, sf_dir):
    """Pictures as PNG files, read back; and turned once they are pictures again."""
    from ..functions import frames

    back = frames.decoded(frames.encoded_png(_view(False)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", back.alias("i")).withColumn("t", images.turned(F.col("i")))
    return rows.select("vec_id", _bytes_weighed(F.col("i")).alias("stored"), _bytes_weighed(F.col("t")).alias("turned"))


_CUBIC = "CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1 WHEN d < 2 THEN ((-0.5 * d + 2.5) * d - 4) * d + 2 ELSE 0 END"


def _weights_sql(name: str, size: int, out: int) -> str:
    """Weights w of sample i of size for sample o of out."""
    scale = max(size / out, 1.0)
    return f"""{name}_d AS (SELECT o, i, abs(i + 0.5 - (o + 0.5) * {size / out!r}) / {scale!r} AS d FROM range({out}) o(o), range({size}) i(i)),
{name}_k AS (SELECT o, i, {_CUBIC} AS k FROM {name}_d), {name} AS (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS w FROM {name}_k)"""


@query(f"""WITH {_weights_sql('y', 8, 5)}, {_weights_sql('x', 8, 11)}, p AS (SELECT vec_id, k // 8 AS r, k % 8 AS c, embedding[k + 1]::DOUBLE * 2 AS v FROM embeddings, range(64) k(k))
SELECT vec_id, (y.o * 11 + x.o)::INTEGER AS place, round(sum(y.w * x.w * v), 4) AS v FROM p JOIN y ON y.i = p.r JOIN x ON x.i = p.c GROUP BY vec_id, y.o, x.o""")
def cubic_frames(spark, sf_dir):
    """8 x 8 samples resampled to 5 x 11 by the cubic kernel, narrower one way and wider the other."""
    @F.pandas_udf("array<double>")
    def resized(v: pd.Series) -> pd.Series:
        a = np.stack(v.to_numpy()).astype(np.float64).reshape(-1, 8, 8, 1) * 2
        return pd.Series(list(images.resize(a, 5, 11, kernel="cubic").reshape(len(a), -1)))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(resized("embedding")).alias("place", "v"))
    return rows.select("vec_id", "place", F.round("v", 4).alias("v"))
