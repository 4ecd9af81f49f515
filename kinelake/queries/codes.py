"""Gripper scales, grid positions, codebooks, drawn codes and loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, encodings, robots
from ..operators import sampling
from .registry import query, table
from .tables import _uniform_sql

_LEADER, _FOLLOWER = (("0.01244", "0.02417"), ("-0.6842", "0.3083")), (("0.01844", "0.058"), ("-0.6213", "1.491"))


def _gripper_sql(name: str, position, joint) -> str:
    wide, turn = f"({position[1]} - {position[0]})", f"({joint[1]} - ({joint[0]}))"
    columns = {
        "position_share": f"(x - {position[0]}) / {wide}",
        "position": f"x * {wide} + {position[0]}",
        "joint_share": f"(x - ({joint[0]})) / {turn}",
        "joint": f"x * {turn} + ({joint[0]})",
        "velocity_share": f"x / {wide}",
        "joint_at": f"(x - {position[0]}) / {wide} * {turn} + ({joint[0]})",
        "position_at": f"(x - ({joint[0]})) / {turn} * {wide} + {position[0]}",
    }
    return ", ".join(f"round({sql}, 5) AS {name}_{k}" for k, sql in columns.items())


@query(f"""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)
SELECT vec_id, {_gripper_sql("leader", *_LEADER)}, {_gripper_sql("follower", *_FOLLOWER)},
round((x - 0.01244) / (0.02417 - 0.01244) * (0.058 - 0.01844) + 0.01844, 5) AS followed_position,
round((x + 0.6842) / (0.3083 + 0.6842) * (1.491 + 0.6213) - 0.6213, 5) AS followed_joint FROM e""")
def gripper_scales(spark, sf_dir):
    x = F.get("embedding", F.lit(0)).cast("double")
    out = {"followed_position": robots.followed_position(x), "followed_joint": robots.followed_joint(x)}
    for name, g in (("leader", robots.LEADER), ("follower", robots.FOLLOWER)):
        own = {"position_share": g.position_share, "position": g.position_of, "joint_share": g.joint_share, "joint": g.joint_of, "velocity_share": g.velocity_share, "joint_at": g.joint_at, "position_at": g.position_at}
        out |= {f"{name}_{k}": f(x) for k, f in own.items()}
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 5).alias(k) for k, c in out.items()])


@query("""WITH p AS (SELECT vec_id, vec_id % 14 AS x, vec_id // 14 % 14 AS y FROM embeddings), k AS (SELECT range AS i, pow(10000.0, -range / 3.0) AS r FROM range(4)),
v AS (SELECT vec_id, i AS dim, sin(x * r) AS v FROM p, k UNION ALL SELECT vec_id, i + 4, cos(x * r) FROM p, k UNION ALL SELECT vec_id, i + 8, sin(y * r) FROM p, k UNION ALL SELECT vec_id, i + 12, cos(y * r) FROM p, k)
SELECT vec_id, dim::INTEGER AS dim, round(v, 6) AS v FROM v""")
def grid_positions(spark, sf_dir):
    """Patches of a 14 x 14 picture."""
    v = encodings.sincos_grid(F.col("vec_id") % 14, F.floor(F.col("vec_id") / 14) % 14, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


_SQUARE = [f"round_even((greatest(-1, least(1, embedding[{i}]::DOUBLE * 2)) + 1) * 31 / 2, 0)::INTEGER" for i in (1, 2)]


@query(f"SELECT vec_id, {_SQUARE[0]} + 32 * {_SQUARE[1]} AS code FROM embeddings")
def square_codes(spark, sf_dir):
    z = F.transform(F.slice("embedding", 1, 2), lambda v: robots.clip(v.cast("double") * 2, -1.0, 1.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", encodings.codebook_index(z, encodings.codebook_bins("square", 1024)).alias("code"))


@query(f"""WITH e AS (SELECT vec_id, {_uniform_sql("vec_id", 5)} AS u, unnest(range(64))::INTEGER AS place, unnest(embedding)::DOUBLE * 8 AS x FROM embeddings),
p AS (SELECT vec_id, u, place, x, exp(x / 0.7) / sum(exp(x / 0.7)) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY place) AS upto FROM p)
SELECT vec_id, least(count(*) FILTER (WHERE upto <= u), 63)::INTEGER AS drawn, arg_max(place, x)::INTEGER AS greedy FROM c GROUP BY vec_id""")
def drawn_codes(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double") * 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", sampling.chosen_code(x, 0.7, sampling.uniform(F.col("vec_id"), 5)).alias("drawn"), sampling.chosen_code(x, 0.0, F.lit(0.0)).alias("greedy"))


@query("""WITH d AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings)
SELECT vec_id, round(avg((a - b) * (a - b)), 6) AS mse, round(avg(abs(a - b)), 6) AS mae FROM d GROUP BY vec_id""")
def reconstruction_errors(spark, sf_dir):
    a, b = (F.transform(F.slice("embedding", i, 32), lambda v: v.cast("double")) for i in (1, 33))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.mean_square(a, b), 6).alias("mse"), F.round(arrays.mean_absolute(a, b), 6).alias("mae"))


_ORDERED = "o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index, count(*) OVER () AS n FROM orders)"


@query(f"""WITH {_ORDERED} SELECT o_orderkey, index // 64 AS batch, epoch::INTEGER AS epoch FROM o, (SELECT range AS epoch FROM range(2)) WHERE index < n // 64 * 64""")
def loader_epochs(spark, sf_dir):
    """Two epochs of full batches of 64."""
    return sampling.loaded(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, 2).select("o_orderkey", "batch", "epoch")


@query(f"WITH {_ORDERED} SELECT o_orderkey, index // 64 AS batch FROM o WHERE index // 64 < 1000 // 64")
def stats_batches(spark, sf_dir):
    """The batches of 64 that a limit of 1000 frames leaves to the statistics."""
    return sampling.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, most_rows=1000).select("o_orderkey", "batch")
