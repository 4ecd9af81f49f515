"""Episodes: events by user in order of time, embeddings as state and action vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, encodings, robots
from ..operators import episodes as E
from ..operators import statistics as S
from .registry import query, table

STEPS = "s AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INTEGER AS step FROM events)"
KEEP = f"""{STEPS},
i AS (SELECT user_id, step, coalesce(abs(value - lag(value) OVER w) < 20, false) AS idle FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)),
g AS (SELECT *, step - row_number() OVER (PARTITION BY user_id, idle ORDER BY step) AS island FROM i),
k AS (SELECT user_id, step, NOT (idle AND count(*) OVER (PARTITION BY user_id, idle, island) >= 7) AS keep FROM g),
h AS (SELECT *, step - row_number() OVER (PARTITION BY user_id, keep ORDER BY step) AS island FROM k),
r AS (SELECT user_id, min(step)::INTEGER AS start, (min(step) + count(*) - 10)::INTEGER AS "end" FROM h WHERE keep GROUP BY user_id, island HAVING count(*) >= 16)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_step_index(table(spark, sf_dir, "events"), "user_id", "ts")


def _ranges(s: DataFrame) -> DataFrame:
    return E.keep_ranges(s, "user_id", "step", F.array("value"), threshold=20.0)


@query(f'WITH {KEEP} SELECT user_id, start, "end" FROM r')
def idle_keep_ranges(spark, sf_dir):
    return _ranges(steps(spark, sf_dir))


@query(f"""WITH {STEPS}, i AS (SELECT user_id, step, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY step)) < 20, false) AS idle FROM s),
g AS (SELECT *, step - row_number() OVER (PARTITION BY user_id, idle ORDER BY step) AS island FROM i)
SELECT user_id, idle, min(step)::INTEGER AS start, count(*)::INTEGER AS length FROM g GROUP BY user_id, idle, island""")
def idle_runs(spark, sf_dir):
    idle = E.with_idle(steps(spark, sf_dir), "user_id", "step", F.array("value"), 20.0)
    return E.runs(idle, "user_id", "step", "idle").select("user_id", "idle", "start", "length")


@query(f'WITH {KEEP} SELECT s.user_id, s.step, s.event_id FROM s JOIN r ON s.user_id = r.user_id AND s.step >= r.start AND s.step < r."end"')
def allowlist_frames(spark, sf_dir):
    s = steps(spark, sf_dir)
    return E.allow_frames(s, _ranges(s), "user_id", "step").select("user_id", "step", "event_id")


_H = "h AS (SELECT range AS k FROM range(4)), n AS (SELECT user_id, max(step) AS last FROM s GROUP BY user_id)"
_CHUNKS = f"WITH {STEPS}, {_H}, c AS (SELECT s.user_id, s.step, k::INTEGER AS k, s.value AS own, b.value AS value FROM s JOIN n USING (user_id) CROSS JOIN h JOIN s b ON b.user_id = s.user_id AND b.step = least(s.step + k, last))"


def _chunked(spark, sf_dir, horizon=4):
    return E.action_chunks(steps(spark, sf_dir), "user_id", "step", "value", horizon)


@query(f"{_CHUNKS} SELECT user_id, step, k, value FROM c")
def action_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir).select("user_id", "step", F.posexplode("chunk").alias("k", "value"))


def _pairs(spark, sf_dir):
    """Two-dimensional actions: the value and the chunk's own place; the state is the step's own value and its number."""
    own = _chunked(spark, sf_dir).withColumn("state", F.array("value", F.col("step").cast("double")))
    return own.withColumn("actions", F.transform("chunk", lambda v, k: F.array(v, k.cast("double"))))


@query(f"{_CHUNKS} SELECT user_id, step, k, round(value - own, 6) AS d0, k::DOUBLE AS d1 FROM c")
def delta_actions(spark, sf_dir):
    out = _pairs(spark, sf_dir).withColumn("actions", arrays.delta_actions(F.col("actions"), F.col("state"), arrays.bool_mask(1, -1)))
    return out.select("user_id", "step", F.posexplode("actions").alias("k", "a")).select("user_id", "step", "k", F.round(F.get("a", F.lit(0)), 6).alias("d0"), F.get("a", F.lit(1)).alias("d1"))


@query(f"{_CHUNKS} SELECT user_id, step, k, round(value, 6) AS d0, k::DOUBLE AS d1 FROM c")
def absolute_actions(spark, sf_dir):
    mask = arrays.bool_mask(1, -1)
    out = _pairs(spark, sf_dir).withColumn("actions", arrays.delta_actions(F.col("actions"), F.col("state"), mask)).withColumn("actions", arrays.absolute_actions(F.col("actions"), F.col("state"), mask))
    return out.select("user_id", "step", F.posexplode("actions").alias("k", "a")).select("user_id", "step", "k", F.round(F.get("a", F.lit(0)), 6).alias("d0"), F.get("a", F.lit(1)).alias("d1"))


@query(f"""WITH {STEPS}, n AS (SELECT user_id, max(step) AS last FROM s GROUP BY user_id)
SELECT s.user_id, s.step, (s.step // 4 * 4)::INTEGER AS infer_step, (s.step % 4)::INTEGER AS "offset", b.value AS action
FROM s JOIN n USING (user_id) JOIN s b ON b.user_id = s.user_id AND b.step = least(s.step // 4 * 4 + s.step % 4, last)""")
def chunk_broker_trace(spark, sf_dir):
    return E.brokered(_chunked(spark, sf_dir), "user_id", "step", "chunk", 4).select("user_id", "step", "infer_step", "offset", "action")


@query(f"WITH {STEPS} SELECT user_id, (step // 5)::BIGINT AS replan, count(*) AS n_steps, min(step) AS first_step, round(sum(value), 4) AS total FROM s GROUP BY user_id, step // 5")
def replan_windows(spark, sf_dir):
    s = steps(spark, sf_dir)
    return s.groupBy("user_id", F.floor(F.col("step") / 5).alias("replan")).agg(F.count("*").alias("n_steps"), F.min("step").alias("first_step"), F.round(F.sum("value"), 4).alias("total"))


_DIMS = "d AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _hist_sql(values: str, by: str) -> str:
    """values: a CTE v of by and x."""
    return f"""{values},
w AS (SELECT {by}, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM v GROUP BY {by}),
b AS (SELECT {by}, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 5000)), 4999) ELSE 0 END AS part, count(*) AS c FROM v JOIN w USING ({by}) GROUP BY ALL),
c AS (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY part) AS so_far FROM b),
q AS (SELECT {by}, min(part) FILTER (so_far >= n * 0.01) AS p1, min(part) FILTER (so_far >= n * 0.99) AS p99 FROM c JOIN w USING ({by}) GROUP BY {by}),
st AS (SELECT {by}, n, mean, std, lo + p1 * ((hi - lo) / 5000) AS q01, lo + p99 * ((hi - lo) / 5000) AS q99 FROM w JOIN q USING ({by}))"""


_VECTOR_STATS = _hist_sql(f"{_DIMS}, v AS (SELECT dim, x FROM d)", "dim")


def _vector_stats(spark, sf_dir):
    return S.norm_stats(S.vector_values(table(spark, sf_dir, "embeddings"), "embedding"))


@query(f"WITH {_VECTOR_STATS} SELECT 'embedding' AS key, dim, n, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM st")
def norm_stats_vector(spark, sf_dir):
    s = S.checked_stats(_vector_stats(spark, sf_dir))
    return s.select("key", "dim", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q01", "q99")])


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_COLUMN_STATS = _hist_sql("v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS key, {c} AS x FROM lineitem" for c in _COLUMNS) + ")", "key")


@query(f"WITH {_COLUMN_STATS} SELECT key, n, round(mean, 4) AS mean, round(std, 4) AS std, round(q01, 4) AS q01, round(q99, 4) AS q99 FROM st")
def norm_stats_columns(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(*_COLUMNS).unpivot([], list(_COLUMNS), "key", "x")
    return S.norm_stats(values, ["key"]).select("key", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "q01", "q99")])


def _with_stats(spark, sf_dir):
    """State vectors, each with the statistics as arrays: one row of them, as long as a vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rows.join(F.broadcast(S.stats_arrays(_vector_stats(spark, sf_dir)).drop("key")), F.lit(True))


def _long(df):
    return df.select("vec_id", F.posexplode("y").alias("dim", "y")).select("vec_id", "dim", F.round("y", 5).alias("y"))


@query(f"WITH {_VECTOR_STATS} SELECT vec_id, dim, round((x - mean) / (std + 1e-6), 5) AS y FROM d JOIN st USING (dim)")
def normalize_z(spark, sf_dir):
    return _long(_with_stats(spark, sf_dir).withColumn("y", arrays.normalize_z(F.col("x"), F.col("mean"), F.col("std"))))


@query(f"WITH {_VECTOR_STATS} SELECT vec_id, dim, round((x - q01) / (q99 - q01 + 1e-6) * 2 - 1, 5) AS y FROM d JOIN st USING (dim)")
def normalize_q(spark, sf_dir):
    return _long(_with_stats(spark, sf_dir).withColumn("y", arrays.normalize_q(F.col("x"), F.col("q01"), F.col("q99"))))


@query(f"WITH {_DIMS} SELECT vec_id, dim, round(x, 5) AS y FROM d")
def unnormalize_roundtrip(spark, sf_dir):
    z = _with_stats(spark, sf_dir).withColumn("z", arrays.normalize_z(F.col("x"), F.col("mean"), F.col("std")))
    q = z.withColumn("x", arrays.unnormalize_z(F.col("z"), F.col("mean"), F.col("std"))).withColumn("z", arrays.normalize_q(F.col("x"), F.col("q01"), F.col("q99")))
    return _long(q.withColumn("y", arrays.unnormalize_q(F.col("z"), F.col("q01"), F.col("q99"))))


@query(f"WITH {_DIMS}, e AS (SELECT list(range / 128.0 - 1) AS edges FROM range(256)) SELECT vec_id, dim, (len(list_filter(edges, lambda v: v <= x * 2.5)) - 1)::INTEGER AS bin FROM d, e")
def digitize_state(spark, sf_dir):
    x = F.transform("embedding", lambda v: encodings.digitize(v.cast("double") * 2.5))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(x).alias("dim", "bin"))


@query(f"WITH {_DIMS} SELECT vec_id, (dim // 8)::INTEGER AS h, (dim % 8)::INTEGER AS d, round(floor(greatest(least((x + 1) * 128, 255), 0)) / 256 * 2 - 1, 6) AS a FROM d")
def binning_decode(spark, sf_dir):
    """Tokens of a state as a chunk of 8 actions of 8 dimensions."""
    tokens = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: encodings.digitize(v.cast("double"))).alias("t"))
    chunk = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.transform(F.slice("t", h * 8 + 1, 8), lambda t: encodings.undigitize(t)))
    rows = tokens.select("vec_id", F.posexplode(chunk).alias("h", "v"))
    return rows.select("vec_id", "h", F.posexplode("v").alias("d", "a")).select("vec_id", "h", "d", F.round("a", 6).alias("a"))


_FSQ = (8, 5, 5, 5)
_DIGITS = ", ".join(f"round_even((greatest(-1, least(1, embedding[{i + 1}]::DOUBLE * 2)) + 1) * {b - 1} / 2, 0)::INTEGER AS g{i}" for i, b in enumerate(_FSQ))


@query(f"WITH g AS (SELECT vec_id, {_DIGITS} FROM embeddings) SELECT vec_id, g0 + g1 * 8 + g2 * 40 + g3 * 200 AS code, round(g0 / 3.5 - 1, 6) AS z0, round(g1 / 2.0 - 1, 6) AS z1, round(g2 / 2.0 - 1, 6) AS z2, round(g3 / 2.0 - 1, 6) AS z3 FROM g")
def fsq_codes(spark, sf_dir):
    z = F.transform(F.slice("embedding", 1, 4), lambda v: robots.clip(v.cast("double") * 2, -1.0, 1.0))
    out = table(spark, sf_dir, "embeddings").select("vec_id", encodings.codebook_index(z, _FSQ).alias("code"))
    levels = encodings.codebook_levels(F.col("code"), _FSQ)
    return out.select("vec_id", "code", *[F.round(F.get(levels, F.lit(i)), 6).alias(f"z{i}") for i in range(4)])


@query("SELECT vec_id, w::INTEGER AS word, list_sum([CASE WHEN embedding[16 * w + i + 1] > 0 THEN 2**i ELSE 0 END FOR i IN range(16)])::BIGINT AS code FROM embeddings, range(4) t(w)")
def sign_codes(spark, sf_dir):
    words = F.array(*[encodings.bits_index(F.slice("embedding", 16 * w + 1, 16)) for w in range(4)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(words).alias("word", "code"))


@query("""WITH p AS (SELECT vec_id, greatest(0.05, least(1, abs(embedding[1]::DOUBLE) * 2)) AS g FROM embeddings),
q AS (SELECT vec_id, g, g * (0.05800 - 0.01844) + 0.01844 AS p FROM p)
SELECT vec_id, round((asin(greatest(-1, least(1, (0.022 * 0.022 + p * p - 0.036 * 0.036) / (2 * 0.022 * p)))) - 0.5476) / (1.6296 - 0.5476), 6) AS angle,
round((g + 0.5476 + 0.6213) / (1.4910 + 0.6213), 6) AS encoded, round(g, 6) AS back FROM q""")
def gripper_to_angular(spark, sf_dir):
    g = table(spark, sf_dir, "embeddings").select("vec_id", robots.clip(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 2, 0.05, 1.0).alias("g"))
    encoded = robots.gripper_from_angular(F.col("g"))
    return g.select("vec_id", F.round(robots.gripper_to_angular(F.col("g")), 6).alias("angle"), F.round(encoded, 6).alias("encoded"), F.round(robots.gripper_from_angular_inverse(encoded), 6).alias("back"))


@query("""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings),
n AS (SELECT vec_id, x / m AS x, y / m AS y, z / m AS z, w / m AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS m FROM q)),
a AS (SELECT *, sqrt(1 - w * w) AS den, 2 * acos(w) AS angle FROM n)
SELECT vec_id, round(x * angle / den, 6) AS ax, round(y * angle / den, 6) AS ay, round(z * angle / den, 6) AS az FROM a""")
def quat_axis_angle(spark, sf_dir):
    q = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    m = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    a = robots.axis_angle(*[c / m for c in q])
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(F.get(a, F.lit(i)), 6).alias(n) for i, n in enumerate(("ax", "ay", "az"))])


@query(f"WITH {_DIMS} SELECT vec_id, dim, round(CASE WHEN dim = 7 THEN CASE WHEN x * 4 > 0.5 THEN 1 ELSE 0 END ELSE greatest(-1, least(1, x * 4)) END, 6) AS a FROM d WHERE dim < 8")
def action_clip(spark, sf_dir):
    a = robots.clip_action(F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double") * 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(a).alias("dim", "a")).select("vec_id", "dim", F.round("a", 6).alias("a"))


_SIGNS = "[" + ", ".join(str(s) for s in robots.JOINT_SIGNS) + "]"


@query(f"WITH {_DIMS} SELECT vec_id, dim, round(CASE WHEN dim IN (6, 13) THEN (x + 0.5476 + 0.6213) / (1.4910 + 0.6213) ELSE x * {_SIGNS}[dim + 1] END, 6) AS a FROM d WHERE dim < 14")
def two_arm_actions(spark, sf_dir):
    own = F.array(F.transform(F.slice("embedding", 1, 14), lambda v: v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.get(robots.encode_actions(own), F.lit(0)).alias("a"))
    return rows.select("vec_id", F.posexplode("a").alias("dim", "a")).select("vec_id", "dim", F.round("a", 6).alias("a"))


@query("""WITH p AS (SELECT vec_id, vec_id % 50 AS pos FROM embeddings), k AS (SELECT range AS i FROM range(8)),
r AS (SELECT vec_id, i, pos * 2 * pi() / (0.004 * pow(4.0 / 0.004, i / 7.0)) AS t FROM p, k)
SELECT vec_id, i::INTEGER AS dim, round(sin(t), 4) AS v FROM r UNION ALL SELECT vec_id, (i + 8)::INTEGER, round(cos(t), 4) FROM r""")
def sincos_positions(spark, sf_dir):
    v = encodings.sincos(F.col("vec_id") % 50, 16, 4e-3, 4.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "v")).select("vec_id", "dim", F.round("v", 4).alias("v"))


@query("""WITH p AS (SELECT vec_id, vec_id % 50 AS pos, embedding AS e FROM embeddings), k AS (SELECT range AS i FROM range(4)),
r AS (SELECT vec_id, i, e[i + 1]::DOUBLE AS a, e[i + 5]::DOUBLE AS b, pos * pow(10000.0, -2 * i / 8.0) AS t FROM p, k)
SELECT vec_id, i::INTEGER AS dim, round(a * cos(t) - b * sin(t), 6) AS v FROM r UNION ALL SELECT vec_id, (i + 4)::INTEGER, round(b * cos(t) + a * sin(t), 6) FROM r""")
def rotary_positions(spark, sf_dir):
    v = encodings.rotary(F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id") % 50, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


@query(f"""WITH {_DIMS}, x AS (SELECT vec_id, dim, x * 8 AS x FROM d), m AS (SELECT vec_id, max(x) AS m, sum(exp(x)) AS s, arg_max(dim, x) AS best FROM x GROUP BY vec_id)
SELECT vec_id, dim, round(exp(x) / s, 6) AS p, round(x - ln(s), 6) AS logp, (dim = best)::INTEGER AS best FROM x JOIN m USING (vec_id)""")
def softmax_logits(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double") * 8)
    z = F.arrays_zip(arrays.softmax(x).alias("p"), arrays.log_softmax(x).alias("l"), arrays.one_hot(arrays.arg_max(x), 64).alias("b"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(z).alias("dim", "z"))
    return rows.select("vec_id", "dim", F.round("z.p", 6).alias("p"), F.round("z.l", 6).alias("logp"), F.col("z.b").alias("best"))


@query("""WITH d AS (SELECT vec_id, (vec_id % 10) / 10.0 AS t, unnest(range(32))::INTEGER AS dim, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS n FROM embeddings)
SELECT vec_id, round(sum(t * n + (1 - t) * a), 6) AS x, round(sum(n - a), 6) AS u, round(avg((n - a) * (n - a)), 6) AS mse FROM d GROUP BY vec_id""")
def flow_targets(spark, sf_dir):
    cut = lambda i: F.transform(F.slice("embedding", i, 32), lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    a, n, t = cut(1), cut(33), (F.col("vec_id") % 10) / 10.0
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(total(arrays.interpolate(n, a, t)), 6).alias("x"), F.round(total(arrays.difference(n, a)), 6).alias("u"), F.round(arrays.mean_square(n, a), 6).alias("mse")
    )


@query("SELECT vec_id, round(list_sum([x::DOUBLE FOR x IN embedding]) * pow(0.9, 10), 5) AS total FROM embeddings")
def euler_decay(spark, sf_dir):
    """Ten steps of x' = x, from time 1 to 0."""
    x = encodings.euler_steps(F.transform("embedding", lambda v: v.cast("double")), lambda v, t: v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 4000 * 10 AS step FROM orders)
SELECT o_orderkey, step, round(CASE WHEN step < 1000 THEN 2.5e-5 / 1001 + (2.5e-5 - 2.5e-5 / 1001) * step / 1000 ELSE 2.5e-6 + (2.5e-5 - 2.5e-6) * 0.5 * (1 + cos(pi() * least(1, (step - 1000) / 29000.0))) END * 1e9, 3) AS cosine,
round(CASE WHEN step < 1000 THEN 5e-5 / 1001 + (5e-5 - 5e-5 / 1001) * step / 1000 ELSE 5e-5 / sqrt((10000 + step - 1000) / 10000.0) END * 1e9, 3) AS rsqrt FROM k""")
def lr_schedule(spark, sf_dir):
    step = F.col("step")
    cosine, rsqrt = encodings.warmup_cosine(step, 1000, 2.5e-5, 30_000, 2.5e-6), encodings.warmup_rsqrt(step, 1000, 5e-5, 10_000)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4000 * 10).alias("step"))
    return rows.select("o_orderkey", "step", F.round(cosine * 1e9, 3).alias("cosine"), F.round(rsqrt * 1e9, 3).alias("rsqrt"))


@query("SELECT user_id, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def latest_by_key(spark, sf_dir):
    return E.latest_by_key(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id").drop("ts").select("user_id", "value", "event_id")


@query("""WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)
SELECT event_id, round(1e6 / avg(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 48 PRECEDING AND CURRENT ROW) * 1e6, 4) AS rate FROM g""")
def arrival_rate(spark, sf_dir):
    return E.arrival_rate(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", F.round(F.col("rate") * 1e6, 4).alias("rate"))


@query("""SELECT e.event_id, p.value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_latest_view(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return E.as_of(left, events.where("event_type = 'view'"), "user_id", "ts", "value").select("event_id", "value")


@query(f"""WITH {STEPS}, f AS (SELECT user_id, step, event_id * 10 AS frame FROM s WHERE event_id % 13 <> 0),
j AS (SELECT s.user_id, s.step, f.frame, min((f.frame IS NOT NULL)::INTEGER) OVER (PARTITION BY s.user_id ORDER BY s.step) AS ok FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.step = f.step)
SELECT user_id, step, frame FROM j WHERE ok = 1""")
def load_trajectory(spark, sf_dir):
    """Steps with their camera frames, up to an episode's first step without one."""
    s = steps(spark, sf_dir)
    frames = s.where("event_id % 13 <> 0").select("user_id", "step", (F.col("event_id") * 10).alias("frame"))
    return E.joined_until_missing(s.select("user_id", "step"), frames, "user_id", "step").select("user_id", "step", "frame")


@query("""WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, 3 + vec_id % 4 AS n FROM embeddings)
SELECT vec_id, k::INTEGER AS tick, round(a + (b - a) * k / (n - 1), 6) AS value FROM m, LATERAL (SELECT unnest(range(n)) AS k)""")
def linear_moves(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    return E.interpolated(e, F.col("a"), F.col("b"), 3 + F.col("vec_id") % 4).select("vec_id", "tick", F.round("value", 6).alias("value"))


@query(f"""WITH {STEPS}, t AS (SELECT user_id, (step // 100)::BIGINT AS interval, value, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS norm FROM s)
SELECT interval, count(*) AS n, round(avg(value), 6) AS value, round(avg(norm), 6) AS norm FROM t GROUP BY interval""")
def interval_means(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("norm", F.when(F.col("event_type") != "view", F.col("value")))
    return S.interval_means(s, "step", 100, "value", "norm").select("interval", "n", F.round("value", 6).alias("value"), F.round("norm", 6).alias("norm"))


@query(f"""WITH {STEPS}, t AS (SELECT user_id, (step // 7)::BIGINT AS interval, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS norm FROM s)
SELECT interval, count(*) AS n, round(avg(norm), 6) AS norm FROM t GROUP BY interval""")
def interval_averages(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("norm", F.when(F.col("event_type") != "view", F.col("value")))
    return S.interval_means(s, "step", 7, "norm").select("interval", "n", F.round("norm", 6).alias("norm"))


@query(f"""WITH RECURSIVE {STEPS}, e AS (SELECT user_id, step, value AS average FROM s WHERE step = 0 UNION ALL
SELECT s.user_id, s.step, 0.9 * e.average + (1 - 0.9) * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.step = e.step + 1)
SELECT user_id, round(arg_max(average, step), 4) AS average FROM e GROUP BY user_id""")
def moving_averages(spark, sf_dir):
    return S.moving_average(steps(spark, sf_dir), "user_id", "step", "value", 0.9).select("user_id", F.round("average", 4).alias("average"))


@query("SELECT round(sqrt(sum(x * x)), 5) AS norm FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def global_norm(spark, sf_dir):
    return S.global_norm(S.vector_values(table(spark, sf_dir, "embeddings"), "embedding"), "x").select(F.round("norm", 5).alias("norm"))


@query(f"WITH {STEPS} SELECT user_id, count(*) AS n_steps, max(value) AS reward FROM s WHERE step < 40 GROUP BY user_id")
def episode_reward(spark, sf_dir):
    """Episodes cut at 40 steps; the reward is the greatest so far."""
    return steps(spark, sf_dir).where("step < 40").groupBy("user_id").agg(F.count("*").alias("n_steps"), F.max("value").alias("reward"))


@query(f"WITH {STEPS} SELECT user_id, step, 'u' || user_id || '--' || event_type || '--' || step AS step_id FROM s")
def step_ids(spark, sf_dir):
    from ..functions.text import step_id

    own = step_id(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type"), F.col("step"))
    return steps(spark, sf_dir).select("user_id", "step", own.alias("step_id"))
