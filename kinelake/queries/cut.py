"""The windows over episodes that are cut into blocks of a few steps: the same rows as without cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from . import trajectory  # noqa: F401  its SQL is held against these too
from .registry import ORACLE_SQL, query, table

#: Steps of a block: few, so that at any scale every episode of the tables lies in several blocks.
BLOCK = 16


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, B.Strided]:
    events = table(spark, sf_dir, "events")
    numbered = B.with_step_index(events, B.cut_points(events, "user_id", "ts", BLOCK))
    return numbered, B.Strided("user_id", "step", BLOCK)


@query(ORACLE_SQL["step_ids"].replace("'u' || user_id || '--' || event_type || '--' || step AS step_id", "event_id"))
def cut_step_index(spark, sf_dir):
    return _steps(spark, sf_dir)[0].select("user_id", "step", "event_id")


@query(ORACLE_SQL["idle_keep_ranges"])
def cut_keep_ranges(spark, sf_dir):
    s, blocks = _steps(spark, sf_dir)
    return B.keep_ranges(s, blocks, F.array("value"), threshold=20.0).select("user_id", "start", "end")


@query(ORACLE_SQL["idle_runs"])
def cut_idle_runs(spark, sf_dir):
    s, blocks = _steps(spark, sf_dir)
    return B.runs(B.with_idle(s, blocks, F.array("value"), 20.0), blocks, "idle").select("user_id", "idle", "start", "length")


@query(ORACLE_SQL["action_chunks"])
def cut_action_chunks(spark, sf_dir):
    s, blocks = _steps(spark, sf_dir)
    return B.action_chunks(s, blocks, "value", 4).select("user_id", "step", F.posexplode("chunk").alias("k", "value"))


@query(ORACLE_SQL["arrival_rate"])
def cut_arrival_rate(spark, sf_dir):
    s, blocks = _steps(spark, sf_dir)
    return B.arrival_rate(s, blocks, "ts").select("event_id", F.round(F.col("rate") * 1e6, 4).alias("rate"))


@query(ORACLE_SQL["load_trajectory"])
def cut_load_trajectory(spark, sf_dir):
    s, blocks = _steps(spark, sf_dir)
    frames = s.where("event_id % 13 <> 0").select("user_id", "step", (F.col("event_id") * 10).alias("frame"))
    return B.joined_until_missing(s.select("user_id", "step"), frames, blocks).select("user_id", "step", "frame")


@query(ORACLE_SQL["asof_latest_view"])
def cut_asof_view(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return B.as_of(left, events.where("event_type = 'view'"), "user_id", "ts", "value", BLOCK).select("event_id", "value")


@query(ORACLE_SQL["moving_averages"])
def cut_moving_averages(spark, sf_dir):
    s, blocks = _steps(spark, sf_dir)
    return B.moving_average(s, blocks, "value", 0.9).select("user_id", F.round("average", 4).alias("average"))


_SECONDS = "e AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t FROM events)"
_OFFSETS, _TOLERANCE = (-36000.0, -90.5, 0.0, 3600.0, 400000.0), 7200.0


@query(f"""WITH {_SECONDS}, n AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY user_id),
o AS (SELECT unnest(range({len(_OFFSETS)}))::INTEGER AS k, unnest([{', '.join(map(str, _OFFSETS))}])::DOUBLE AS "offset"),
a AS (SELECT user_id, event_id, k, t + "offset" < lo - {_TOLERANCE} OR t + "offset" > hi + {_TOLERANCE} AS is_pad, greatest(least(t + "offset", hi), lo) AS q FROM e JOIN n USING (user_id), o),
b AS (SELECT a.*, l.t AS lt, l.value AS lv FROM a ASOF LEFT JOIN e l ON a.user_id = l.user_id AND a.q >= l.t),
c AS (SELECT b.*, r.t AS rt, r.value AS rv FROM b ASOF LEFT JOIN e r ON b.user_id = r.user_id AND b.q <= r.t)
SELECT user_id, event_id, k, is_pad, CASE WHEN lt IS NOT NULL AND (rt IS NULL OR q - lt <= rt - q) THEN CASE WHEN q - lt <= {_TOLERANCE} THEN lv END WHEN rt - q <= {_TOLERANCE} THEN rv END AS value FROM c""")
def time_offset_windows(spark, sf_dir):
    """The frames nearest to uneven offsets in time, before and after, of every event; clamped at its episode's ends."""
    from ..operators import time_windows as W

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6).alias("t"))
    found = W.at_offsets(e, "user_id", "t", "value", _OFFSETS, _TOLERANCE, most=16 * BLOCK)
    return found.join(e.select("user_id", "t", "event_id"), ["user_id", "t"]).select("user_id", "event_id", "k", "is_pad", "value")


_FRAMES = (-5, -1, 0, 2, 9)


@query(f"""WITH {trajectory.STEPS}, n AS (SELECT user_id, max(step) AS last FROM s GROUP BY user_id), o AS (SELECT unnest(range({len(_FRAMES)}))::INTEGER AS k, unnest({list(_FRAMES)}) AS o)
SELECT s.user_id, s.step, k, b.value, s.step + o < 0 OR s.step + o > last AS is_pad FROM s JOIN n USING (user_id) CROSS JOIN o JOIN s b ON b.user_id = s.user_id AND b.step = greatest(0, least(s.step + o, last))""")
def frame_offset_windows(spark, sf_dir):
    from ..operators import time_windows as W

    s, blocks = _steps(spark, sf_dir)
    rows = W.at_frames(s, blocks, "value", _FRAMES)
    each = rows.select("user_id", "step", F.posexplode(F.arrays_zip("window", "window_is_pad")).alias("k", "z"))
    return each.select("user_id", "step", "k", F.col("z.window").alias("value"), F.col("z.window_is_pad").alias("is_pad"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, or in a local session a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kinelake-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {trajectory.STEPS} SELECT user_id, step, event_type AS kind, round(value, 4) AS value, user_id % 3 = 0 AS marked FROM s WHERE user_id >= 20 AND user_id < 90 AND step <> 5")
def record_files(spark, sf_dir):
    """Steps written as framed records and read by a named format, of which files of other episodes stay shut."""
    from ..sources import registry

    s = trajectory.steps(spark, sf_dir).select("user_id", "step", F.col("event_type").alias("kind"), (F.col("value") * 10_000).cast("long").alias("scaled"), F.array(F.col("value").cast("float")).alias("values"), (F.col("user_id") % 3 == 0).alias("marked"))
    path = _folder(spark, "records")
    registry.write_records(s, path, "user_id")
    back = spark.read.format("episode_records").schema(s.schema).option("episode", "user_id").load(path)
    rows = back.where("user_id >= 20 AND user_id < 90 AND step <> 5")
    return rows.select("user_id", "step", "kind", F.round(F.get("values", F.lit(0)).cast("double"), 4).alias("value"), "marked")


@query(f"WITH {trajectory.STEPS} SELECT user_id, step, event_id FROM s WHERE user_id % 4 <> 3 UNION ALL SELECT user_id, step, -event_id FROM s WHERE user_id % 4 = 1")
def versioned_steps(spark, sf_dir):
    """A table of versions: two micro-batches of one run, of which the first comes again, and one of another run."""
    from ..sources.versions import Versions

    s = trajectory.steps(spark, sf_dir).select("user_id", "step", "event_id")
    v = Versions(spark, _folder(spark, "versions"))
    part = lambda k, sign=1: {"steps": s.where(f"user_id % 4 = {k}").withColumn("event_id", F.col("event_id") * sign)}
    for run, batch, made in (("a", 0, part(0)), ("a", 1, part(1)), ("a", 0, part(0)), ("b", 0, part(2)), ("b", 1, part(1, -1)), ("a", 1, part(3))):
        v.append(made, run, batch)
    return v.read("steps")
