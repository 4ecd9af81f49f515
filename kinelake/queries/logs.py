"""Ingest, side files, records, timing and masks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, encodings, images
from ..operators import episodes as E
from ..operators import reshape, trajectories
from ..sources import codec, convert, files
from .registry import query, table
from .trajectory import KEEP, STEPS, _ranges, steps


#: Steps that are put into one row at most.
_STRETCH = 4096


@query(f'WITH {KEEP} SELECT user_id::VARCHAR AS episode, start, "end" FROM r')
def ranges_through_json(spark, sf_dir):
    """Ranges as one JSON text for each episode, and back."""
    return files.ranges_of(files.range_lines(_ranges(steps(spark, sf_dir)).withColumnRenamed("user_id", "episode")))


@query(f"WITH {STEPS} SELECT user_id, step, value, event_type AS kind FROM s")
def episodes_to_frames(spark, sf_dir):
    """Episodes with arrays of equal lengths, a row for each stretch of steps, as frames again."""
    stretch = F.floor(F.col("step") / _STRETCH).cast("int").alias("stretch")
    rows = steps(spark, sf_dir).groupBy("user_id", stretch).agg(F.sort_array(F.collect_list(F.struct("step", "value", "event_type"))).alias("s"))
    wide = files.equal_lengths(rows.select("user_id", "stretch", F.col("s.value").alias("value"), F.col("s.event_type").alias("kind")), "value", "kind").drop("length")
    return files.frames_of(wide, "value", "kind").select("user_id", (F.col("stretch") * _STRETCH + F.col("step")).alias("step"), "value", "kind")


@query(f"""WITH {STEPS}, a AS (SELECT user_id, step, value, 0 AS source_index FROM s WHERE user_id % 2 = 0), b AS (SELECT user_id, step, value, 1 AS source_index FROM s WHERE user_id % 2 = 1),
u AS (SELECT * FROM a UNION ALL SELECT user_id + (SELECT max(user_id) + 1 FROM a), step, value, source_index FROM b)
SELECT user_id AS episode_index, step, value, source_index FROM u""")
def united_sources(spark, sf_dir):
    s = steps(spark, sf_dir).select(F.col("user_id").alias("episode_index"), "step", "value")
    return convert.united([s.where("episode_index % 2 = 0"), s.where("episode_index % 2 = 1")]).select("episode_index", "step", "value", "source_index")


@query(f"""WITH {STEPS} SELECT user_id, step, round(value, 6) AS a0, round(event_id::DOUBLE, 6) AS a1, CASE WHEN user_id % 3 = 0 THEN 'note ' || user_id ELSE 'Do something' END AS task FROM s WHERE coalesce(CASE WHEN event_type = 'error' THEN false WHEN event_type = 'view' THEN true END, true)""")
def converted_log(spark, sf_dir):
    """Moving steps alone, with their actions put together and the episode's instruction or what stands for none."""
    s = steps(spark, sf_dir).withColumn("movement_enabled", F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "view", True))
    notes = s.select("user_id").distinct().where("user_id % 3 = 0").select("user_id", F.concat(F.lit("note "), F.col("user_id").cast("string")).alias("note"))
    parts = convert.moving_steps(s).withColumn("velocity", F.array("value")).withColumn("gripper", F.col("event_id").cast("double"))
    out = convert.with_task(convert.with_actions(parts, "velocity", "gripper"), notes, "user_id")
    return out.select("user_id", "step", F.round(F.get("actions", F.lit(0)), 6).alias("a0"), F.round(F.get("actions", F.lit(1)), 6).alias("a1"), "task")


@query(f"WITH {STEPS} SELECT user_id, step, unnest(['inputs/value', 'outputs/total']) AS name, unnest([value, value * 2]) AS value FROM s")
def metrics_table(spark, sf_dir):
    """Records in flat columns, then as a row for each metric."""
    s = steps(spark, sf_dir).withColumn("total", F.col("value") * 2)
    flat = files.recorded(s, ["value", "user_id"], ["total"])
    return files.metric_rows(flat, [F.col("`inputs/user_id`").alias("user_id"), "step"], "inputs/value", "outputs/total")


@query("""SELECT page_id, CASE WHEN regexp_full_match(url, 'https?://m\\..*') THEN page_id % 50 <= 10 WHEN regexp_full_match(url, 'https://.*') THEN page_id % 50 <= 30 ELSE false END AS stale FROM pages""")
def stale_cache(spark, sf_dir):
    modified = F.timestamp_add("DAY", (F.col("page_id") % 50).cast("int"), F.lit(datetime(2024, 1, 1)))
    rules = {r"https?://m\.": datetime(2024, 1, 11), "https://": datetime(2024, 1, 31)}
    return table(spark, sf_dir, "pages").select("page_id", files.stale(F.col("url"), modified, rules).alias("stale"))


@query("SELECT vec_id, unnest(range(64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings")
def wire_roundtrip(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select("vec_id", codec.encoded(F.col("embedding")).alias("w"))
    return packed.select("vec_id", F.posexplode(codec.decoded(F.col("w"))).alias("dim", "x"))


@query("""WITH p AS (SELECT vec_id, [floor(255 * greatest(0, least(1, v::DOUBLE + 0.5)))::INTEGER FOR v IN embedding] AS p FROM embeddings), i AS (SELECT range AS i FROM range(64))
SELECT vec_id, i::INTEGER AS i, p[(15 - i // 4) * 4 + (3 - i % 4) + 1] AS v FROM p, i""")
def image_views(spark, sf_dir):
    """4 x 4 pictures of a vector in four channels, turned by half a turn, their channels reversed: every byte."""
    samples = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") + 0.5)))
    turned = images.flipped_channels(images.turned(images.to_uint8(samples, 4, 4, 4)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", turned.alias("image")).select("vec_id", F.hex("image.data").alias("h"))
    cells = rows.select("vec_id", "h", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return cells.select("vec_id", "i", F.conv(F.substring("h", F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("v"))


@query(f"WITH {STEPS} SELECT user_id, step, value AS infer_ms, lag(value) OVER (PARTITION BY user_id ORDER BY step) AS prev_total_ms FROM s")
def server_timing(spark, sf_dir):
    s = E.with_previous(steps(spark, sf_dir), "user_id", "step", "value", "prev_total_ms")
    return s.select("user_id", "step", F.col("value").alias("infer_ms"), "prev_total_ms")


@query("SELECT o_orderkey, q, k, (q // 3) >= (k // 4) AS seen FROM (SELECT o_orderkey, o_orderkey % 24 AS q, o_custkey % 24 AS k FROM orders)")
def block_masks(spark, sf_dir):
    both = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 24).alias("q"), (F.col("o_custkey") % 24).alias("k"))
    return both.select("o_orderkey", "q", "k", encodings.block_mask(F.col("q"), F.col("k"), 4, 3).alias("seen"))


@query("""WITH c AS (SELECT vec_id, label % 2 = 0 AS second, vec_id % 5 AS n FROM embeddings)
SELECT vec_id, range::INTEGER AS place, CASE WHEN range < 4 OR range >= 12 THEN true WHEN range < 8 THEN second ELSE range - 8 < n END AS valid, (range IN (12, 13))::INTEGER AS ar FROM c, range(16)""")
def prefix_masks(spark, sf_dir):
    """Two images of four patches, the second one at times missing, up to three prompt tokens of four, a state token, three actions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit(True), F.col("label") % 2 == 0).alias("m"), (F.col("vec_id") % 5).cast("int").alias("n"))
    prompt = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("n"))
    masks = rows.select("vec_id", arrays.model_masks(F.col("m"), 4, prompt, 3, True).alias("v"))
    return masks.select("vec_id", F.posexplode(F.arrays_zip("v.valid", "v.ar")).alias("place", "z")).select("vec_id", "place", "z.valid", "z.ar")


@query("""WITH d AS (SELECT vec_id, label, unnest(embedding[1:21])::DOUBLE AS x, unnest(embedding[22:42])::DOUBLE AS y, unnest(embedding[43:63])::DOUBLE AS g FROM embeddings)
SELECT vec_id, round(sum(CASE WHEN label % 4 = 0 THEN x ELSE x + y * (CASE WHEN label % 3 = 0 THEN 1 ELSE g END) END), 6) AS total FROM d GROUP BY vec_id""")
def gated_sums(spark, sf_dir):
    cut = lambda i: F.transform(F.slice("embedding", i, 21), lambda v: v.cast("double"))
    gate = F.transform(cut(43), lambda v: F.when(F.col("label") % 3 != 0, v))
    out = arrays.gated_residual(cut(1), F.when(F.col("label") % 4 != 0, cut(22)), gate)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("""WITH r AS (SELECT vec_id, i, vec_id % 40 * exp(-2 * i * ln(10000.0) / 8) AS t FROM embeddings, (SELECT unnest(range(4)) AS i))
SELECT vec_id, (2 * i)::INTEGER AS dim, round(sin(t), 6) AS v FROM r UNION ALL SELECT vec_id, (2 * i + 1)::INTEGER, round(cos(t), 6) FROM r""")
def log_spaced_positions(spark, sf_dir):
    v = encodings.log_spaced(F.col("vec_id") % 40, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type NOT LIKE '%view%'")
def dropped_columns(spark, sf_dir):
    """Camera views whose name holds a word are left out, and so are columns of text."""
    views = trajectories.cameras(F.create_map("event_type", "event_id"), ["view"])
    rows = table(spark, sf_dir, "events").withColumn("left", views).where(F.size("left") > 0).drop("ts", "left")
    return reshape.without_strings(rows)


@query("""WITH n AS (SELECT DISTINCT source AS name FROM documents), w AS (SELECT name, lead(name) OVER (ORDER BY name) AS after FROM n) SELECT name, after FROM w WHERE starts_with(after, name)""")
def nested_names(spark, sf_dir):
    """Names that begin the next one in order: leaves that would alias a node."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    after = F.lead("name").over(Window.orderBy("name"))  # over the names of a schema, which are few
    return names.select("name", after.alias("after")).where(F.startswith("after", F.col("name")))


@query("SELECT coalesce(c_custkey, o_custkey) AS key, count(o_orderkey) AS orders FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def full_outer_orders(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    both = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full")
    return both.groupBy(F.coalesce("c_custkey", "o_custkey").alias("key")).agg(F.count("o_orderkey").alias("orders"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def theta_nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    return a.join(b, (F.col("ra") < F.col("rb")) & (F.col("a") > F.col("b"))).select("a", "b")


@query("SELECT p_brand, approx_count_distinct(p_type) > 0 AS some, count(DISTINCT p_type) AS kinds, round(avg(p_retailprice) FILTER (p_size > 25), 4) AS large FROM part GROUP BY p_brand")
def brand_kinds(spark, sf_dir):
    large = F.avg(F.when(F.col("p_size") > 25, F.col("p_retailprice")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg((F.approx_count_distinct("p_type") > 0).alias("some"), F.countDistinct("p_type").alias("kinds"), F.round(large, 4).alias("large"))
