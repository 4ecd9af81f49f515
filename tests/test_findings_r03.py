"""What the findings of round 3 showed: the larger tables' values, groups and plans."""

from __future__ import annotations

import random
from decimal import Decimal

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinelake import BATCH_ROWS
from kinelake.operators import sketch

#: Python steps that a view goes through.
PASSES = 3


def both(spark, name: str, folder, tables: dict) -> tuple[list, list]:
    """The rows of a query and of its SQL over tables written into folder."""
    con = duckdb.connect()
    for table, df in tables.items():
        path = f"{folder}/{table}.parquet"
        df.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_prompt_bins_beyond_the_range(spark, tmp_path):
    """the query's bins go on beyond [-1, 1); a model's prompt keeps them within."""
    states = [(1, [-0.5176, 0.53, -0.5, 0.5, 0.0, 0.498]), (2, [-0.5, -0.50001, 0.4999, 0.25, -0.25, 0.1])]
    tables = {"embeddings": spark.createDataFrame(states, "vec_id long, embedding array<float>"), "conversations": spark.createDataFrame([(1, 0, " go_on "), (2, 0, "stop")], "conv_id long, turn int, text string")}
    got, want = both(spark, "prompt_template", tmp_path, tables)
    assert got == want and "State: -5 263 0 256" in got[0][2]


def test_exact_quantiles_beyond_a_sketch(spark, tmp_path):
    """a group of more values than the sketch has places, in which a sketch's quantiles are near and not exact."""
    x = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("value")
    user = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 2)
    rows = spark.range(200_000).select("id", user.alias("user_id"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.when(F.col("id") % 7 != 0, x).alias("value"))
    got, want = both(spark, "sketched_statistics", tmp_path, {"events": rows.where("user_id IS NOT NULL")})
    assert got == want and got[0][1] > 4 * 16_384


@pytest.mark.parametrize("k", [8, 256])
def test_exact_quantiles_settle_what_a_sketch_missed(spark, k):
    """brackets of a coarse sketch, heavy ties, a null key, one value alone; places by whole numbers, not floats."""
    data = [(1, float(i * 7919 % 10_007)) for i in range(5000)] + [(None, float(i % 3)) for i in range(900)] + [(2, 4.0)] + [(3, None)] + [(4, float(i)) for i in range(100)]
    values = spark.createDataFrame(data, "key long, x double")
    if k < 16:  # a sketch that tells of other values: every bracket misses
        told = sketch.states(values.withColumn("x", F.col("x") / 1e6 - 9), ["key"], k).select("key", "sketch")
        whole = sketch.states(values, ["key"], k).drop("sketch").alias("w").join(told.alias("t"), F.expr("w.key <=> t.key")).select("w.*", "t.sketch")
    else:
        whole = sketch.states(values, ["key"], k)
    got = {r.key: (r.a, r.b, r.c) for r in sketch.exact_quantiles(values, whole, {"a": 0.01, "b": 0.5, "c": 0.99}, ["key"], k).collect()}
    want = {}
    for key in (1, None, 2, 4):
        own = sorted(v for g, v in data if g == key)
        want[key] = tuple(own[-int(-(Decimal(q) * len(own)) // 1) - 1] for q in ("0.01", "0.5", "0.99"))
    assert got == want


def test_values_are_not_shuffled_by_group(spark, sf_dir):
    """values meet their group's range where they are read, whatever a broadcast may measure."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = __spark_entry__.queries()["norm_stats_columns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(lines) if "Filter isnotnull(x" in line)
    assert "BroadcastHashJoin" in lines[at - 1]


@pytest.mark.parametrize("name", ["two_arm_record", "table_arm_record", "field_arm_record"])
def test_views_are_made_once(spark, sf_dir, name):
    """no filter before the explode runs the pictures' whole chain in workers of its own."""
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    branch = next(part for part in plan.split("Scan parquet") if "explode(image" in part)
    assert branch.count("ArrowEvalPython") == PASSES


def test_picture_batches_are_bounded(spark, sf_dir):
    """a Python worker gets so many rows and bytes of pictures at once, whatever a table holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    __spark_entry__.queries()["field_arm_record"](spark, sf_dir)
    assert int(spark.conf.get(name)) == BATCH_ROWS


def test_token_parts_are_looked_up_by_their_bytes(monkeypatch):
    """op4_packed_ids: parts of every length, in slots that many share and a store that is begun anew; known ones pass no dict."""
    from tokenizers import Tokenizer

    from kinelake.llm import tokenids

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    words = ["x" * n for n in range(1, 40)] + ["".join(rnd.choices("abcé'ü7,世 ", k=rnd.randint(1, 17))) for _ in range(3000)] + ["a\0", "a", "a\0\0", "abcdefgh", "abcdefgh\0"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", ".", ""]) for _ in range(rnd.randint(0, 60))) for _ in range(600)] + ["", "\0"]
    want = [tuple(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for bits, stored in ((2, 50), (20, 1 << 22)):
        monkeypatch.setattr(tokenids, "SLOT_BITS", bits)
        monkeypatch.setattr(tokenids, "STORED_IDS", stored)
        own = tokenids.Encoder(path)
        assert [tuple(ids.tolist()) for t in texts for ids in own.encode([t])] == want
        assert [tuple(ids.tolist()) for ids in own.encode(texts)] == want == [tuple(ids.tolist()) for ids in own.encode(texts)]
    asked, ids_of = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda parts: asked.extend(parts) or ids_of(parts))
    assert [tuple(ids.tolist()) for ids in own.encode(texts)] == want
    assert len([p for p in asked if len(p) <= 15]) < 100  # of thousands: those that share a slot
