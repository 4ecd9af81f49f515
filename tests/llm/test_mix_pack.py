"""Mixing and packing against plain Python, and the pipeline against its stages done one by one."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from kinelake.llm import mixing, packing
from kinelake.llm.queries import QUERIES

from .test_neardup import brute

SIZES = sorted(packing.CAPACITIES)


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1


def check_bins(rows):
    """Pieces fill each bin without gap or overlap, in the least size that holds them."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append((r.bin_offset, r.length, r.capacity))
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for offset, length, _ in sorted(b):
            assert offset == at
            at += length
        assert {c for *_, c in b} == {min(s for s in SIZES if s >= at)}
    return bins


def check_pieces(rows, want):
    """want: doc_id -> tokens of its rows."""
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length))
    assert set(got) == set(want)
    for d, sizes in want.items():
        plain = Counter((i, i * 4096, min(4096, n - i * 4096)) for n in sizes for i in range(-(-n // 4096)))
        assert Counter(got[d]) == plain


def test_op5_places_every_piece(spark, sf_dir):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want[r.doc_id].append(tokens(r.text))
    rows = QUERIES["op5_variable_best_fit"](spark, sf_dir).collect()
    check_pieces(rows, want)
    bins = check_bins(rows)
    cost = sum(b[0][2] + packing.OVERHEAD for b in bins.values())
    # plain best fit, a piece at a time, with one size
    for size in SIZES[-2:]:
        rooms, pieces = [], sorted((min(size, n - i) for v in want.values() for n in v for i in range(0, n, size)), reverse=True)
        for n in pieces:
            fits = [i for i, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(size - n)
        assert cost <= len(rooms) * (size + packing.OVERHEAD)


def test_op5_plan_on_large_and_awkward_counts():
    rng = np.random.default_rng(0)
    for counts in (np.zeros(4097, int), np.bincount([4096] * 7 + [1] * 3, minlength=4097), rng.geometric(1e-6, 4097), np.maximum(rng.integers(-3000, 50, 4097), 0)):
        counts[0] = 0
        p = packing.plan(counts)
        filled = np.zeros(p.n_bins, np.int64) if p.n_bins < 3_000_000 else None
        assert sum(p.first_rank[np.flatnonzero(p.length == n)].size > 0 for n in range(1, 4097)) == (counts > 0).sum()
        if filled is None:
            continue
        for n in np.flatnonzero(counts):
            b, offset, capacity = p.place(np.full(counts[n], n), np.arange(counts[n]))
            assert (offset + n <= capacity).all()
            np.add.at(filled, b, n)
        capacity = p.capacity[np.searchsorted(p.start, np.arange(p.n_bins), side="right") - 1] if p.n_bins else filled
        assert (filled <= capacity).all() and (filled > 0).all()


def test_op5_hot_ids_and_nulls(spark):
    rows = [(None, 3)] * 40 + [(7, 3)] * 40 + [(8, 10_000)] * 3 + [(9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, k long").selectExpr("*", "1 as bin", "'a' as length", "2 as _row")
    from pyspark.sql import functions as F

    got = packing.pack(df, F.col("k")).collect()
    check_bins(got)
    check_pieces(got, {None: [3] * 40, 7: [3] * 40, 8: [10_000] * 3, 9: [1]})


def plain_rates(p, n, target):
    """The same descent in numpy, over all rows at once."""
    total = n.sum()
    w = np.linalg.inv((p * n[:, None]).T @ p / total + 1e-6 * np.eye(p.shape[1]))
    eta = 1 / (1 + mixing.RIDGE)
    rate = np.ones(len(n))
    for _ in range(400):
        pull = w @ ((rate[:, None] * p * n[:, None]).sum(0) / total - target)
        rate = np.maximum(0, rate - eta * (p @ pull + mixing.RIDGE * (rate - 1)))
    return rate


def test_op2_meets_targets(spark):
    rows = QUERIES["op2_soft_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    p, n = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in rows]), np.array([r.n_tokens for r in rows], float)
    rate = np.array([r.rate for r in rows])
    target = np.array([0.90, 0.07, 0.03])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.abs((rate[:, None] * p * n[:, None]).sum(0) / n.sum() - target).max() < 0.005
    assert np.abs(rate - plain_rates(p, n, target)).max() < 0.1
    assert abs(sum(r.copies for r in rows) - rate.sum()) < 60
    label = {r.doc_id: 2 if r.toxic else 1 - r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert np.mean([np.argmax(q) == label[r.doc_id] for q, r in zip(p, rows, strict=True) if r.doc_id in label]) > 0.9


def test_op2_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (None, "", 0, None), (3, "x " * 50, 100, "b")], "doc_id long, text string, n_chars long, _copy string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert mixing.resample(df, none, {"a": 1, "b": 1}).count() >= 2
    assert mixing.resample(df.limit(0), none, {"a": 1}).count() == 0
    one = spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, label int")
    assert set(mixing.resample(df, one, {"a": 1, "b": 1}).columns) == set(df.columns)


def test_pipeline_stage_by_stage(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    after = {}
    for name in list(stage)[:-1]:
        before = docs
        docs = stage[name](spark, before, sf_dir).cache()
        after[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = QUERIES["op1_quality_fm"](spark, sf_dir).collect()
    assert {r.doc_id for r in after["quality"]} == {r.doc_id for r in first if r.predicted == 1}
    kept = [r for r in after["quality"] if r.doc_id in label]
    assert np.mean([label[r.doc_id].quality for r in kept]) > 0.95
    assert sum(label[r.doc_id].toxic for r in after["toxicity"] if r.doc_id in label) <= sum(label[r.doc_id].toxic for r in kept)
    classes = brute([(r.doc_id, r.text) for r in after["toxicity"]])
    assert sorted(r.doc_id for r in after["near_copies"]) == sorted({c for _, c in classes})
    mixed = Counter(r.doc_id for r in after["mixing"])
    assert set(mixed) <= {r.doc_id for r in after["near_copies"]} and len(mixed) > 0.9 * len(after["near_copies"])
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    want = defaultdict(list)
    for r in after["mixing"]:
        want[r.doc_id].append(tokens(r.text))
    check_pieces(packed, want)
    check_bins(packed)


@pytest.mark.parametrize("rows", [0, 2])
def test_pipeline_on_hardly_anything(spark, tmp_path, rows):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(rows).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_columns_of_the_same_names_stay(spark):
    from kinelake.llm import neardup, quality

    names = ("__x", "_p", "_n", "_copy", "_rate", "class_id", "_kept", "_root", "bin", "length")
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, "other words here", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, n in enumerate(names):
        df = df.selectExpr("*", f"doc_id * 100 + {i} AS `{n}`")
    none = spark.createDataFrame([], "doc_id long, label int")
    for got in (mixing.resample(df, none, {"a": 1}), neardup.keep_one(df)):
        rows = got.collect()
        assert got.columns == df.columns and rows and all(r[n] == r.doc_id * 100 + i for r in rows for i, n in enumerate(names))
    assert neardup.keep_one(df).count() == 2
    assert quality.score_quality(df, quality.train(df, none)).columns == [*df.columns, "quality_score"]
