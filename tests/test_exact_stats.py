"""Exact quantiles whose groups are spread over many tasks."""

from __future__ import annotations

import numpy as np

from kinelake.operators import statistics


def test_quantiles_of_a_hot_group_hold_no_group_in_one_task(spark):
    rng = np.random.default_rng(0)
    kinds = {"hot": rng.normal(0, 1, 3000), "ties": rng.integers(0, 3, 50).astype(float), "one": np.array([5.0]), None: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in kinds.items() for x in v] + [("hot", None), ("none", None)], "k string, x double")
    out = statistics.exact_stats(df, ["k"], (0.25, 0.5, 0.99), 16)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: r for r in out.collect()}
    assert set(got) == {*kinds, "none"} and got["none"].n == 0 and got["none"].p50 is None
    for k, v in kinds.items():
        assert got[k].n == len(v) and np.allclose([got[k].p25, got[k].p50, got[k].p99], np.quantile(v, (0.25, 0.5, 0.99)), atol=1e-12)
