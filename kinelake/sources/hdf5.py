"""Episode logs in HDF5: one file an episode, its leaves as arrays by path. Needs h5py, which is optional."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_episodes(spark: SparkSession, folder: str, leaves: Sequence[str], pattern: str = "*.h5", optional: Sequence[str] = ()) -> DataFrame:
    """(path, step, one array<double> column for each leaf) of every file under folder; leaves are paths such as observations/qpos.

    Missing optional leaves are null; all others must have equally many steps. Files are dealt out by Spark; a task holds one at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    names = [p.strip("/").replace("/", "_") for p in [*leaves, *optional]]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    got = {n: f[p][()] if p in f else None for n, p in zip(names, [*leaves, *optional], strict=True)}
                    if len(sizes := {len(v) for v in got.values() if v is not None}) != 1:
                        raise ValueError(f"{path}: leaves of {sorted(sizes)} steps")
                    n = sizes.pop()
                    cols = {k: [None] * n if v is None else [x.astype(float).ravel() for x in v] for k, v in got.items()}
                    yield pd.DataFrame({"path": path, "step": range(n)} | cols)

    schema = "path string, step int" + "".join(f", `{n}` array<double>" for n in names)
    return files.mapInPandas(read, schema)
