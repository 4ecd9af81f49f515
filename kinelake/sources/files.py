"""Files of the trajectory pipeline: episode tables, JSON side files, records, metrics, checkpoints."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = "map<string, array<array<int>>>"
STATS = "struct<mean:array<double>,std:array<double>,q01:array<double>,q99:array<double>>"


def read_steps(spark: SparkSession, path: str, schema: T.StructType | None = None, skip_corrupt: bool = False) -> DataFrame:
    """An episode dataset; partition folders such as episode_index=3 become columns, and filters on them prune files.

    skip_corrupt leaves out files that can't be read; else one of them ends the job.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_dataset_info(spark: SparkSession, folder: str) -> tuple[float, dict[int, str]]:
    """A dataset's frames a second and its tasks by index, from meta/info.json and meta/tasks.jsonl (a row for each task)."""
    base = f"{folder.rstrip('/')}/meta"
    fps = spark.read.schema("fps double").json(f"{base}/info.json", multiLine=True).first().fps
    rows = spark.read.schema("task_index int, task string").json(f"{base}/tasks.jsonl").collect()
    return fps, {r.task_index: r.task for r in rows}


def window_steps(seconds: Iterable[float], fps: float, tolerance: float = 1e-4) -> list[int]:
    """Offsets in time as offsets in frames; fails for one that lies on no frame."""
    out = []
    for s in seconds:
        k = round(s * fps)
        if abs(k / fps - s) > tolerance:
            raise ValueError(f"{s} s is no multiple of a frame at {fps} a second")
        out.append(k)
    return out


def probed(schema: T.StructType) -> tuple[list[str], bool, bool]:
    """An episode file's cameras without depth ones, and whether it has velocity and effort."""
    inner = lambda s, name: next((f.dataType for f in s.fields if f.name == name and isinstance(f.dataType, T.StructType)), T.StructType([]))
    seen = inner(schema, "observations")
    return [n for n in inner(seen, "images").names if "depth" not in n], "qvel" in seen.names, "effort" in seen.names


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, after what is there."""
    df.write.mode("append").json(path)


def write_steps(df: DataFrame, path: str, episode: str = "episode_index", step: str = "frame_index", episodes_per_file: int = 64) -> None:
    """An episode dataset in place of what is there; an episode's steps are in order in one file."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.floor(F.col(episode) / episodes_per_file).alias("chunk")
    df.select("*", group).repartition(n, "chunk").sortWithinPartitions(episode, step).write.mode("overwrite").partitionBy("chunk").parquet(path)


def find_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, modified and size of the files under folder whose names match a glob, at any depth; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(episode, start, end) from JSON {episode: [[start, end), ...]}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", RANGES).alias("m"))
    each = whole.select(F.explode("m").alias("episode", "ranges")).select("episode", F.explode("ranges").alias("r"))
    return each.select("episode", F.get("r", F.lit(0)).alias("start"), F.get("r", F.lit(1)).alias("end"))


#: Steps whose ranges stand in one line at most, so that no line grows with its episode.
LINE_STEPS = 1 << 20


def range_lines(ranges: DataFrame) -> DataFrame:
    """Ranges (episode, start, end) as JSON texts (value) of one episode each; a long one has several."""
    rows = ranges.groupBy("episode", F.floor(F.col("start") / LINE_STEPS)).agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("ranges"))
    return rows.select(F.to_json(F.create_map(F.col("episode").cast("string"), "ranges")).alias("value"))


def write_ranges(ranges: DataFrame, path: str) -> None:
    """Ranges as JSON lines, which read_range_lines reads, after what is there."""
    range_lines(ranges).write.mode("append").text(path)


def read_range_lines(spark: SparkSession, path: str) -> DataFrame:
    return ranges_of(spark.read.text(path))


def ranges_of(lines: DataFrame) -> DataFrame:
    """The inverse of range_lines."""
    each = lines.select(F.explode(F.from_json("value", RANGES)).alias("episode", "ranges")).select("episode", F.explode("ranges").alias("r"))
    return each.select("episode", F.get("r", F.lit(0)).alias("start"), F.get("r", F.lit(1)).alias("end"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(episode, note) from JSON {episode: text}."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("episode", "note"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written under another name and then moved over what is there, on any store that Spark reaches."""
    system, final = _file_system(spark, path)
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.partial")
    out = system.create(held, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(held, final, options)


def write_norm_stats(spark: SparkSession, folder: str, stats: DataFrame) -> None:
    """stats (key, mean, std, q01, q99: arrays; a few rows) as folder/norm_stats.json."""
    named = {r.key: {k: list(r[k]) for k in ("mean", "std", "q01", "q99") if r[k] is not None} for r in stats.collect()}
    write_text(spark, f"{folder.rstrip('/')}/norm_stats.json", json.dumps({"norm_stats": named}, indent=2))


def read_norm_stats(spark: SparkSession, folder: str) -> DataFrame:
    """(key, mean, std, q01, q99); a missing file raises FileNotFoundError."""
    path = f"{folder.rstrip('/')}/norm_stats.json"
    system, p = _file_system(spark, path)
    if not system.exists(p):
        raise FileNotFoundError(path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<norm_stats:map<string,{STATS}>>").alias("j"))
    return whole.select(F.explode("j.norm_stats").alias("key", "s")).select("key", "s.*")


def fake_steps(spark: SparkSession, rows: int, floats: Mapping[str, int], ints: Mapping[str, int] | None = None, seed: int = 0) -> DataFrame:
    """rows rows of random vectors: floats in [-1, 1), ints in [0, 2048), of the sizes given; a row depends on the seed and its place."""

    def unit(place: str, i: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(place), F.lit(i), F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)

    own = [F.array(*[(unit(k, i) * 2 - 1).cast("float") for i in range(n)]).alias(k) for k, n in floats.items()]
    own += [F.array(*[F.floor(unit(k, i) * 2048).cast("int") for i in range(n)]).alias(k) for k, n in (ints or {}).items()]
    return spark.range(rows).select("id", *own)


def ones(sizes: Mapping[str, int]) -> list[Column]:
    return [F.array_repeat(F.lit(1.0), n).alias(k) for k, n in sizes.items()]


def equal_lengths(df: DataFrame, *arrays: str) -> DataFrame:
    """df with length, the arrays' own; fails for a row whose arrays differ in it."""
    first = F.size(arrays[0])
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.size(a) == first)
    return df.withColumn("length", F.when(same, first).otherwise(F.raise_error(F.lit("arrays of different lengths"))))


def frames_of(episodes: DataFrame, *arrays: str) -> DataFrame:
    """One row for each step of episodes that hold a step's values at one place of each array."""
    rest = [c for c in episodes.columns if c not in arrays]
    each = episodes.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("step", "_v"))
    return each.select(*rest, "step", *[F.col(f"_v.{a}").alias(a) for a in arrays])


def recorded(df: DataFrame, inputs: Iterable[str], outputs: Iterable[str]) -> DataFrame:
    """A policy's records: flat columns inputs/... and outputs/...."""
    return df.select("step", *[F.col(c).alias(f"inputs/{c}") for c in inputs], *[F.col(c).alias(f"outputs/{c}") for c in outputs])


def by_axis(records: DataFrame, column: str) -> DataFrame:
    """Recorded vectors as (step, axis, value)."""
    return records.select("step", F.posexplode(F.col(f"`{column}`")).alias("axis", "value"))


def metric_rows(df: DataFrame, keys: Iterable[Column | str], *metrics: str) -> DataFrame:
    """keys, name, value: a row for each metric of a row that isn't null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])).alias("_m")
    return df.select(*keys, pairs).select("*", "_m.name", "_m.value").drop("_m").where("value IS NOT NULL")


def append_metrics(df: DataFrame, path: str, run_id: str, step: str, *metrics: str) -> None:
    """(run_id, step, name, value) rows at the end of a metrics table."""
    metric_rows(df, [F.lit(run_id).alias("run_id"), step], *metrics).write.mode("append").parquet(path)


def write_eval(df: DataFrame, path: str) -> None:
    df.select("success", "duration", "video_filename").write.mode("overwrite").csv(path, header=True)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="success double, duration int, video_filename string")


def stale(path: Column, modified: Column, rules: Mapping[str, datetime]) -> Column:
    """Whether a cached file is out of date: the first rule whose pattern matches its path has a time no earlier than its own."""
    out = F.lit(False)
    for pattern, expiry in reversed(list(rules.items())):
        out = F.when(path.rlike(f"^(?:{pattern})"), modified <= F.lit(expiry)).otherwise(out)
    return out


def next_index(names: DataFrame, name: str, pattern: str = r"out_(\d+)\.") -> DataFrame:
    """One more than the greatest number in the names of earlier outputs; 0 if there are none."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(name, pattern, 1).try_cast("int")), F.lit(-1)) + 1).alias("next"))


def valid_name(name: str) -> bool:
    return re.fullmatch(r"[\w.-]+", name) is not None
