"""Named sources of episodes, as Spark data sources with a schema, partitions and pushed filters.

`register(spark)` makes three formats known to `spark.read.format(...)`:

- `episode_records`: folders of framed record files (see `records`), split by bytes;
- `episode_parquet`: folders of parquet files, a partition for each run of row groups;
- `episode_fake`: random steps without files, for tests of whatever follows.

A file that says in its name which episodes it holds (`...-e<first>-<last>.<ext>`, as both writers name theirs) is not opened
when a filter on the episode column rules it out; parquet row groups are ruled out by their statistics too. All filters are
checked again by Spark, so a wrong name could hide rows, but no row that fails a filter ever shows. What is left open shows
as the scan's partitions.

`SOURCES` names datasets: which format, and which columns take part. `open_source` reads one.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from . import records

SPLIT_BYTES, BATCH_ROWS = 128 << 20, 1024
_RANGE = re.compile(r"-e(-?\d+)-(-?\d+)\.\w+$")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
    return system, name


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(name, size) of a file, or of a folder's files of a suffix at any depth, in order; hidden ones are left out."""
    system, name = _place(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    own = lambda p: not any(part[:1] in "._" for part in p[len(name) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path == name or f.path.endswith(suffix) and own(f.path)))


@dataclass
class Interval:
    """Which values of one column the filters leave: bounds (None: open) and, where there's a list, the values."""

    low: float | None = None
    high: float | None = None
    values: frozenset | None = None

    def within(self, low: float | None = None, high: float | None = None, values: Iterable | None = None) -> Interval:
        own = frozenset(v for v in values if v is not None) if values is not None else None
        return Interval(
            max((x for x in (self.low, low) if x is not None), default=None), min((x for x in (self.high, high) if x is not None), default=None),
            self.values if own is None else own if self.values is None else self.values & own,
        )

    def meets(self, first, last) -> bool:
        """Whether any value left lies in [first, last]."""
        low, high = first if self.low is None else max(first, self.low), last if self.high is None else min(last, self.high)
        return low <= high and (self.values is None or any(low <= v <= high for v in self.values))


def interval_of(filters: Sequence[D.Filter], column: str) -> Interval:
    out = Interval()
    for f in filters:
        if tuple(getattr(f, "attribute", ())) != (column,):
            continue
        if isinstance(f, (D.EqualTo, D.EqualNullSafe)):
            out = out.within(values=[f.value])
        elif isinstance(f, D.In):
            out = out.within(values=f.value)
        elif isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
            out = out.within(low=f.value)
        elif isinstance(f, (D.LessThan, D.LessThanOrEqual)):
            out = out.within(high=f.value)
    return out


@dataclass
class Split(D.InputPartition):
    path: str
    lo: int
    hi: int
    size: int


class FolderReader(D.DataSourceReader):
    """Files of a folder, of which those whose names rule a filter on the episode column out are never opened."""

    suffix = ""

    def __init__(self, path: str, schema: T.StructType, options: Mapping[str, str]):
        self.path, self.columns = path, schema
        self.episode = options.get("episode", "episode")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.skip = options.get("corrupt", "fail") == "skip"
        self.left = Interval()

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        if any(f.name == self.episode and isinstance(f.dataType, T.NumericType) for f in self.columns.fields):
            self.left = interval_of(filters, self.episode)
        return filters  # names rule files out, not rows

    def files(self) -> list[tuple[str, int]]:
        out = []
        for name, size in list_files(self.path, self.suffix):
            said = _RANGE.search(name)
            if said is None or self.left.meets(int(said[1]), int(said[2])):
                out.append((name, size))
        return out

    def _stream(self, path: str):
        return _place(self.path)[0].open_input_file(path)


class RecordReader(FolderReader):
    suffix = ".rec"

    def partitions(self) -> Sequence[Split]:
        return [Split(p, lo, min(lo + self.split, size), size) for p, size in self.files() for lo in range(0, size, self.split)]

    def read(self, part: Split | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's stand-in where no file is left
            return
        with self._stream(part.path) as stream:
            for bodies in records.read_records(stream, part.size, part.lo, part.hi, self.skip):
                for lo in range(0, len(bodies), BATCH_ROWS):
                    yield records.decode(bodies[lo : lo + BATCH_ROWS], self.columns)


class ParquetReader(FolderReader):
    suffix = ".parquet"

    def partitions(self) -> Sequence[Split]:
        """Row groups lo to hi of each file, so many that they make about splitBytes."""
        import pyarrow.parquet as pq

        out = []
        for path, size in self.files():
            with self._stream(path) as stream:
                groups = pq.ParquetFile(stream).metadata.num_row_groups
            step = max(1, groups * self.split // max(size, 1))
            out += [Split(path, lo, min(lo + step, groups), size) for lo in range(0, groups, step)]
        return out

    def read(self, part: Split | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        import pyarrow.parquet as pq

        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.columns)
        with self._stream(part.path) as stream:
            file = pq.ParquetFile(stream)
            names = [f.path for f in file.schema]
            at = names.index(self.episode) if self.episode in names else None
            for g in range(part.lo, part.hi):
                stats = file.metadata.row_group(g).column(at).statistics if at is not None else None
                if stats is not None and stats.has_min_max and not self.left.meets(stats.min, stats.max):
                    continue
                for batch in file.iter_batches(BATCH_ROWS, row_groups=[g], columns=list(want.names)):
                    yield batch.select(want.names).cast(want)


class FakeReader(D.DataSourceReader):
    """rows random rows: floats in [-1, 1), integers in [0, 2048); a row depends on the seed and its place alone."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.columns, self.rows, self.seed = schema, int(options.get("rows", 1024)), int(options.get("seed", 0))
        self.size, self.parts = int(options.get("size", 8)), int(options.get("partitions", 4))

    def partitions(self) -> Sequence[Split]:
        edges = [self.rows * i // self.parts for i in range(self.parts + 1)]
        return [Split("", lo, hi, self.rows) for lo, hi in zip(edges, edges[1:]) if hi > lo]

    def read(self, part: Split | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.columns)
        for lo in range(part.lo, part.hi, BATCH_ROWS):
            n = min(lo + BATCH_ROWS, part.hi) - lo
            columns = []
            for k, f in enumerate(self.columns.fields):
                array = isinstance(f.dataType, T.ArrayType)
                draws = [np.random.Generator(np.random.Philox(key=[self.seed, k << 40 | row])).random(self.size if array else 1) for row in range(lo, lo + n)]
                kind = records.kind_of(f.dataType)
                own = np.concatenate(draws)
                values = pa.array(own * 2 - 1) if kind == records.FLOATS else pa.array((own * 2048).astype(np.int64))
                values = values.cast(want.field(k).type.value_type if array else want.field(k).type)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.size), values, type=want.field(k).type) if array else values)
            yield pa.RecordBatch.from_arrays(columns, schema=want)


@dataclass
class Written(D.WriterCommitMessage):
    held: str
    name: str


class RecordWriter(D.DataSourceArrowWriter):
    """A file for each task, hidden until all have ended; the name says which episodes it holds."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, options: Mapping[str, str]):
        self.path, self.columns, self.overwrite, self.run = path, schema, overwrite, uuid.uuid4().hex[:12]
        self.episode = options.get("episode", "episode")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written | None:
        from pyspark import TaskContext

        system, folder = _place(self.path)
        low = high = None
        context, out, held = TaskContext.get(), None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(folder, recursive=True)
                held = f"{folder}/.{self.run}-{context.partitionId():05d}-{context.taskAttemptId()}"
                out = system.open_output_stream(held)
            out.write(records.frame([records.encode(row, self.columns) for row in batch.to_pylist()]))
            if self.episode in batch.schema.names and pa.types.is_integer(batch.schema.field(self.episode).type):
                own = [v for v in batch.column(self.episode).to_pylist() if v is not None]
                low, high = min([*own, *([] if low is None else [low])], default=None), max([*own, *([] if high is None else [high])], default=None)
        if out is None:
            return None
        out.close()
        said = "" if low is None else f"-e{low}-{high}"
        return Written(held, f"{folder}/part-{context.partitionId():05d}-{self.run}{said}.rec")

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        old = [p for p, _ in list_files(self.path, ".rec")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(m.held, m.name)
        for p in old:
            system.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _place(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.held)


class EpisodeRecords(D.DataSource):
    """Options: path, episode (a column), splitBytes, corrupt (fail or skip). Without a schema the first record's features are the columns."""

    @classmethod
    def name(cls) -> str:
        return "episode_records"

    def schema(self) -> T.StructType:
        for path, size in list_files(self.options["path"], RecordReader.suffix):
            with _place(self.options["path"])[0].open_input_file(path) as stream:
                for bodies in records.read_records(stream, size, 0, size, self.options.get("corrupt") == "skip", 1 << 16):
                    if bodies:
                        return records.probed(bodies[0])
        raise FileNotFoundError(f"{self.options['path']} has no records; give a schema")

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(self.options["path"], schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, overwrite, dict(self.options))


class EpisodeParquet(D.DataSource):
    """Options: path, episode (a column), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "episode_parquet"

    def schema(self) -> T.StructType:
        import pyarrow.parquet as pq

        from pyspark.sql.pandas.types import from_arrow_schema

        for path, _ in list_files(self.options["path"], ParquetReader.suffix):
            with _place(self.options["path"])[0].open_input_file(path) as stream:
                return from_arrow_schema(pq.read_schema(stream))
        raise FileNotFoundError(f"{self.options['path']} has no files; give a schema")

    def reader(self, schema: T.StructType) -> ParquetReader:
        return ParquetReader(self.options["path"], schema, dict(self.options))


class EpisodeFake(D.DataSource):
    """Options: rows, size (of an array), seed, partitions."""

    @classmethod
    def name(cls) -> str:
        return "episode_fake"

    def schema(self) -> str:
        return "state array<float>, actions array<float>"

    def reader(self, schema: T.StructType) -> FakeReader:
        return FakeReader(schema, dict(self.options))


FORMATS = (EpisodeRecords, EpisodeParquet, EpisodeFake)


@dataclass(frozen=True)
class Source:
    """A named dataset: its format, the columns that are read (None: all there are), the episode column, and options."""

    format: str
    schema: str | None = None
    episode: str = "episode"
    options: Mapping[str, str] = field(default_factory=dict)


_STEP = "episode_index long, frame_index long, task_index long"
SOURCES: dict[str, Source] = {
    "two_arm": Source("episode_parquet", f"{_STEP}, state array<float>, actions array<float>", "episode_index"),
    "table_arm": Source("episode_parquet", f"{_STEP}, state array<float>, actions array<float>", "episode_index"),
    "field_arm": Source("episode_records", "episode long, joint_position array<float>, gripper_position array<float>, actions array<float>, prompt array<string>"),
    "fake": Source("episode_fake"),
}


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session; filters reach them from then on."""
    from .. import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in FORMATS:
        spark.dataSource.register(f)


def add_source(name: str, source: Source) -> None:
    """A further name; one that is taken stays what it is."""
    if SOURCES.get(name, source) != source:
        raise ValueError(f"'{name}' is taken")
    SOURCES[name] = source


def open_source(spark: SparkSession, name: str, path: str | None = None, **options) -> DataFrame:
    """The named dataset at path. options: schema, and whatever the format takes."""
    if name not in SOURCES:
        raise ValueError(f"no source '{name}'; there are {', '.join(sorted(SOURCES))}")
    register(spark)
    source = replace(SOURCES[name], schema=options.pop("schema", SOURCES[name].schema))
    reader = spark.read.format(source.format).options(episode=source.episode, **source.options, **{k: str(v) for k, v in options.items()})
    reader = reader.schema(source.schema) if source.schema else reader
    return reader.load(path) if path else reader.load()


def write_records(df: DataFrame, path: str, episode: str = "episode", files: int | None = None, mode: str = "append") -> None:
    """df as record files that each hold a range of episodes; null episodes, if any, in files without a range."""
    register(df.sparkSession)
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, episode).write.format("episode_records").option("episode", episode).mode(mode).save(path)
