"""Nested records: path addressing, renaming, repacking, defaults, lookups and merges, all settled while the plan is made."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "/"


def _quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(SEPARATOR)))


def leaves(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Paths of a schema's leaves, with their types; structs are inner nodes."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out |= leaves(f.dataType, f"{path}{SEPARATOR}") if isinstance(f.dataType, T.StructType) else {path: f.dataType}
    return out


def flatten(df: DataFrame) -> DataFrame:
    """One column for each leaf, named by its path."""
    return df.select(*[_quoted(p).alias(p) for p in leaves(df.schema)])


def _nest(columns: Iterable[tuple[str, Column]]) -> list[Column]:
    """Columns that hold the paths' structs; fails for a path that comes twice, or is a leaf and a node."""
    tree: dict = {}
    for path, c in columns:
        *inner, last = path.split(SEPARATOR)
        node = tree
        for part in inner:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"Key '{path}' lies under a leaf")
        if isinstance(node.get(last), dict):
            raise ValueError(f"Key '{path}' has others under it; none may lie under a leaf")
        if last in node:
            raise ValueError(f"Key '{path}' already exists in output")
        node[last] = c

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return build(tree)


def unflatten(df: DataFrame) -> DataFrame:
    """The inverse of flatten: paths in column names become structs."""
    return df.select(*_nest((c, F.col(f"`{c}`")) for c in df.columns))


def repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """A new record from paths of the old, to leaves or whole structs: structure's leaves name them; what it doesn't name is dropped."""
    known = set(leaves(df.schema))
    known |= {"/".join(p.split(SEPARATOR)[:k]) for p in known for k in range(1, p.count(SEPARATOR) + 1)}

    def build(node: Mapping) -> list[Column]:
        out = []
        for k, v in node.items():
            if isinstance(v, str) and v not in known:
                raise KeyError(v)
            out.append((_quoted(v) if isinstance(v, str) else F.struct(*build(v))).alias(k))
        return out

    return df.select(*build(structure))


def rename(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Leaves whose whole path matches a pattern get the path it maps to, or go where that is None; the first match holds."""

    def target(path: str) -> str | None:
        hits = ((re.fullmatch(pattern, path), to) for pattern, to in patterns.items())
        hit, to = next(((h, to) for h, to in hits if h), (None, path))
        return hit.expand(to) if hit and to is not None else to

    moved = [(target(path), _quoted(path)) for path in leaves(df.schema)]
    return df.select(*_nest([(path, c) for path, c in moved if path is not None]))


def apply_leaves(df: DataFrame, functions: Mapping[str, Callable[[Column], Column]], strict: bool = False) -> DataFrame:
    """Leaves under a path of functions go through its function; strict fails for paths that aren't there."""
    known = leaves(df.schema)
    if strict and (gone := set(functions) - set(known)):
        raise ValueError(f"not found: {sorted(gone)}")
    return df.select(*_nest((p, functions[p](_quoted(p)) if p in functions else _quoted(p)) for p in known))


def select_paths(df: DataFrame, pattern: str) -> list[str]:
    """Paths that a pattern matches whole."""
    return [p for p in leaves(df.schema) if re.fullmatch(pattern, p)]


def without_strings(df: DataFrame) -> DataFrame:
    return df.select(*[c for c, t in zip(df.columns, df.schema.fields, strict=True) if not isinstance(t.dataType, T.StringType)])


def without_depth(images: Column) -> Column:
    """An image map without depth cameras."""
    return F.map_filter(images, lambda k, _: ~F.contains(k, F.lit("depth")))


def require(df: DataFrame, needed: set[str], allowed: set[str] | None = None) -> DataFrame:
    """Fails for paths that are missing or, with allowed, not expected."""
    known = set(leaves(df.schema))
    if gone := needed - known:
        raise ValueError(f"missing: {sorted(gone)}")
    if allowed is not None and (odd := known - allowed):
        raise ValueError(f"unexpected: {sorted(odd)}")
    return df


def with_default_prompt(df: DataFrame, prompt: str | None, column: str = "prompt") -> DataFrame:
    """The prompt where there is none."""
    if prompt is None:
        return df
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(prompt)) if column in df.columns else F.lit(prompt))


def with_task_prompt(df: DataFrame, tasks: Mapping[int, str], index: str = "task_index", column: str = "prompt") -> DataFrame:
    """The prompt of the row's task; fails for a row whose task isn't known. tasks is part of the plan, so keep it to a few thousand."""
    if index not in df.columns:
        raise ValueError(f'missing "{index}"')
    lookup = F.create_map(*[F.lit(x) for k, v in tasks.items() for x in (k, v)])
    found = lookup[F.col(index)]
    return df.withColumn(column, F.when(found.isNull(), F.raise_error(F.concat(F.lit("task_index="), F.col(index).cast("string"), F.lit(" not found in task mapping")))).otherwise(found))


def with_language(df: DataFrame, notes: DataFrame, key: str, column: str, default: str = "Do something") -> DataFrame:
    """df with column of notes by key, or the default."""
    return df.join(notes.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def merge_leaves(loaded: DataFrame, reference: DataFrame, pattern: str) -> DataFrame:
    """(path, value, origin): loaded's values of reference's paths, cast as there; of the rest those that the pattern matches."""
    r = reference.select("path", F.col("value").alias("_own"))
    both = r.join(loaded.select("path", F.col("value").cast(reference.schema["value"].dataType).alias("_loaded")), "path", "left")
    fills = F.col("path").rlike(f"^(?:{pattern})$")
    return both.where(F.col("_loaded").isNotNull() | fills).select("path", F.coalesce("_loaded", "_own").alias("value"), F.when(F.col("_loaded").isNotNull(), "loaded").otherwise("reference").alias("origin"))


def schema_difference(a: T.StructType, b: T.StructType) -> dict[str, tuple[str | None, str | None]]:
    """Paths on which two schemas differ, with both types."""
    x, y = leaves(a), leaves(b)
    return {p: (x[p].simpleString() if p in x else None, y[p].simpleString() if p in y else None) for p in sorted(x.keys() | y.keys()) if x.get(p) != y.get(p)}


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(key), key, "left_anti")
