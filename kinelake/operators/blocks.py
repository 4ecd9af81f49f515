"""Windows over episodes that are cut into blocks, so that an episode of any length is many tasks.

A window by episode alone runs each episode in one task. Here rows are dealt by (episode, block): the blocks of an episode
are stretches of its order, each of bounded length. What a row needs of its neighbours crosses the edges in two ways:

- a frame of some rows: rows near an edge are also sent to the next block (a halo), and dropped there after use;
- everything so far: each block has a summary (a sum, a minimum, the last value there was), and the summaries of the blocks
  before it are combined over one row for each block. Open runs meet the same way: a block counts its changes, and the
  changes before it number its runs on.

Two kinds of blocks: `Strided` cuts gapless step numbers every `size` steps by arithmetic, without a look at the data.
`Cuts` cuts any order (such as time): episodes of more than `most` rows get cut points from a quantile sketch, the rest stay
whole; the driver holds the cut points, at most 2 * MOST_CUTS of them.

Rows without an episode are no episode, and stay in one block. All functions give the rows that the windows by episode in
`episodes` and `statistics` give, whatever the size of blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import place_among

SIZE, MOST_CUTS = 1 << 16, 4096
_BLOCK = "_block"


@dataclass(frozen=True)
class Strided:
    """Blocks of size steps; step counts an episode's rows from 0 without gaps."""

    episode: str
    step: str
    size: int = SIZE

    @property
    def order(self) -> str:
        return self.step

    def _at(self, step: Column) -> Column:
        return F.when(F.col(self.episode).isNull(), F.lit(0)).otherwise(F.floor(step / self.size)).cast("long")

    def of(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BLOCK, self._at(F.col(self.step)))

    def with_halo(self, df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Each row also in the blocks whose rows have it among the before rows before them, or the after rows after."""
        step = F.col(self.step)
        reached = F.sequence(F.greatest(self._at(step - after), F.lit(0)), self._at(step + before))
        return df.withColumn(_BLOCK, F.explode(reached)).withColumn("_own", F.col(_BLOCK) == self._at(step))


@dataclass(frozen=True)
class Cuts:
    """Blocks between cut points of (episode, order), which are ascending, and given as texts."""

    episode: str
    order: str
    points: tuple[tuple[str, str], ...]

    def of(self, df: DataFrame) -> DataFrame:
        if not self.points:
            return df.withColumn(_BLOCK, F.lit(0).cast("long"))
        kinds = [df.schema[c].dataType.simpleString() for c in (self.episode, self.order)]
        value = lambda text, kind: f"CAST('{_quoted(text)}' AS {kind})"
        # one text for Spark to read: it becomes one constant of the plan
        points = F.expr("array(" + ", ".join(f"struct({', '.join(map(value, p, kinds))})" for p in self.points) + ")")
        own = place_among(F.struct(self.episode, self.order), points, len(self.points))
        return df.withColumn(_BLOCK, F.coalesce(own, F.lit(0)).cast("long"))


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def cut_points(df: DataFrame, episode: str, order: str, most: int = SIZE) -> Cuts:
    """Cut points for episodes of more than most rows, in blocks of about that many; fewer points where there'd be over MOST_CUTS.

    Rows of one order value stay together. Two aggregates of the two columns, over all rows and over long episodes' rows.
    """
    counts = df.where(F.col(episode).isNotNull()).groupBy(episode).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    most = max(most, -(-total // MOST_CUTS))
    long = counts.where(F.col("_n") > most)  # at most MOST_CUTS of them
    worst = long.agg(F.max("_n")).first()[0]
    if not worst:
        return Cuts(episode, order, ())
    parts = -(-worst // most)
    quantiles = F.percentile_approx(order, [i / parts for i in range(1, parts)], 50 * parts).alias("_q")
    at = df.join(F.broadcast(long), episode).groupBy(episode, "_n").agg(quantiles)
    # of parts points those nearest to an episode's own, smaller number of parts
    own = F.ceil(F.col("_n") / F.lit(most)).cast("int")
    near = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("_q", F.greatest(F.least(F.round(i * parts / own).cast("int"), F.lit(parts - 1)), F.lit(1)) - 1))
    points = at.select(episode, F.explode(F.array_distinct(near)).alias("_p")).orderBy(episode, "_p")  # at most 2 * MOST_CUTS
    return Cuts(episode, order, tuple((r[0], r[1]) for r in points.select(F.col(episode).cast("string"), F.col("_p").cast("string")).collect()))


_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, blocks: Strided | Cuts, values: Mapping[str, tuple[str, Column]], backwards: bool = False, own: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """df with each name of values: the sum, min, max or last (not null) of a column over its episode up to each row.

    backwards: from each row to the episode's end; own=False: without the row itself. ties: columns that order rows of one
    place, ascending in either direction.
    """
    e, o = blocks.episode, blocks.order
    order = F.col(o).desc() if backwards else F.col(o).asc()
    cut = blocks.of(df)
    for k, (_, column) in values.items():
        cut = cut.withColumn(f"_v_{k}", column)
    w = Window.partitionBy(e, _BLOCK).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy(e).orderBy(F.col(_BLOCK).desc() if backwards else F.col(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)

    def total(kind: str, c: Column) -> Column:
        if kind != "last":
            return _KINDS[kind](c)
        pick = F.min_by if backwards else F.max_by
        return pick(c, F.when(c.isNotNull(), F.col(o)))

    over = lambda kind, c, at: (F.last(c, ignorenulls=True) if kind == "last" else _KINDS[kind](c)).over(at)
    sums = cut.groupBy(e, _BLOCK).agg(*[total(kind, F.col(f"_v_{k}")).alias(f"_t_{k}") for k, (kind, _) in values.items()])
    carried = sums.select(F.col(e).alias("_e"), F.col(_BLOCK).alias("_b"), *[over(kind, F.col(f"_t_{k}"), earlier).alias(f"_c_{k}") for k, (kind, _) in values.items()])
    # whole episodes and first blocks carry nothing, so what is joined are the later blocks of long episodes
    carried = carried.where(reduce(lambda a, b: a | b, [F.col(f"_c_{k}").isNotNull() for k in values]))
    out = cut.select("*", *[over(kind, F.col(f"_v_{k}"), w).alias(f"_w_{k}") for k, (kind, _) in values.items()])
    out = out.join(carried, (F.col(e) == F.col("_e")) & (F.col(_BLOCK) == F.col("_b")), "left")
    both = {
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(a, b),
    }
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[both[kind](F.col(f"_w_{k}"), F.col(f"_c_{k}")).alias(k) for k, (kind, _) in values.items()])


def with_step_index(df: DataFrame, cuts: Cuts, name: str = "step") -> DataFrame:
    """The row's place in its episode, from 0: counted in its block, after the rows of the blocks before."""
    return running(df, cuts, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, (F.col(name) - 1).cast("int"))


def with_previous(df: DataFrame, blocks: Strided, value: Column, name: str) -> DataFrame:
    """df with the value of the episode's step before; null for the first."""
    rows = blocks.with_halo(df.withColumn("_v", value), before=1)
    w = Window.partitionBy(blocks.episode, _BLOCK).orderBy(blocks.step)
    return rows.withColumn(name, F.lag("_v").over(w)).where("_own").drop("_v", _BLOCK, "_own")


def with_idle(df: DataFrame, blocks: Strided, vector: Column, threshold: float, name: str = "idle") -> DataFrame:
    """Whether every dimension changed by less than threshold since the step before; an episode's first step isn't idle."""
    rows = with_previous(df.withColumn("_now", vector), blocks, F.col("_now"), "_before")
    still = F.forall(F.zip_with("_now", "_before", lambda a, b: F.abs(a - b) < threshold), lambda x: x)
    return rows.withColumn(name, F.coalesce(still, F.lit(False))).drop("_now", "_before")


def runs(df: DataFrame, blocks: Strided, flag: str) -> DataFrame:
    """episode, flag, start, length of each maximal run of steps with equal flags.

    Runs are first counted within blocks; those rows, far fewer than steps, are numbered on across edges and joined where
    a run goes on. A run over many blocks is summed, never gathered.
    """
    e, s = blocks.episode, blocks.step
    changed = with_previous(df.select(e, s, flag), blocks, F.struct(flag), "_before")
    rows = blocks.of(changed.select(e, s, flag, F.when(F.col("_before").eqNullSafe(F.struct(flag)), 0).otherwise(1).alias("_change")))
    inner = F.sum("_change").over(Window.partitionBy(e, _BLOCK).orderBy(s))
    pieces = rows.withColumn("_run", inner).groupBy(e, _BLOCK, "_run", flag).agg(F.min(s).alias("start"), F.count("*").alias("length"))
    changes = pieces.groupBy(e, _BLOCK).agg(F.max("_run").alias("_n"))
    earlier = Window.partitionBy(e).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = changes.select(F.col(e).alias("_e"), F.col(_BLOCK).alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    numbered = pieces.join(before, F.col(e).eqNullSafe(F.col("_e")) & (F.col(_BLOCK) == F.col("_b"))).withColumn("_run", F.col("_run") + F.col("_off"))
    return numbered.groupBy(e, "_run", flag).agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length")).drop("_run")


def keep_ranges(df: DataFrame, blocks: Strided, vector: Column, threshold: float = 1e-3, min_idle: int = 7, min_keep: int = 16, trim: int = 10) -> DataFrame:
    """Half-open step ranges (episode, start, end) worth keeping, as episodes.keep_ranges gives them.

    What is kept lies between the idle runs of min_idle steps or more, so each of those, and an episode's beginning, looks
    for the next one's start; its end is one more bound.
    """
    e, s = blocks.episode, blocks.step
    idle = with_idle(df.select(e, s, vector.alias("_v")), blocks, F.col("_v"), threshold, "_idle")
    long = runs(idle, blocks, "_idle").where(F.col("_idle") & (F.col("length") >= min_idle))
    bounds = long.select(e, F.col("start").cast("long").alias("_start"), (F.col("start") + F.col("length")).cast("long").alias("_end"))
    ends = df.groupBy(e).agg((F.max(s) + 1).cast("long").alias("_n"))
    edges = F.array(F.struct(F.lit(-1).cast("long").alias("_start"), F.lit(0).cast("long").alias("_end")), F.struct(F.col("_n").alias("_start"), F.lit(None).cast("long").alias("_end")))
    bounds = bounds.unionByName(ends.select(e, F.explode(edges).alias("_x")).select(e, "_x.*"))
    placed = Strided(e, "_place", blocks.size)
    after = running(bounds.withColumn("_place", F.col("_start") + 1), placed, {"_next": ("min", F.col("_start"))}, backwards=True, own=False)
    found = after.where(F.col("_next") - F.col("_end") >= min_keep)
    return found.select(e, F.col("_end").cast("int").alias("start"), (F.col("_next") - trim).cast("int").alias("end"))


def action_chunks(df: DataFrame, blocks: Strided, action: str, horizon: int, name: str = "chunk") -> DataFrame:
    """Of each step the actions of it and the next ones, horizon in all; at the episode's end the last one is repeated."""
    rows = blocks.with_halo(df, after=horizon - 1)
    own = F.collect_list(F.struct(action)).over(Window.partitionBy(blocks.episode, _BLOCK).orderBy(blocks.step).rowsBetween(0, horizon - 1))[action]
    rows = rows.withColumn("_c", own).where("_own").drop(_BLOCK, "_own")
    return rows.withColumn(name, F.concat("_c", F.array_repeat(F.element_at("_c", -1), horizon - F.size("_c")))).drop("_c")


def arrival_rate(df: DataFrame, blocks: Strided, ts: str, last: int = 50) -> DataFrame:
    """df with rate: one over the mean distance of the last arrivals of the episode, in 1/s; null for the first."""
    w = Window.partitionBy(blocks.episode, _BLOCK).orderBy(blocks.step)
    rows = blocks.with_halo(df, before=last - 1)
    rows = rows.withColumn("_gap", F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / 1e6)
    gap = F.avg("_gap").over(w.rowsBetween(-(last - 2), 0))
    return rows.withColumn("_mean", gap).where("_own").withColumn("rate", 1 / F.when(F.col("_mean") != 0, F.col("_mean"))).drop("_gap", "_mean", _BLOCK, "_own")


def joined_until_missing(steps: DataFrame, frames: DataFrame, blocks: Strided) -> DataFrame:
    """Steps with their frames, each episode up to its first step without one."""
    e, s = blocks.episode, blocks.step
    there = steps.join(frames.withColumn("_there", F.lit(True)), [e, s], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    return running(there, blocks, {"_so_far": ("min", F.col("_there"))}).where("_so_far").drop("_there", "_so_far")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, most: int = SIZE) -> DataFrame:
    """left with value of right's last row of the key at or before ts; a key of more than most rows is cut along ts."""
    rest = [c for c in left.columns if c not in (key, ts)]
    rows = left.select(key, ts, F.struct(*(rest or [F.lit(1).alias("_")])).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    both = rows.unionByName(right.select(key, ts, F.col(value).alias("_value"), F.lit(0).alias("_side")), allowMissingColumns=True)
    # at one time right's rows come first; blocks never part rows of one time
    seen = running(both, cut_points(both.select(key, ts), key, ts, most), {"_seen": ("last", F.col("_value"))}, ties=["_side"]).where("_side = 1")
    return seen.select(key, ts, *[f"_left.{c}" for c in rest], F.col("_seen").alias(value)).select(*left.columns, value)


def moving_average(df: DataFrame, blocks: Strided, value: str, decay: float) -> DataFrame:
    """The last value of avg <- decay avg + (1 - decay) value for each episode, begun with its first value.

    A block is a weighted sum that decays on for as many steps as follow it, so blocks add up in any order.
    """
    e, s = blocks.episode, blocks.step
    rows = blocks.of(df.select(e, s, F.col(value).alias("_v")))
    last = F.max(s).over(Window.partitionBy(e, _BLOCK))
    weight = F.pow(F.lit(decay), F.col("_last") - F.col(s)) * F.when(F.col(s) == 0, 1.0).otherwise(1 - decay)
    sums = rows.withColumn("_last", last).groupBy(e, _BLOCK, "_last").agg(F.sum(F.col("_v") * weight).alias("_w"))
    ahead = F.max("_last").over(Window.partitionBy(e)) - F.col("_last")
    return sums.withColumn("_w", F.col("_w") * F.pow(F.lit(decay), ahead)).groupBy(e).agg(F.sum("_w").alias("average"))


def largest(df: DataFrame, blocks: Strided | Cuts) -> int:
    """The rows of the largest block: what one task has to hold of one episode."""
    sizes = blocks.of(df).groupBy(blocks.episode, _BLOCK).agg(F.count("*").alias("n"))
    return reduce(max, [r[0] or 0 for r in sizes.agg(F.max("n")).collect()], 0)
