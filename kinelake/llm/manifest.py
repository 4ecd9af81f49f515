"""Merkle manifest of a dataset: a tree of SHA-256 digests for each group of rows, one over the groups, and proofs.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A group's leaves stand in order of
their key; while a level has several nodes, every ARITY consecutive ones, the last run fewer, become their H; a lone
node stays. What remains is the group's subroot, and the subroots in order of group (null first, bytewise) make the root.

Leaves are sorted by ranges of (group, key, leaf) and checkpointed. A partition's first group begins as many places in as
earlier partitions hold rows of it, so one number for each partition gives every leaf its place. Each task builds the
complete aligned subtrees (BLOCK leaves) of its stretch; the ragged ones at its edges are shuffled by their coordinate
(group, block) and put together there. Upper levels take nodes by coordinate too, ARITY at a time; proofs come back down
the same way. No group is gathered in one task, and the driver holds a row for each partition.

Defined results: nulls are written as `-` and come first in order; rows of one key are ordered by their digests, and equal
rows keep a leaf each (they are sorted in one task); a null text differs from an empty one; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, id_crc, partitions, small_batches, stored
from .sharding import CRC_CTES, crc_sql

ARITY, DEPTH = 16, 3
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings of a node at each level from a leaf up: its place among them, and their digests one after the other.
PROOF = "array<struct<place:int,siblings:string>>"
_DIGEST = 64
#: Leaves of a block that a task hands on at once.
_ROWS = 256


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _h(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtree(leaves: list[str], alone: bool) -> list[list[str]]:
    """The levels over a block's leaves: up to a single node where the block is a whole group, else DEPTH of them."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= DEPTH:
        last = levels[-1]
        levels.append([_h(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def _alone(block: int, n: int) -> bool:
    return block == 0 and n < BLOCK


def _starts(leaves: DataFrame) -> dict[int, tuple[int, bool]]:
    """For each partition that has rows: rows of its first group in earlier ones, and whether its last group goes on."""
    counts = leaves.groupBy(F.spark_partition_id().alias("part"), "grp").agg(F.count("*").alias("n"))
    place = F.struct(F.col("grp").isNotNull().alias("there"), "grp")
    ends = counts.groupBy("part").agg(F.min(F.struct(place.alias("g"), "n")).alias("first"), F.max(F.struct(place.alias("g"), "n")).alias("last"))
    out: dict[int, tuple[int, bool]] = {}
    before, last, rows = None, None, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        first = r["first"].g.grp
        goes_on = before is not None and first == last
        if goes_on:
            out[before] = (out[before][0], True)
        start = rows if goes_on else 0
        out[r.part] = (start, False)
        last = r["last"].g.grp
        rows = r["last"].n + (start if first == last else 0)
        before = r.part
    return out


def _blocks(leaves: DataFrame, key_type: str) -> DataFrame:
    """grp, block, keys, leaves, others, digest: every aligned subtree of a sorted, checkpointed table (grp, key, leaf, other)."""
    spark = leaves.sparkSession
    starts = spark.sparkContext.broadcast(_starts(leaves))
    schema = f"grp string, block long, first long, keys array<{key_type}>, leaves array<string>, others array<string>, digest string"
    key = pa.int64() if key_type == "long" else pa.string()
    arrow = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("keys", pa.list_(key)), ("leaves", pa.list_(pa.string())), ("others", pa.list_(pa.string())), ("digest", pa.string())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, goes_on = starts.value.get(TaskContext.get().partitionId(), (0, False))
        group, first, rows = None, at, []

        def done(ended: bool) -> pa.RecordBatch:
            block, own = first // BLOCK, [list(c) for c in zip(*rows, strict=True)]
            whole = first % BLOCK == 0 and (ended or len(rows) == BLOCK)
            digest = subtree(own[1], _alone(block, len(rows)))[-1][0] if whole else None
            return pa.RecordBatch.from_pylist([{"grp": group, "block": block, "first": first, "keys": own[0], "leaves": own[1], "others": own[2], "digest": digest}], arrow)

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "leaf", "other")), strict=True):
                if rows and (g != group or (first + len(rows)) % BLOCK == 0):
                    yield done(g != group)
                    first, rows = (first + len(rows) if g == group else 0), []
                group = g
                rows.append(row)
        if rows:
            yield done(not goes_on)

    cut = stored(leaves.mapInArrow(local, schema), "subtrees")
    ragged = cut.where("digest IS NULL").groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("first", "keys", "leaves", "others"))).alias("p"))  # BLOCK leaves at most
    ragged = ragged.select("grp", "block", *[F.flatten(f"p.{c}").alias(c) for c in ("keys", "leaves", "others")])

    @F.pandas_udf("string")
    def top(block, leaves):
        return block.combine(leaves, lambda b, own: subtree(list(own), _alone(b, len(own)))[-1][0])

    return stored(cut.where("digest IS NOT NULL").drop("first").unionByName(ragged.withColumn("digest", top("block", "leaves"))), "blocks")


def _lone(children: Column, parent: Column) -> Column:
    return (parent == 0) & (F.size(children) == 1)


def _folded(children: Column, parent: Column) -> Column:
    """The node over a run: their H, or the lone node of a level itself."""
    return F.when(_lone(children, parent), F.get(children, F.lit(0))).otherwise(F.sha2(F.concat_ws("", children).cast("binary"), 256))


class Tree:
    """The trees of a table (grp string, key of key_type, leaf string, other string), one for each grp."""

    def __init__(self, rows: DataFrame, key_type: str):
        spark = rows.sparkSession
        small_batches(spark)
        order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("other").asc_nulls_first()]
        self.key_type = key_type
        self.blocks = _blocks(checkpointed(rows.select("grp", "key", "leaf", "other").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)), key_type)
        most = self.blocks.agg(F.max("block")).first()[0] or 0
        nodes, self.runs = self.blocks.select("grp", F.col("block").alias("idx"), F.col("digest").alias("h")), []
        while most:
            most //= ARITY
            run = nodes.groupBy("grp", F.floor(F.col("idx") / ARITY).alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), "h"))).alias("c"))
            run = stored(run.select("grp", "idx", F.col("c.h").alias("children")), "runs")
            self.runs.append(run)
            nodes = run.select("grp", "idx", _folded(F.col("children"), F.col("idx")).alias("h"))
        self.tops = nodes.select("grp", F.col("h").alias("top"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """key, leaf, other, proof and above's columns for each leaf; above has grp and proof, the way on from its top."""
        rest = [c for c in above.columns if c not in ("grp", "proof")]
        way = above.select(F.col("grp").alias("g"), F.lit(0).cast("long").alias("i"), "proof", *rest)
        for run in reversed(self.runs):
            met = run.join(way, run.grp.eqNullSafe(way.g) & (run.idx == way.i))
            each = met.select("grp", "idx", "children", "proof", *rest, F.posexplode("children").alias("place", "_own"))
            others = F.concat_ws("", F.filter("children", lambda _, k: k != F.col("place")))
            own = F.when(_lone(F.col("children"), F.col("idx")), F.array().cast(PROOF)).otherwise(F.array(F.struct("place", others.alias("siblings"))).cast(PROOF))
            way = each.select(F.col("grp").alias("g"), (F.col("idx") * ARITY + F.col("place")).alias("i"), F.concat(own, "proof").alias("proof"), *rest)
        blocks = self.blocks
        met = blocks.join(way, blocks.grp.eqNullSafe(way.g) & (blocks.block == way.i)).select("block", "keys", "leaves", "others", "proof", *rest)
        key = pa.int64() if self.key_type == "long" else pa.string()
        step = pa.struct([("place", pa.int32()), ("siblings", pa.string())])
        arrow = pa.schema([("key", key), *[(c, pa.string()) for c in ("leaf", "other", *rest)], ("proof", pa.list_(step))])

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    r = batch.slice(k, 1).to_pylist()[0]
                    levels = subtree(r["leaves"], _alone(r["block"], len(r["leaves"])))
                    # the siblings of every node, once
                    sides = [[{"place": i % ARITY, "siblings": "".join(level[i - i % ARITY : i] + level[i + 1 : i - i % ARITY + ARITY])} for i in range(len(level))] for level in levels[:-1]]
                    for lo in range(0, len(r["leaves"]), _ROWS):
                        hi = min(lo + _ROWS, len(r["leaves"]))
                        proof = [[side[i // ARITY**d] for d, side in enumerate(sides)] + r["proof"] for i in range(lo, hi)]
                        columns = [r["keys"][lo:hi], r["leaves"][lo:hi], r["others"][lo:hi], *[[r[c]] * (hi - lo) for c in rest], proof]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return met.mapInArrow(down, f"key {self.key_type}, leaf string, other string, {''.join(f'{c} string, ' for c in rest)}proof {PROOF}")


def manifest(docs: DataFrame, digest: Column, other: Column | None = None, key: str = "doc_id", group: str = "source") -> DataFrame:
    """key, leaf, other, subroot, root, proof of every row of docs.

    digest: a row's leaf; other: a digest that is to be held against the tree in its place, or null. proof (see PROOF) leads
    from the leaf over its group's subroot to the root.
    """
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), digest.alias("leaf"), (F.lit(None) if other is None else other).cast("string").alias("other"))
    trees = Tree(rows, "long")
    tops = stored(trees.tops, "tops")
    over = Tree(tops.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("other")), "string")
    root = over.tops.select("grp", F.array().cast(PROOF).alias("proof"), F.col("top").alias("root"))
    above = over.proofs(root).select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "root", "proof")
    return trees.proofs(stored(above, "above")).withColumnRenamed("key", key)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(h: Column, s: Column) -> Column:
        before = s["place"] * _DIGEST
        return F.sha2(F.concat(F.substring(s["siblings"], F.lit(1), before), h, F.substring(s["siblings"], before + 1, F.length(s["siblings"]))).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in FIELDS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(id_crc("doc_id", 5) == 0, leaf_digest([*fields[:-1], lower]))
    rows = manifest(docs, leaf_digest(fields), tampered)
    told = F.concat_ws("", F.transform("proof", lambda s: s["siblings"]))
    rows = rows.withColumn("proof_sha256", F.sha2(told.cast("binary"), 256)).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _told(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


#: Levels that the SQL writes out: groups of up to 16^_SQL_LEVELS rows, and as many groups.
_SQL_LEVELS = 6


def _sql_levels(name: str, groups: str) -> str:
    """Nodes of each level over {name}0 (groups, i, h), with what stands left and right of them in their runs."""
    by = f"{groups + ', ' if groups else ''}i // {ARITY}"
    out = []
    for k in range(_SQL_LEVELS):
        over = f"(PARTITION BY {by} ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}s{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') OVER {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, "
            f"count(*) OVER (PARTITION BY {by}) = 1 AND i // {ARITY} = 0 AS lone FROM {name}{k})"
        )
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {groups + ', ' if groups else ''}i // {ARITY} AS i, CASE WHEN bool_and(lone) THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}s{k} GROUP BY {by})")
    return ",\n".join(out)


def _sql_way(name: str, groups: str) -> str:
    """For each row of w ({groups}, i, f, p): f folded and p grown over all levels of {name}."""
    out, last = [], f"{name}w0"
    for k in range(_SQL_LEVELS):
        on = f"s.i = w.i // {ARITY**k}" + (f" AND s.{groups} IS NOT DISTINCT FROM w.{groups}" if groups else "")
        out.append(f"{name}w{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN lone THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p) FROM {last} w JOIN {name}s{k} s ON {on})")
        last = f"{name}w{k + 1}"
    return ",\n".join(out)


_PLAIN, _LOWER = (f"sha256({' || '.join([_told(c) for c in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR')] + [_told(t)])})" for t in ("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
OP11_SQL = f"""
WITH RECURSIVE {CRC_CTES},
d AS MATERIALIZED (SELECT doc_id, source AS g, {_PLAIN} AS h, CASE WHEN {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 THEN {_LOWER} END AS other FROM documents, t),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
a0 AS (SELECT g, i, h FROM a),
{_sql_levels('a', 'g')},
b AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM a{_SQL_LEVELS}),
b0 AS (SELECT i, h FROM b),
{_sql_levels('b', '')},
aw0 AS (SELECT doc_id, g, i, h, coalesce(other, h) AS f, '' AS p FROM a),
{_sql_way('a', 'g')},
bw0 AS (SELECT w.doc_id, w.h, b.h AS subroot, b.i, w.f, w.p FROM aw{_SQL_LEVELS} w JOIN b ON w.g IS NOT DISTINCT FROM b.g),
{_sql_way('b', '')}
SELECT doc_id, w.h AS leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM bw{_SQL_LEVELS} w, b{_SQL_LEVELS} r
"""
