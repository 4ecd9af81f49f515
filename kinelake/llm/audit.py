"""How filters of documents interact: what each removes, alone and after others, in every order.

Each filter gives a document one bit; counts of bit masks by part say everything about every order, so texts are read for
the masks and never again for an order.

Repeated texts are found by refining a partition. Documents of equal length in code points stand together; those classes are
split by the hash of a first block of the text, then of the next, ever longer one, and a class of one document drops out as
soon as it is alone. What survives all blocks meets as full text: texts of a class are told apart by themselves, not by a
hash, and every document whose id is over the least one of its own text is marked. A class of copies, however large, is one
row of each task before it is shuffled as text.

Defined results: a null text is the empty one, which equals other empty ones; a null lang is the part `''`; a null doc_id
neither marks a copy nor is marked, and has no label; rows that repeat a doc_id and a text mark each other not; a document
is good (toxic) if any of its label rows says so; an empty table gives no parts; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, labels, stored

#: Code points of the first block, and how many times longer each next one ends; texts of 2^31 code points end in the last.
FIRST_BLOCK, GROWTH, BLOCKS = 256, 16, 7
_SPACE = " \t\n\x0b\f\r"


def block_hashes(text: Column, first: int = FIRST_BLOCK, hashed=F.xxhash64) -> list[Column]:
    """h0, h1, ...: a hash of each block of the text, 0 where the text ends before it."""
    out = []
    for k in range(BLOCKS):
        lo, hi = (first * GROWTH ** (k - 1) if k else 0), first * GROWTH**k
        block = F.substring(text, lo + 1, min(hi - lo, (1 << 31) - 1)) if lo < (1 << 31) - 1 else F.lit("")
        out.append(F.when(F.length(text) > min(lo, (1 << 31) - 1), hashed(block)).otherwise(F.lit(0)).cast("long").alias(f"h{k}"))
    return out


_KEY = ["n", *[f"h{k}" for k in range(BLOCKS)]]


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join by shuffle, whatever the sizes: a class may hold a third of all rows, and a hot one is split as it is read."""
    return left.join(right.hint("merge"), on, how)


def repeated_classes(facts: DataFrame, first: int = FIRST_BLOCK) -> DataFrame:
    """The classes (n, h0, h1, ...) that still have several documents when lengths and all blocks have split them."""
    longest = facts.agg(F.max("n")).first()[0] or 0
    left, blocks = facts.select(*_KEY), 1 + max(0, math.ceil(math.log(max(longest, 1) / first, GROWTH)))
    for k in range(min(blocks, BLOCKS) + 1):
        on = _KEY[: k + 1]
        # written first: a join of two tables as they are can be split where a length is hot, one under an aggregate cannot
        several = stored(left.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "several")
        left = stored(_met(left, several, on, "left_semi"), "survivors")
    return left.groupBy(*_KEY).agg(F.count("*").alias("members"))


def with_repeats(docs: DataFrame, columns: Mapping[str, Column], first: int = FIRST_BLOCK, hashed=F.xxhash64) -> DataFrame:
    """doc_id, the columns, and repeated: whether a smaller doc_id of docs (doc_id, text) has the same text.

    columns: what else is to be kept of each row, texts not being kept.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_text": text}).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_text"), F.length("_text").cast("long").alias("n"), *block_hashes(F.col("_text"), first, hashed), *[c.alias(k) for k, c in columns.items()])
    own = ["doc_id", *_KEY, *columns]
    facts = stored(keyed.select(*own), "facts")
    classes = stored(repeated_classes(facts, first), "classes").drop("members")
    texts = _met(keyed.select("doc_id", "_text", *_KEY), classes, _KEY, "left_semi")
    # by the text itself, so that rows of a class are combined where they are read; the class follows from the text
    texts = texts.groupBy("_text").agg(F.min("doc_id").alias("least"), *[F.first(k).alias(k) for k in _KEY])
    kinds = stored(texts.groupBy(*_KEY).agg(F.min("least").alias("least"), F.count("*").alias("kinds")), "kinds")
    over = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("repeated")
    told = lambda df: df.select("doc_id", *columns, over)
    settled = kinds.where("kinds = 1").drop("kinds")
    mixed = kinds.where("kinds > 1").select(*_KEY)
    if mixed.isEmpty():
        return told(_met(facts, settled, _KEY, "left"))
    # different texts whose lengths and hashes all agree: theirs are compared one by one
    plain = told(_met(_met(facts, mixed, _KEY, "left_anti"), settled, _KEY, "left"))
    rest = _met(_met(keyed, mixed, _KEY, "left_semi").drop(*_KEY), texts.select("_text", "least"), ["_text"], "left")
    return plain.unionByName(told(rest))


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A too few words, B words that repeat, C capital letters, D signs of markup or code."""
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    return {"A": n < 200, "B": 100 * kinds < 50 * n, "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def mask_of(failed: list[Column]) -> Column:
    """Bit i: the i-th filter fails the document."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failed)])


def interactions(masks: DataFrame, filters: str) -> DataFrame:
    """Counts by part, filter_order and step, of masks (part, mask, n, good, toxic: longs).

    filters: a letter for each bit. kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.
    """
    every = [F.lit(m) for m in range(1 << len(filters))]
    sums = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # at most 2^filters rows a part from here on
    held = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))
    counts = held.select("part", *[F.array(*[F.coalesce(F.col("m")[m][c], F.lit(0)).cast("long") for m in every]).alias(c) for c in ("n", "good", "toxic")])
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    places = F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    steps = counts.select("*", orders).select("*", places).withColumn("_filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)])
    bit = lambda letter: F.element_at(bits, letter)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(filters))), F.lit(0), lambda a, k: F.when(k < F.col("step"), a.bitwiseOR(bit(F.substring("filter_order", k, F.lit(1))))).otherwise(a))
    steps = steps.withColumn("_bit", bit(F.col("_filter"))).withColumn("_before", before)

    def total(c: str, chosen) -> Column:
        pairs = F.transform(c, lambda v, m: F.when(chosen(m), v).otherwise(F.lit(0).cast("long")))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, v: a + v)

    fails, gone = (lambda m: m.bitwiseAND(F.col("_bit")) != 0), (lambda m: m.bitwiseAND(F.col("_before")) != 0)
    removed = lambda m: fails(m) & ~gone(m)
    out = steps.select(
        "part", "filter_order", "step", "_filter",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get("n", F.col("_bit")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_filter"))).drop("_filter")


def audit(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The interactions of the filters A to E (E: a repeated text) over docs, by lang; labelled: doc_id, quality, toxic."""
    text = F.coalesce("text", F.lit(""))
    marked = with_repeats(docs, {"part": F.coalesce("lang", F.lit("")), "mask": mask_of(list(text_filters(text).values()))})
    rows = marked.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("repeated"), F.lit(16)).otherwise(F.lit(0))))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    said = labelled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(a) for c, a in (("quality", "_good"), ("toxic", "_toxic"))])
    rows = rows.join(said, "doc_id", "left")
    count = lambda c: (F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c[1:])
    return interactions(rows.select("part", "mask", "n", count("_good"), count("_toxic")), "ABCDE")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), labels(spark, sf_dir))


_WORDS = r"list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP12_SQL = rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents),
w AS MATERIALIZED (SELECT *, {_WORDS} AS words FROM t),
s AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  MAP {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x), 'D': regexp_matches(x, '[#$%&*|]'), 'E': e}} AS fails
  FROM w LEFT JOIN s USING (doc_id)),
g AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT f AS o FROM f UNION ALL SELECT o || f FROM o, f WHERE length(o) < 5 AND NOT contains(o, f)),
k AS (SELECT o AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE length(o) = 5),
r AS (SELECT part, filter_order, step, filter_order[step] AS f, n, good, toxic, fails[filter_order[step]] AS bad,
  len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AND fails[filter_order[step]] AS alone FROM g, k),
q AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM q
"""
