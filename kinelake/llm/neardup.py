"""Near-duplicate classes by Order MinHash, checked by banded alignment.

A text is the sequence of its runs of SHINGLE_WORDS words, each labelled with its occurrence number in the text, so that
no element repeats. A sketch takes the SAMPLED elements that are least under a hash function and keeps them in text order;
that sketches of two texts agree is likelier the closer the texts are in edit distance. Texts that agree on one of
SKETCHES sketches are candidates. Two texts of n and m words are alike if c / (n + m - c) is SIMILARITY or more, where c
words of both stand in the same order (a banded alignment, whose band is as wide as any such pair can need), and if they
share FLOOR or more of the longer one's elements. Replaced words up to a ninth of a text keep a pair alike.

A bucket of texts is never turned into its pairs. Each bucket links its members to the least one, and the components of
these links hold every candidate pair. Within a component, an index of each text's rarest elements finds the pairs that
can share FLOOR of them (a prefix filter, which loses none), and the alignment confirms them; a pair that is already
connected isn't looked at again, and elements that only texts of one class have are not listed. A component of more than
BLOCK_ELEMENTS is cut into blocks, and each pair of its blocks is a task of its own.

Texts are known by their 128-bit digests, so exact copies are one text from the start, however many there are.
Everything is distributed: the driver sees row counts and checksums alone.

Defined results: a null text counts as the empty one; texts without words are in one class only if they are equal;
fewer than SHINGLE_WORDS words are one element; a class's id is its least doc_id (null where all are null), and rows
with a null doc_id are the last to be kept; equal rows are in one class, of which one row stays; an empty table gives
an empty one; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, fresh, partitions, small_batches, stored, stored_at
from .words import chunks, mix, shingles

SHINGLE_WORDS, SIMILARITY, FLOOR = 5, 0.8, 0.4
#: Replacing one in twelve of a long text's words leaves 0.65 of its elements; two such texts agree on one of 32 sketches of
#: 3 elements with probability 0.98 (one in ten: 0.91).
SKETCHES, SAMPLED = 32, 3
#: Elements of a block: 8 bytes each, and two blocks meet in a task.
BLOCK_ELEMENTS = 2_000_000
#: Parts in which the rows of a component of many blocks are dealt.
_SALTS = 64
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


@dataclass
class Elements:
    """Of texts lo to lo + n: words and elements in text order, with their texts (counted from lo)."""

    lo: int
    n: int
    word: np.ndarray
    word_doc: np.ndarray
    h: np.ndarray
    doc: np.ndarray

    def sequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each text's words, its words labelled with their occurrence numbers, and its elements."""
        cut = lambda v, doc: np.split(v, np.cumsum(np.bincount(doc, minlength=self.n))[:-1])
        return zip(cut(self.word, self.word_doc), cut(labelled(self.word, self.word_doc), self.word_doc), cut(self.h, self.doc), strict=True)


def labelled(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """h mixed with its occurrence number in its text, so that no text has one twice."""
    own = h ^ mix(doc.astype(np.uint64), 3)
    order = np.argsort(own, kind="stable")
    s = own[order]
    again = np.zeros(len(s), np.int64)
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        start = np.flatnonzero(new)
        again[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.where(again > 0, mix(h + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 9), h)


def elements(texts: list[str | None], k: int = SHINGLE_WORDS) -> Iterator[Elements]:
    """Whole texts by chunks."""
    for c in chunks(texts):
        h, doc = shingles(c.word, c.doc, c.hi - c.lo, k)
        yield Elements(c.lo, c.hi - c.lo, c.word, c.doc, labelled(h, doc), doc)


def sketches(h: np.ndarray, doc: np.ndarray, n: int, count: int) -> np.ndarray:
    """Order MinHash sketches [texts, count]; a text without elements has zeros."""
    out = np.zeros((n, count), np.uint64)
    sizes = np.bincount(doc, minlength=n)
    have = np.flatnonzero(sizes)
    if not len(have):
        return out
    start = (np.cumsum(sizes) - sizes)[have]
    of = np.repeat(np.arange(len(have)), sizes[have])
    for s in range(count):
        v = h * (mix(np.array([s], np.uint64), 77)[0] | np.uint64(1))
        at = []
        for _ in range(SAMPLED):
            least = np.minimum.reduceat(v, start)
            hit = np.flatnonzero(v == least[of])
            first = np.zeros(len(have), np.int64)
            first[of[hit]] = hit
            at.append(first)
            v[hit] = _MOST
        key = np.zeros(len(have), np.uint64)
        for i in np.sort(np.stack(at), 0):
            key = mix(key * np.uint64(31) + h[i], 2)
        out[have, s] = key
    return out


def _sketched(texts: DataFrame) -> DataFrame:
    """texts (id, text, copy) with n (elements) and keys (a sketch and its number) in place of text."""
    number = np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for e in elements(pdf["text"].tolist()):
                sizes = np.bincount(e.doc, minlength=e.n)
                keys = (sketches(e.h, e.doc, e.n, SKETCHES) + number).view(np.int64)
                own = pdf.iloc[e.lo : e.lo + e.n]
                yield pd.DataFrame({"id": own["id"].tolist(), "copy": own["copy"].tolist(), "n": sizes, "keys": [k if s else k[:0] for k, s in zip(keys, sizes, strict=True)]})

    return texts.select("id", "copy", "text").mapInPandas(made, "id binary, copy long, n long, keys array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root): the least id of each vertex's component. edges: (a, b), in any order; only vertices with edges appear.

    Alternating large and small stars until only stars are left; each round is written to the shared folder.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def stars(pairs: DataFrame) -> bool:
        """Whether each u has one v, and no v is a u: then each v is the least id of its component."""
        ends = pairs.select("u", F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        return ends.groupBy("u").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("v")).where("n > 1 OR (n = 1 AND v = 1)").isEmpty()

    spark, earlier, before = edges.sparkSession, None, None
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(smallest(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges, path = stored_at(small.where("u <> v").distinct(), name)
        if earlier:
            discard(spark, earlier)
        earlier = path
        now = edges.count()
        if before in (None, now) and stars(edges):
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def places(x: np.ndarray) -> dict[int, int]:
    """For each word of a text, its places as the bits of a number."""
    out: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(x: dict[int, int], n: int, y: np.ndarray, band: int) -> int:
    """Longest common subsequence of a text of n words (given as places) and y, of which places further apart than band don't match.

    All cells of an alignment's row are one number's bits, so a row is a few operations on it.
    """
    row = whole = (1 << n) - 1
    window = (1 << (2 * band + 1)) - 1
    for j, w in enumerate(y.tolist()):
        if m := x.get(w):
            hit = row & m & (window << (j - band) if j >= band else window >> (band - j))
            row = ((row + hit) | (row - hit)) & whole
    return n - row.bit_count()


def needed(n: int | np.ndarray, m: int | np.ndarray, least: float) -> int | np.ndarray:
    """How many words texts of n and m words have to have in the same order to be alike."""
    return np.ceil(least * (n + m) / (1 + least) - 1e-9).astype(np.int64)


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY, known: dict[int, int] | None = None) -> bool:
    """Of two texts' words; known: x's places."""
    need = int(needed(len(x), len(y), least))
    if need > min(len(x), len(y)):
        return False
    return common_length(places(x) if known is None else known, len(x), y, max(len(x), len(y)) - need) >= need


class _Bags:
    """Texts as numbers of what they have, none twice."""

    def __init__(self, seqs: list[np.ndarray], key: np.ndarray):
        self.size = np.array([len(s) for s in seqs], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.names, self.flat = np.unique(np.concatenate(seqs) ^ np.repeat(key, self.size), return_inverse=True)
        self.mark = np.zeros(len(self.names), bool)

    def shared(self, x: int, ys: np.ndarray) -> np.ndarray:
        """How many numbers x has in common with each of ys."""
        if not len(ys):
            return np.zeros(0, np.int64)
        own = self.flat[self.begin[x] : self.begin[x] + self.size[x]]
        self.mark[own] = True
        lens = self.size[ys]
        where = np.repeat(self.begin[ys] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        got = np.add.reduceat(self.mark[self.flat[where]], np.cumsum(lens) - lens, dtype=np.int64)
        self.mark[own] = False
        return got


class _Classes:
    """Union of numbered members, each of which knows its class at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members: list[list[int] | None] = [None] * n

    def join(self, x: int, y: int) -> None:
        a, b = int(self.of[x]), int(self.of[y])
        own = [self.members[c] or [c] for c in (a, b)]
        if len(own[0]) > len(own[1]):
            a, b, own = b, a, own[::-1]
        self.of[own[0]] = b
        self.members[b], self.members[a] = own[1] + own[0] if self.members[b] is None else own[1], None
        if self.members[b] is own[1]:
            own[1].extend(own[0])


def link(group: np.ndarray, side: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of each text to the first of its class, where alike texts of a group are in one class; only texts of different
    sides are compared where a group has two.

    texts: what Elements.sequences gives. A text is first held against the
    last one that has an element of its own; what that joins isn't listed, however many texts it has. Texts that share too
    few elements, or too few words in any order, aren't aligned.
    """
    n = len(texts)
    words, key = [w for w, _, _ in texts], mix(group.astype(np.uint64), 4)
    if not sum(map(len, words)):
        return []
    runs, bags = _Bags([e for *_, e in texts], key), _Bags([w for _, w, _ in texts], key)
    size, long, begin, flat, names = runs.size, bags.size, runs.begin, runs.flat, runs.names
    of = np.repeat(np.arange(n), size)
    df = np.bincount(flat)
    order = np.lexsort((flat, df[flat], of))  # each text's elements, the rarest first
    need = np.ceil(FLOOR * size - 1e-9).astype(np.int64)
    rank = np.arange(len(flat)) - begin[of]
    headed = (rank < (size - need + 1)[of]) & (df[flat[order]] > 1)
    head, head_of = flat[order][headed], of[headed]
    by = np.argsort(head, kind="stable")
    posted, posted_of = head[by], head_of[by]
    first = np.searchsorted(posted, np.arange(len(names)))
    after = np.append(first[1:], len(posted))
    head_begin = np.concatenate([[0], np.cumsum(np.bincount(head_of, minlength=n))])
    two = np.zeros(n, bool)
    if side.any():
        both = np.bincount(group.astype(np.int64), side, group.max() + 1)
        alone = np.bincount(group.astype(np.int64), 1 - side, group.max() + 1)
        two = ((both > 0) & (alone > 0))[group]
    kept, last, mixed = _Classes(n), np.full((2, len(names)), -1, np.int64), np.zeros(len(names), bool)
    seen = np.zeros(n, bool)
    for x in range(n):
        h = head[head_begin[x] : head_begin[x + 1]]
        if not len(h):
            continue
        known: dict[int, int] | None = None

        def tried(y: int, x: int = x) -> bool:
            nonlocal known
            if kept.of[x] == kept.of[y]:
                return False
            known = known or places(words[x])
            if not similar(words[x], words[y], least, known):
                return False
            kept.join(x, y)
            return True

        def likely(ys: np.ndarray, x: int = x) -> list[int]:
            """Those of ys that share enough to be alike, the likeliest first."""
            common = needed(long[x], long[ys], least)
            ys = ys[common <= np.minimum(long[x], long[ys])]
            ys = ys[runs.shared(x, ys) >= np.maximum(need[x], need[ys])]
            both = bags.shared(x, ys)
            enough = both >= needed(long[x], long[ys], least)
            return ys[enough][np.argsort(-both[enough], kind="stable")].tolist()

        before = last[1 - side[x] if two[x] else side[x], h]
        near, hits = np.unique(before[before >= 0], return_counts=True)
        if len(near):  # one of each class, that with most elements in common
            near = near[np.argsort(-hits, kind="stable")]
            near = near[np.sort(np.unique(kept.of[near], return_index=True)[1])]
            for y in likely(near):
                tried(y)
        listed = h[(before >= 0) & (mixed[h] | (kept.of[np.maximum(before, 0)] != kept.of[x]))]
        for k in listed.tolist():
            ys = posted_of[first[k] : after[k]]
            ys = ys[: np.searchsorted(ys, x)]
            apart = ys[kept.of[ys] != kept.of[x]]
            mixed[k] = len(apart) > 0
            seen[apart] = True
        near = np.flatnonzero(seen[:x]) if len(listed) else near[:0]
        seen[near] = False
        if two[x]:
            near = near[side[near] != side[x]]
        for y in likely(near):
            tried(y)
        s = side[x]
        mixed[h] |= (last[s, h] >= 0) & (kept.of[np.maximum(last[s, h], 0)] != kept.of[x])
        last[s, h] = x
    _, first, back = np.unique(kept.of, return_index=True, return_inverse=True)
    return [(x, y) for x, y in enumerate(first[back].tolist()) if x != y]


def _verified(members: DataFrame, least: float) -> DataFrame:
    """(a, b) links among members (root, part, side, id, text), all of a root and part in one task."""

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        weight = 0

        def links() -> pd.DataFrame:
            keys = {k: i for i, k in enumerate(dict.fromkeys(h[0] for h in held))}
            group = np.array([keys[h[0]] for h in held])
            pairs = link(group, np.array([h[1] for h in held]), [h[3] for h in held], least)
            return pd.DataFrame({"a": [held[x][2] for x, _ in pairs], "b": [held[y][2] for _, y in pairs]})

        for pdf in frames:
            roots, parts = pdf["root"].tolist(), pdf["part"].tolist()
            sides, ids = pdf["side"].tolist(), pdf["id"].tolist()
            for e in elements(pdf["text"].tolist()):
                for i, text in enumerate(e.sequences(), e.lo):
                    key = (bytes(roots[i]), parts[i])
                    if weight > BLOCK_ELEMENTS and key != held[-1][0]:
                        yield links()
                        held, weight = [], 0
                    held.append((key, sides[i], bytes(ids[i]), text))
                    weight += len(text[0])
        if held:
            yield links()

    n = partitions(members.sparkSession)
    return members.repartition(n, "root", "part").sortWithinPartitions("root", "part", "side").mapInPandas(checked, "a binary, b binary")


def text_classes(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, root) of the texts that are like another one. texts: id, text, and copy, a number that tells rows of one text apart."""
    spark = texts.sparkSession
    small_batches(spark)
    signed = stored(_sketched(texts), "sketches")
    buckets = signed.select("id", F.explode("keys").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("other")).where("head <> other").select("key", "head")
    edges = buckets.join(heads, "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    near = stored(components(edges, "candidates"), "near")
    sizes = near.join(signed.groupBy("id").agg(F.first("n").alias("n")), "id")
    blocks = sizes.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks")).where("blocks > 1")
    # only components of many blocks are looked up, by parts, so that none is dealt to one task by its root
    cut = blocks.select("root", "blocks", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    dealt = near.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(_SALTS)).cast("int")).join(cut, ["root", "salt"], "left")
    many = F.coalesce("blocks", F.lit(1))
    # a member of a component of one block has one place; others meet each block of theirs, themselves included
    own = F.pmod(F.xxhash64("id"), many).cast("int")
    placed = dealt.select("root", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), many - 1)).alias("other"), many.alias("blocks"))
    placed = placed.select("root", "id", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    # one row of each text that is needed, found by id and copy, so that the copies of a text don't meet in a task; texts
    # go by one shuffle at every size: whether the needed ones fit a broadcast isn't left to chance
    first = signed.groupBy("id").agg(F.min("copy").alias("copy")).join(near.select("id"), "id")
    once = texts.select("id", "copy", "text").join(first.hint("merge"), ["id", "copy"], "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    links = _verified(once.join(placed, "id"), least)
    return components(stored(links, "links"), "classes")


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has _id and _root with doc_id; classes has _root, class_id, class_size and the row to keep."""
    texts = docs.select(digest(F.col("text")).alias("id"), F.xxhash64("doc_id").alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(text_classes(texts, least), "roots")
    rows = docs.select("doc_id", digest(F.col("text")).alias("_id"))
    rows = rows.join(found.select(F.col("id").alias("_id"), F.col("root").alias("_root")), "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id"), F.col("_id")))
    classes = rows.groupBy("_root").agg(best.alias("best"), F.count("*").alias("class_size"))
    named = classes.select("_root", F.col("best.doc_id").alias("class_id"), F.col("best._id").alias("_kept"), "class_size")
    return rows, stored(named, "named")  # written, so that a join on it may split a class that holds very many rows


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the least doc_id's."""
    _, classes = near_duplicate_classes(docs.select("doc_id", "text"), least)
    text, void, key, tie = (fresh(n, docs) for n in ("_text", "_void", "_key", "_tie"))
    named = lambda id: [F.col(id).isNull().alias(void), F.coalesce(id, F.lit(0)).cast("long").alias(key)]
    chosen = classes.select(F.col("_kept").alias(text), *named("class_id"))
    # by text and id, so that the copies of a text don't meet
    held = docs.select("*", digest(F.col("text")).alias(text), *named("doc_id")).join(chosen, [text, void, key], "left_semi")
    first = Window.partitionBy(text, void, key).orderBy(F.lit(0))  # rows equal in doc_id and text are alike
    return held.withColumn(tie, F.row_number().over(first)).where(F.col(tie) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classes = near_duplicate_classes(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.join(classes, "_root").select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_id") == F.col("_kept"))).alias("kept"))
