"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled recursion.

A text is its words (what ASCII white space separates, A-Z in lower case) and then an end token. A latent state follows
a Markov chain and emits a class for each token; the class emits the word. The commonest TOP words have a class of their
own, others share SUFFIXES classes by their last letters, in which a word has the probability
``(c + 0.1) / (C + 0.1 (V + 1))`` from its count c, the class's tokens C and its kinds of word V (the rest is for unknown
words), so the probabilities of all texts sum to one. Words are known by 64-bit hashes.

All counts cover every training text: word counts by a distributed sum, and Baum-Welch from random values, each round of
which adds up expected counts over partitions, until a round gains less than TOLERANCE a token.
Long texts are cut into segments of SEGMENT tokens whose transfer matrices give the exact state at each seam, so all
segments of a batch are walked in step, and none is taken apart from what comes before it.

Scoring looks up the counts of the FREQUENT commonest words (a table of that size) in the task that reads the text;
all other words are joined to the whole table of counts by hash, wherever it is.

Defined results: a null text counts as the empty one, which is the end token alone; a null doc_id counts as the empty
text for its fold; equal texts get equal scores; without training texts each token's base probability is that of an
unknown word; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, id_crc, small_batches, stored
from .words import Chunk, chunks, mix

TOP, SUFFIXES, STATES = 2048, 1024, 6
FREQUENT = 1 << 17
#: Baum-Welch ends after a round whose model has gained less than this in natural-log likelihood a token.
TOLERANCE = 1e-3
SEGMENT = 256
#: Bytes of text, tokens counted, tokens walked at once.
BATCH_BYTES, COUNT_TOKENS, BATCH_TOKENS = 4 << 20, 1 << 22, 1 << 19
SMOOTH = 0.1
#: The end token's hash, and its class after those of the words.
END, END_CLASS = 0, TOP + SUFFIXES
CLASSES = TOP + SUFFIXES + 1


def suffix_classes(c: Chunk) -> np.ndarray:
    """Each word's class (0 to SUFFIXES - 1) by its last three bytes."""
    last = [np.where(c.end - k >= c.start, c.data[np.maximum(c.end - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3)]
    return (mix(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16), 5) % np.uint64(SUFFIXES)).astype(np.int64)


def word_keys(c: Chunk) -> np.ndarray:
    """Words as signed hashes, as Spark's longs are; END is kept for the end token."""
    h = c.word.view(np.int64).copy()
    h[h == END] = 1
    return h


class Table:
    """Values by key, for keys in an array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], missing)


def with_ends(values: np.ndarray, doc: np.ndarray, n_docs: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The docs' values with an end after each, and how many each then has."""
    counts = np.bincount(doc, minlength=n_docs)
    out = np.full(len(values) + n_docs, end, values.dtype)
    out[np.arange(len(values)) + doc] = values
    return out, counts + 1


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # [STATES, CLASSES]


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls) -> Counts:
        return cls(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start.ravel(), self.move.ravel(), self.emit.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Counts:
        a, b = STATES, STATES + STATES * STATES
        return cls(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, CLASSES))


def maximised(counts: Counts, unigram: np.ndarray, strength: float = 20.0) -> Model:
    """Probabilities from expected counts, smoothed towards the classes' own shares."""
    emit = counts.emit + strength * unigram
    move = counts.move + 0.1
    start = counts.start + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def first_model(unigram: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = unigram * np.exp(rng.normal(0, 1.0, (STATES, CLASSES)))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def walk(tokens: np.ndarray, lengths: np.ndarray, model: Model, counts: Counts | None = None) -> np.ndarray:
    """Each text's natural-log likelihood; tokens: classes of all texts, one after the other; lengths: of each, over 0.

    With counts, the texts' expected counts are added to it.
    """
    n_docs = len(lengths)
    if not n_docs:
        return np.zeros(0)
    a, emit = model.move, np.ascontiguousarray(model.emit.T)
    parts = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(n_docs), parts)
    index = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    first_token = np.repeat(np.cumsum(lengths) - lengths, parts) + index * SEGMENT
    size = np.minimum(lengths[doc] - index * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")  # the segments that still run are always the first ones
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    size, begin = size[order], first_token[order]
    steps = int(size[0])
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # segments longer than each step
    is_first = index[order] == 0
    many = parts[doc[order]] > 1
    seen = np.zeros((steps, len(order)), np.int32)
    for t in range(steps):
        seen[t, : alive[t]] = tokens[begin[: alive[t]] + t]

    ahead = np.ones((len(order), STATES))  # of what follows each segment, given the state at its end
    entry = np.tile(model.start, (len(order), 1))  # the state of each segment's first token, given what came before
    left = np.zeros((len(order), STATES))  # the state at the end of the segment before
    kind = np.float64 if counts is None else np.float32
    if many.any():
        # in double precision whatever is wanted: between two scalings products fall far below what single precision has
        forth, emit_by_state = np.ascontiguousarray(a.T), np.ascontiguousarray(model.emit)
        # a seam's state needs the segments between the first and it; what follows one needs the last as well
        needed = many & ~is_first
        if counts is None:
            needed &= index[order] < parts[doc[order]] - 1
        own = np.flatnonzero(needed)
        m = np.zeros((STATES, STATES, len(own)))  # by the state at a segment's end, the state before it, segment
        m[np.arange(STATES), np.arange(STATES)] = 1
        transfer = np.zeros((len(order), STATES, STATES))
        running = np.searchsorted(own, alive)
        for t in range(steps + 1):
            n = int(running[t]) if t < steps else 0
            if n < m.shape[2]:
                transfer[own[n : m.shape[2]]] = m[:, :, n:].transpose(2, 1, 0)
                m = np.ascontiguousarray(m[:, :, :n])
            if not n:
                break
            m = (forth @ m.reshape(STATES, -1)).reshape(STATES, STATES, n)
            m *= emit_by_state.take(seen[t, own[:n]], axis=1)[:, None, :]
            if t % 16 == 15:
                m /= m.sum((0, 1))
        base = np.cumsum(parts) - parts
        docs = np.flatnonzero(parts > 1)
        docs = docs[np.argsort(-parts[docs], kind="stable")]
        # the first segment's vector, then one matrix after the other
        zero = place[base[docs]]
        v = _first_end(seen, size, zero, model, emit)
        for j in range(1, int(parts[docs[0]])):
            live = int((parts[docs] > j).sum())
            at = place[base[docs[:live]] + j]
            v = v[:live]
            left[at] = v
            entry[at] = v @ a
            v = np.einsum("ns,nst->nt", v, transfer[at])
            v /= np.maximum(v.sum(1, keepdims=True), np.finfo(float).tiny)
        if counts is not None:
            b = np.ones((len(docs), STATES))
            for j in range(int(parts[docs[0]]) - 1, 0, -1):
                live = int((parts[docs] > j).sum())
                at = place[base[docs[:live]] + j]
                b[:live] = np.einsum("nst,nt->ns", transfer[at], b[:live])
                b[:live] /= b[:live].max(1, keepdims=True)
                ahead[place[base[docs[:live]] + j - 1]] = b[:live]

    # expected counts need no more than single precision, as every step is scaled; likelihoods that are returned alone do
    # by state first, then by segment: each operation runs along the segments
    a, emit, entry, left, ahead = (np.ascontiguousarray(v, kind) for v in (a, model.emit, entry.T, left.T, ahead.T))
    forth = np.ascontiguousarray(a.T)
    scale = np.ones((steps, len(order)), kind)
    keep = np.empty((steps, STATES, len(order)), kind) if counts is not None else None
    x = entry * emit.take(seen[0], axis=1)
    for t in range(steps):
        n = int(alive[t])
        if t:
            x = forth @ x[:, :n]
            x *= emit.take(seen[t, :n], axis=1)
        s = x.sum(0)
        scale[t, :n] = s
        x /= s
        if keep is not None:
            keep[t, :, :n] = x
    logs = np.bincount(doc[order], weights=np.log(scale).sum(0, dtype=np.float64), minlength=n_docs)
    if counts is None:
        return logs

    b = np.zeros((STATES, len(order)), kind)
    inverse = 1 / scale
    for t in range(steps - 1, -1, -1):
        n, ends = int(alive[t]), int(alive[t + 1]) if t + 1 < steps else 0
        if n > ends:  # segments whose last token this is
            z = ahead[:, ends:n]
            b[:, ends:n] = z / (keep[t, :, ends:n] * z).sum(0)
        # what follows is scaled as what came before was, so that both together sum to one
        w = emit.take(seen[t, :n], axis=1)
        w *= b[:, :n]
        w *= inverse[t, :n]
        keep[t, :, :n] *= b[:, :n]
        if t:
            counts.move += a * (keep[t - 1, :, :n] @ w.T)
            b[:, :n] = a @ w
        else:
            inner = ~is_first
            if inner.any():
                counts.move += a * (left[:, inner] @ w[:, inner].T)
            counts.start += keep[0][:, is_first].sum(1)
    mask = np.arange(steps)[:, None] < size[None, :]
    which = seen[mask]
    for s in range(STATES):
        counts.emit[s] += np.bincount(which, weights=keep[:, s][mask], minlength=CLASSES)
    return logs


def _first_end(seen: np.ndarray, size: np.ndarray, at: np.ndarray, model: Model, emit: np.ndarray) -> np.ndarray:
    """The state at the end of first segments that are whole ones."""
    v = model.start * emit[seen[0, at]]
    for t in range(1, SEGMENT):
        v = (v @ model.move) * emit[seen[t, at]]
        if t % 16 == 0:
            v /= v.sum(1, keepdims=True)
    return v / v.sum(1, keepdims=True)


def word_counts(train: DataFrame) -> DataFrame:
    """h, suffix, c: each word of the texts, the end token too (h = END, suffix = -1)."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = ends = 0

        def summed() -> pd.DataFrame:
            both = np.concatenate(held, 1)
            h, at, n = np.unique(both[0], return_index=True, return_counts=True)
            return pd.DataFrame({"h": h, "suffix": both[1][at].astype(np.int32), "n": n})

        for pdf in frames:
            for c in chunks(pdf["text"].tolist()):
                held.append(np.stack([word_keys(c), suffix_classes(c)]))
                size += len(c.word)
                if size > COUNT_TOKENS:
                    yield summed()
                    held, size = [], 0
            ends += len(pdf)
        if held:
            yield summed()
        if ends:
            yield pd.DataFrame({"h": [END], "suffix": np.array([-1], np.int32), "n": [ends]})

    return train.select("text").mapInPandas(counted, "h long, suffix int, n long").groupBy("h", "suffix").agg(F.sum("n").alias("c"))


def class_sequences(c: Chunk, top: Table) -> tuple[np.ndarray, np.ndarray]:
    own = top.find(word_keys(c), -1)
    cls = np.where(own >= 0, own, TOP + suffix_classes(c))
    return with_ends(cls, c.doc, c.hi - c.lo, END_CLASS)


@dataclass
class LanguageModel:
    model: Model
    vocabulary: DataFrame
    n_tokens: int
    n_kinds: int
    #: The commonest words' counts, and the classes of the first of them.
    frequent: Table
    top: Table
    #: For each suffix class, the natural log of what its words' smoothed counts are divided by.
    log_class: np.ndarray

    @property
    def log_all(self) -> float:
        return float(np.log10(self.n_tokens + SMOOTH * (self.n_kinds + 1)))


def train_model(train: DataFrame, tolerance: float = TOLERANCE) -> LanguageModel:
    """Fits on train (doc_id, text). The driver receives tables of fixed size: FREQUENT words, classes, expected counts."""
    spark = train.sparkSession
    small_batches(spark)
    vocabulary = stored(word_counts(train), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = vocabulary.where(F.col("h") != END)
    # sixteenths of a doubling of the count: a few hundred bins, of which the upper ones hold FREQUENT words at most
    level = F.floor(F.log2("c") * 16)
    upper, least = 0, None
    for r in sorted(words.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect(), reverse=True):
        upper += r.n
        if upper > FREQUENT:
            break
        least = r.l
    best = words.where(level >= (float("inf") if least is None else least)).toPandas().sort_values(["c", "h"], ascending=[False, True])
    frequent = Table(best["h"].to_numpy(np.int64), best["c"].to_numpy(np.int64))
    named = best.iloc[:TOP]
    top = Table(named["h"].to_numpy(np.int64), np.arange(len(named), dtype=np.int64))
    by_class = words.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    own_c, own_v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    own_c[by_class["suffix"]], own_v[by_class["suffix"]] = by_class["c"], by_class["v"]
    own_c -= np.bincount(named["suffix"], weights=named["c"], minlength=SUFFIXES)
    own_v -= np.bincount(named["suffix"], minlength=SUFFIXES)
    ends = n - (int(by_class["c"].sum()) if len(by_class) else 0)
    shares = np.zeros(CLASSES)
    shares[: len(named)] = named["c"]
    shares[TOP : TOP + SUFFIXES] = own_c
    shares[END_CLASS] = ends
    unigram = (shares + SMOOTH) / (shares + SMOOTH).sum()
    log_class = np.log(own_c + SMOOTH * (own_v + 1))

    def sequences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for c in chunks(pdf["text"].tolist(), limit=BATCH_BYTES):
                cls, lengths = class_sequences(c, top)
                yield pd.DataFrame({"classes": [x.astype(np.int16).tobytes() for x in np.split(cls, np.cumsum(lengths)[:-1])]})

    model, before = first_model(unigram), -np.inf
    classes = stored(train.select("text").mapInPandas(sequences, "classes binary"), "classes") if n else None
    while n:
        counts, logs = _expected(classes, model)
        if not np.isfinite(logs):
            raise ArithmeticError("the texts' likelihood is no number")
        model = maximised(counts, unigram)
        if not logs - before >= tolerance * n:
            break
        before = logs
    return LanguageModel(model, vocabulary, n, v, frequent, top, log_class)


def _expected(classes: DataFrame, model: Model) -> tuple[Counts, float]:
    """Expected counts over all texts, and their natural-log likelihood: each partition's, summed by position.

    classes: each text's classes, as int16.
    """
    held = classes.sparkSession.sparkContext.broadcast(model)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        counts, logs = Counts.zero(), 0.0
        for pdf in frames:
            texts = [np.frombuffer(x, np.int16) for x in pdf["classes"]]
            lengths = np.array([len(x) for x in texts], np.int64)
            # runs of texts of about BATCH_TOKENS
            run = np.cumsum(lengths) // BATCH_TOKENS
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(texts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    logs += walk(np.concatenate(texts[lo:hi]).astype(np.int64), lengths[lo:hi], model, counts).sum()
        flat = np.append(counts.flat(), logs)
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"i": at, "v": flat[at]})

    got = classes.mapInPandas(summed, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    held.unpersist()
    flat = np.zeros(len(Counts.zero().flat()) + 1)
    flat[got["i"]] = got["v"]
    return Counts.of(flat[:-1]), float(flat[-1])


def score_texts(docs: DataFrame, lm: LanguageModel) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) in place of text.

    Columns of those names are replaced; the others stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((lm.model, lm.frequent, lm.top, lm.log_class, lm.log_all))
    made = {"text", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    kept = [f for f in docs.schema.fields if f.name not in made]
    known_at, base_at, logs_at, words_at, suffix_at, times_at, row_at = (fresh(f"_{k}", docs) for k in ("known", "base", "logs", "h", "s", "n", "row"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ends = lm.vocabulary.where(F.col("h") == END).select("c").first()
    n_ends = ends.c if ends else 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, top, log_class, log_all = held.value
        for batch in batches:
            for c in chunks(batch.column("text").to_pylist(), limit=BATCH_BYTES):
                n = c.hi - c.lo
                keys, suffix = word_keys(c), suffix_classes(c)
                own, count = top.find(keys, -1), frequent.find(keys, 0)
                classes, lengths = with_ends(np.where(own >= 0, own, TOP + suffix), c.doc, n, END_CLASS)
                logs = walk(classes, lengths, model) / np.log(10)
                known = count > 0
                base = np.bincount(c.doc[known], np.log10(count[known] + SMOOTH) - log_all, n) + np.log10(n_ends + SMOOTH) - log_all
                shared = known & (own < 0)
                logs += np.bincount(c.doc[shared], (np.log(count[shared] + SMOOTH) - log_class[suffix[shared]]) / np.log(10), n)
                # each text's other words, once each with their number
                h, d, s = keys[~known], c.doc[~known], suffix[~known]
                order = np.lexsort((h, d))
                h, d, s = h[order], d[order], s[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(h)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(d[at], minlength=n))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[at], s[at].astype(np.int32), times.astype(np.int32))]
                rows = batch.slice(c.lo, n)
                columns = [rows.column(f.name) for f in kept]
                n_known = np.bincount(c.doc[known], minlength=n) + (n_ends > 0)
                columns += [pa.array(x) for x in (lengths.astype(np.int64), n_known.astype(np.int64), base, logs)] + lists
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["n_tokens", known_at, base_at, logs_at, words_at, suffix_at, times_at])

    own = docs.mapInArrow(scored, (fields + ", " if fields else "") + f"n_tokens long, {known_at} long, {base_at} double, {logs_at} double, {words_at} array<long>, {suffix_at} array<int>, {times_at} array<int>")
    first = stored(own.withColumn(row_at, F.monotonically_increasing_id()), "scored")
    rare = first.select(F.col(row_at).alias("row"), F.explode(F.arrays_zip(F.col(words_at).alias("h"), F.col(suffix_at).alias("s"), F.col(times_at).alias("n"))).alias("w")).select("row", "w.*")
    c = F.coalesce("c", F.lit(0))
    log_class = F.array(*[F.lit(float(x)) for x in lm.log_class])
    looked = rare.join(lm.vocabulary.select("h", "c"), "h", "left").select(
        "row",
        F.when(c > 0, F.col("n")).otherwise(0).alias("k"),
        (F.col("n") * (F.log10(c + SMOOTH) - lm.log_all)).alias("b"),
        (F.col("n") * (F.log(c + SMOOTH) - F.get(log_class, F.col("s"))) / float(np.log(10))).alias("m"),
    )
    sums = looked.groupBy("row").agg(F.struct(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("m").alias("m")).alias("sums"))
    more = fresh("_more", first)
    zero = lambda name: F.coalesce(F.col(more)[name], F.lit(0))
    return first.drop(words_at, suffix_at, times_at).join(sums.select(F.col("row").alias(row_at), F.col("sums").alias(more)), row_at, "left").select(
        *[F.col(f"`{f.name}`") for f in kept],
        "n_tokens",
        (F.col(known_at) + zero("k")).cast("long").alias("n_known"),
        F.lit(lm.n_tokens).cast("long").alias("train_tokens"),
        (F.col(base_at) + zero("b")).alias("base_score"),
        (F.col(logs_at) + zero("m")).alias("score"),
    )


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    fold = id_crc("doc_id", 10)
    lm = train_model(docs.where(fold != 0))
    return score_texts(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), lm)
