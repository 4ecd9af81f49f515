"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains, so that a document may belong to
several. Nonnegative rates of the documents are then fitted by projected-gradient least squares, so that each domain's
expected tokens, sum of rate x tokens x posterior, meet its target. A step moves the rate of document i by
``rate_i <- max(0, rate_i - eta (p_i . W (S - T) / N + RIDGE (rate_i - 1)))``: of the whole corpus it needs only the domains'
totals S, one small sum over all documents; the rates follow from a document's own posterior. The least squares are
weighted by W, the inverse of the posteriors' second moments, under which the steps converge fast however alike the
domains are. The ridge keeps rates near 1 and is small.

Defined results: a null text counts as the empty one and has one token, its end; a domain without labelled rows gets no
posterior, and without any labelled rows all domains get the same; of labels that differ on one document the last domain counts; targets are scaled to sum to 1 over the domains that
hold at least REACH of the tokens, as no rates can meet those of the others; equal rows get equal rates; an empty table
gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, small_batches, stored
from .packing import token_count
from .quality import FIT_ROWS, SLOTS, features, labelled_features
from .words import Chunk, chunks

RIDGE, STEPS, TOLERANCE = 1e-3, 40, 5e-4
#: The least share of the tokens that a domain has to hold to be raised to its target.
REACH = 1e-6
#: Slots of hashed words, of which so many at most are telling for each domain.
WORD_SLOTS, TELLING = 1 << 18, 128
#: The domains of the labels table and what each is to weigh.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


@dataclass
class Classifier:
    """Softmax regression on the documents' features, and on whether they hold any of some telling words."""

    told: np.ndarray  # the telling words' slots, ascending
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # [features, domains]
    bias: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, SLOTS : SLOTS + len(self.mean)] = np.clip((x[:, SLOTS : SLOTS + len(self.mean)] - self.mean) / self.scale, -4, 4) / 4
        return x

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = (self.inputs(x) @ self.weights + self.bias).astype(np.float64)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _slots(c: Chunk) -> np.ndarray:
    return ((c.word >> np.uint64(17)) % np.uint64(WORD_SLOTS)).astype(np.int64)


def word_slots(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's words, hashed to WORD_SLOTS slots, once each in ascending order."""
    out = []
    for c in chunks(texts):
        both = np.unique(c.doc * WORD_SLOTS + _slots(c))
        out += np.split(both % WORD_SLOTS, np.searchsorted(both, np.arange(1, c.hi - c.lo) * WORD_SLOTS))
    return out


def holds(texts: list[str | None], place: np.ndarray, told: int) -> np.ndarray:
    """Which of the telling words each text has; place: of a slot among them, or -1."""
    out = np.zeros((len(texts), told), np.float32)
    for c in chunks(texts):
        at = place[_slots(c)]
        hit = at >= 0
        out[c.lo + c.doc[hit], at[hit]] = 1
    return out


def places(told: np.ndarray) -> np.ndarray:
    out = np.full(WORD_SLOTS, -1, np.int32)
    out[told] = np.arange(len(told))
    return out


def telling_words(words: list[np.ndarray], y: np.ndarray, domains: int, most: int = TELLING) -> np.ndarray:
    """Slots that are commoner in a domain than elsewhere, by log-likelihood ratio, at most so many of each domain."""
    every = np.concatenate(words) if words else np.zeros(0, np.int64)
    label = np.repeat(y, [len(w) for w in words])
    df = np.stack([np.bincount(every[label == d], minlength=WORD_SLOTS) for d in range(domains)]).astype(float)
    size, kept = np.bincount(y, minlength=domains).astype(float), []
    for d in range(domains):
        a, b, n1, n0 = df[d], df.sum(0) - df[d], size[d], size.sum() - size[d]
        if not n1 or not n0:
            continue
        ratio = np.zeros(WORD_SLOTS)
        for seen, total in ((a, n1), (b, n0)):
            for o, e in ((seen, (a + b) * total / (n1 + n0)), (total - seen, (n1 + n0 - a - b) * total / (n1 + n0))):
                ratio += np.where(o > 0, 2 * o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
        ratio[(a < 3) | (a * n0 <= 2 * b * n1)] = 0
        best = np.argsort(-ratio, kind="stable")[:most]
        kept.append(best[ratio[best] > 8])
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def has_words(words: list[np.ndarray], told: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(told)), np.float32)
    for i, w in enumerate(words):
        out[i, np.searchsorted(told, w[np.isin(w, told, assume_unique=True)])] = 1
    return out


def fit(x: np.ndarray, words: list[np.ndarray], y: np.ndarray, domains: int, steps: int = 400, rate: float = 0.05, decay: float = 2e-5, seed: int = 3) -> Classifier:
    """At least so many steps of at most 512 rows, whatever the number of rows: few rows are gone through more often."""
    rng = np.random.default_rng(seed)
    n = len(y)
    stats, told = x[:, SLOTS:], telling_words(words, y, domains)
    x = np.concatenate([x, has_words(words, told)], 1)
    d = x.shape[1]
    own = Classifier(told, stats.mean(0) if n else np.zeros(stats.shape[1]), np.maximum(stats.std(0), 1e-3) if n else np.ones(stats.shape[1]), np.zeros((d, domains), np.float32), np.zeros(domains, np.float32))
    if not n:
        return own
    share = np.bincount(y, minlength=domains) / n
    own.bias = np.where(share > 0, np.log(np.maximum(share, 1e-12)), -30).astype(np.float32)
    if (share > 0).sum() < 2:
        return own
    x, target = own.inputs(x), np.eye(domains, dtype=np.float32)[y]
    params = [own.weights, own.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, epochs = 0, -(-steps // -(-n // 512))
    for epoch in range(epochs):
        order, eta = rng.permutation(n), rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for lo in range(0, n, 512):
            b = order[lo : lo + 512]
            z = x[b] @ params[0] + params[1]
            e = np.exp(z - z.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - target[b]) / len(b)
            step += 1
            for p, grad, (m1, m2) in zip(params, (x[b].T @ g + decay * params[0], g.sum(0)), moments, strict=True):
                m1 *= 0.9
                m1 += 0.1 * grad
                m2 *= 0.999
                m2 += 0.001 * grad * grad
                p -= eta * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return own


def train(docs: DataFrame, labelled: DataFrame, domains: int, rows: int = FIT_ROWS) -> Classifier:
    """Fits on at most rows labelled documents (doc_id, label: the domain's number)."""
    x, y, words = labelled_features(docs, labelled, rows, lambda texts: [w.astype("<u4").tobytes() for w in word_slots(texts)], F.max)
    return fit(x, [np.frombuffer(w, "<u4").astype(np.int64) for w in words], y, domains)


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with the columns __p (an array over domains) and __n (tokens)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def scored(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        t, n = text.tolist(), n_chars.tolist()
        out: list[np.ndarray] = []
        told = held.value.told
        place = places(told)
        for i in range(0, len(t), 256):
            part = t[i : i + 256]
            out += list(held.value.posterior(np.concatenate([features(part, n[i : i + 256]), holds(part, place, len(told))], 1)))
        return pd.Series(out, dtype=object)

    return docs.withColumn("__p", scored(F.col("text"), F.col("n_chars").cast("double"))).withColumn("__n", token_count(F.col("text")))


@dataclass
class Rates:
    """The steps of a fit; a document's rate follows from its posterior and them alone."""

    eta: float
    pulls: list[np.ndarray]

    def of(self, p: np.ndarray) -> np.ndarray:
        rate = np.ones(len(p))
        for pull in self.pulls:
            rate = np.maximum(0, rate * (1 - self.eta * RIDGE) + self.eta * RIDGE - p @ pull)
        return rate

    def column(self) -> Column:
        """The rate of a row with the posterior __p."""

        @F.pandas_udf("double")
        def rated(p: pd.Series) -> pd.Series:
            return pd.Series(self.of(np.stack(p.tolist())) if len(p) else np.zeros(0))

        return rated("__p")


def _totals(scored: DataFrame, rates: Rates, d: int) -> np.ndarray:
    """Each domain's expected tokens at these rates: summed where the rows are, then over partitions."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                p = np.stack(pdf["__p"].tolist())
                yield pd.DataFrame([(rates.of(p) * pdf["__n"].to_numpy(float)) @ p], columns=[f"s{k}" for k in range(d)])

    rows = scored.select("__p", "__n").mapInPandas(summed, ", ".join(f"s{k} double" for k in range(d)))
    return np.array(rows.agg(*[F.sum(f"s{k}") for k in range(d)]).first(), float)


def reached(target: np.ndarray, now: np.ndarray, lowered: np.ndarray | None = None) -> np.ndarray:
    """Targets that sum to 1 over the domains that hold tokens (now: their shares); lowered ones are never above those shares."""
    out = np.where(now >= REACH, target, 0.0)
    low = np.zeros(len(out), bool) if lowered is None else lowered
    out[low] = np.minimum(out, now)[low]
    free = out[~low].sum()
    if not free:  # nothing else is there to take up the rest
        return now
    out[~low] *= (1 - out[low].sum()) / free
    return out


def fit_rates(scored: DataFrame, target: np.ndarray, lowered: np.ndarray | None = None) -> tuple[Rates, np.ndarray]:
    """The rates, and the domains' shares of all tokens that result; lowered: domains that are never raised.

    scored: __p and __n of every document. Each step is one sum over all of them, of as many numbers as there are domains.
    """
    d = len(target)
    p = [F.get("__p", F.lit(k)) for k in range(d)]
    pairs = [(a, b) for a in range(d) for b in range(a, d)]
    first = scored.agg(F.sum("__n"), *[F.sum(F.col("__n") * p[k]) for k in range(d)], *[F.sum(F.col("__n") * p[a] * p[b]) for a, b in pairs]).first()
    rates = Rates(1 / (1 + RIDGE), [])
    if not first[0]:
        return rates, np.zeros(d)
    total = float(first[0])
    now = np.array(first[1 : 1 + d]) / total
    target = reached(target, now, lowered)
    moment = np.zeros((d, d))
    for (a, b), v in zip(pairs, first[1 + d :], strict=True):
        moment[a, b] = moment[b, a] = v / total
    weight = np.linalg.inv(moment + 1e-6 * np.eye(d))
    for _ in range(STEPS):
        if np.abs(now - target).max() < TOLERANCE:
            break
        rates = Rates(rates.eta, [*rates.pulls, rates.eta * weight @ (now - target)])
        new = _totals(scored, rates, d) / total
        if np.abs(new - now).max() < TOLERANCE / 20:  # as near as the posteriors allow
            now = new
            break
        now = new
    return rates, now


def quality_domains(known: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as (doc_id, label): the number of the domain in DOMAINS."""
    return known.select("doc_id", F.when(F.col("toxic") > 0, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("label"))


def _shares(targets: Mapping[str, float]) -> np.ndarray:
    t = np.array([float(targets[k]) for k in targets])
    return t / t.sum()


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, whole: DataFrame | None = None, lowered: Collection[str] = ()) -> DataFrame:
    """docs with __p, __n, __rate and __copies (which replace columns of those names): the rate's whole part, and one more with the rest's probability, by a hash.

    The classifier is fitted on the labelled rows of whole (doc_id, text, n_chars; docs if None), so that it knows domains
    of which docs has little left; the domains in lowered are not raised to their targets, only brought down.
    """
    model = train(docs if whole is None else whole, labelled, len(targets))
    scored = stored(with_posteriors(docs, model), "posteriors")
    rates, _ = fit_rates(scored, _shares(targets), np.array([k in lowered for k in targets]))
    names = [c for c in docs.columns if c not in ("__p", "__n")]
    u = F.pmod(F.xxhash64("doc_id", *[c for c in ("text",) if c in names]), F.lit(1 << 20)) / float(1 << 20)
    return scored.withColumn("__rate", rates.column()).withColumn("__copies", F.floor(F.col("__rate") + u).cast("int"))


def resample(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, whole: DataFrame | None = None, lowered: Collection[str] = ()) -> DataFrame:
    """docs in the target weights: each row as many times as its rate says, or not at all."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "n_chars")
    rows = mixed(own, labelled, targets, docs if whole is None else whole, lowered).where("__copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, quality_domains(labels(spark, sf_dir)), len(DOMAINS))
    scored = stored(with_posteriors(docs.select("doc_id", "text", "n_chars"), model).select("doc_id", F.xxhash64("doc_id", "text").alias("_h"), "__p", "__n"), "posteriors")
    rates, _ = fit_rates(scored, _shares(TARGETS))
    u = F.pmod(F.col("_h"), F.lit(1 << 20)) / float(1 << 20)
    out = scored.withColumn("rate", rates.column())
    return out.select("doc_id", F.col("__n").alias("n_tokens"), *[F.get("__p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"))
