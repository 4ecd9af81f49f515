"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a vector x: L2-normalised log counts of its words in hashed slots, standardised statistics of its form
(symbols, capitals, repetition, line shapes) and metadata (the table's n_chars). Its score is
``sigmoid(b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: all pairwise interactions at rank f, in
time linear in the features by the sum-of-squares identity. Labels, language, source and id are never inputs.

Defined results: a null text is scored as the empty one, and the empty one gets the score of its statistics; null
n_chars counts as the text's own length; equal rows get equal scores; labelled rows of one document that differ count as
label 0; without labelled rows of both kinds every score
is the share of label 1 (0.5 if there are none); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_crc, labels, one_label, small_batches
from .words import chunks, shingles

#: Hashed word slots and latent factors.
SLOTS, RANK = 1024, 8
#: At most so many labelled rows fit the model; a larger table is sampled by a hash of the id.
FIT_ROWS = 8_000

_STATS = 24
_CLASS = np.zeros((8, 256), np.uint8)
_CLASS[0, 65:91] = 1  # capitals
_CLASS[1, 97:123] = 1  # small letters
_CLASS[2, 48:58] = 1  # digits
_CLASS[3, 128:] = 1  # beyond ASCII
_CLASS[4, [ord(c) for c in ".,;:'\"-()"]] = 1
_CLASS[5, [ord(c) for c in "#$%&*@^~=+<>{}[]\\/_"]] = 1
_CLASS[6, [ord(c) for c in "!?"]] = 1
_CLASS[7, [ord("|")]] = 1


def features(texts: list[str | None], n_chars: list[int | None]) -> np.ndarray:
    """A row for each text: SLOTS word weights, then _STATS statistics (not standardised)."""
    out = np.zeros((len(texts), SLOTS + _STATS), np.float32)
    for c in chunks(texts, lower=False):
        n = c.hi - c.lo
        size = (c.doc_end - c.doc_start).astype(float)
        slot = (c.word >> np.uint64(20)).astype(np.int64) % SLOTS
        counts = np.bincount(c.doc * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS)
        x = np.log1p(counts)
        out[c.lo : c.hi, :SLOTS] = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        words = np.bincount(c.doc, minlength=n).astype(float)
        per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
        cols = [np.add.reduceat(cls[c.data], c.doc_start, dtype=np.int64) * per_byte for cls in _CLASS]
        length = (c.end - c.start).astype(float)
        lines = np.add.reduceat((c.data == 10).view(np.uint8), c.doc_start, dtype=np.int64).astype(float)
        cols += [np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(words / lines)]
        mean = np.bincount(c.doc, length, n) * per_word
        cols += [mean, np.sqrt(np.maximum(np.bincount(c.doc, length**2, n) * per_word - mean**2, 0))]
        cols += [np.bincount(c.doc, length <= 2, n) * per_word, np.bincount(c.doc, length >= 14, n) * per_word]
        first, last = c.data[c.start], c.data[c.end - 1]
        cols += [np.bincount(c.doc, _CLASS[0][first], n) * per_word, np.bincount(c.doc, _CLASS[0][last], n) * per_word]
        cols += [np.bincount(c.doc, _CLASS[5][last] | _CLASS[6][last], n) * per_word]
        for k in (1, 3):
            h, d = (c.word, c.doc) if k == 1 else shingles(c.word, c.doc, n, k)
            order = np.lexsort((h, d))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
            cols.append(np.bincount(d[order], new, n) / np.maximum(np.bincount(d, minlength=n), 1))
        cols.append((words == 0).astype(float))
        cols.append(np.bincount(c.doc, counts[c.doc, slot] > 0.05 * words[c.doc], n) * per_word)
        given = [len(t or "") if k is None or k != k else k for t, k in zip(texts[c.lo : c.hi], n_chars[c.lo : c.hi], strict=True)]
        cols.append(np.log1p(np.maximum(np.array(given, float), 0)))
        out[c.lo : c.hi, SLOTS:] = np.stack(cols, 1)
    return out


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, SLOTS:] = np.clip((x[:, SLOTS:] - self.mean) / self.scale, -4, 4) / 4
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        x = self.inputs(x)
        s = x @ self.factors
        z = self.bias + x @ self.linear + 0.5 * ((s * s).sum(1) - (x * x) @ (self.factors**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
    """Adam on the log loss, by mini batches in a fixed order."""
    rng = np.random.default_rng(seed)
    stats = x[:, SLOTS:]
    share = float(y.mean()) if len(y) else 0.5
    d = SLOTS + _STATS
    scale = np.maximum(stats.std(0), 1e-3) if len(y) else np.ones(_STATS)
    model = FactorisationMachine(stats.mean(0) if len(y) else np.zeros(_STATS), scale, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(d, np.float32), np.zeros((d, RANK), np.float32))
    if share in (0.0, 1.0) or not len(y):
        model.bias = float(np.clip(model.bias, -6, 6))
        return model
    x = model.inputs(x)
    params = [np.array([model.bias], np.float32), model.linear, rng.normal(0, 0.05, (d, RANK)).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        eta = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for lo in range(0, len(order), 512):
            xb, yb = x[order[lo : lo + 512]], y[order[lo : lo + 512]]
            v = params[2]
            s = xb @ v
            x2 = xb * xb
            z = params[0][0] + xb @ params[1] + 0.5 * ((s * s).sum(1) - x2 @ (v**2).sum(1))
            e = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - yb).astype(np.float32) / len(yb)
            grads = [np.array([e.sum()], np.float32), xb.T @ e + decay * params[1], xb.T @ (e[:, None] * s) - v * (x2.T @ e)[:, None] + decay * v]
            step += 1
            for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.999
                m2 += 0.001 * g * g
                p -= eta * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    model.bias, model.linear, model.factors = float(params[0][0]), params[1], params[2]
    return model


def labelled_features(docs: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS, more: Callable[[list], list[bytes]] | None = None, settle: Callable[[Column], Column] = F.min) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Features and labels of at most rows labelled documents (doc_id, label), the least by a hash of the id, and what more makes of their texts.

    Where a document has several labels, settle takes one of them. The features are made where the texts are; the driver receives them as half floats, at most rows of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = one_label(labelled, settle(F.col("label"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "label", F.xxhash64("doc_id").alias("h"))

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            x = features(texts, pdf["n_chars"].tolist()).astype(np.float16)
            yield pd.DataFrame({"h": pdf["h"], "label": pdf["label"].astype(int), "x": [r.tobytes() for r in x], "more": more(texts) if more else [b""] * len(x)})

    got = own.mapInPandas(rows_of, "h long, label int, x binary, more binary").groupBy("h").agg(F.min(F.struct("label", "x", "more")).alias("r")).select("h", "r.*").toPandas().sort_values("h")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), SLOTS + _STATS).astype(np.float32)
    return x, got["label"].to_numpy(np.int64), got["more"].tolist()


def train(docs: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fits on labelled (doc_id, label)."""
    x, y, _ = labelled_features(docs, labelled, rows)
    return fit(x, y.astype(np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, name: str = "quality_score") -> DataFrame:
    """docs with the column name (0 to 1, higher is better; one of that name is replaced); text is read whole."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        t, n = text.tolist(), n_chars.tolist()
        return pd.Series(np.concatenate([held.value.score(features(t[i : i + 256], n[i : i + 256])) for i in range(0, len(t), 256)]) if t else np.zeros(0))

    return docs.withColumn(name, scored(F.col("text"), F.col("n_chars").cast("double")))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).where(id_crc("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, train(docs, known))
    return scored.select("doc_id", (id_crc("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
