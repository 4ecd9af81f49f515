"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, compared window by window.

A text is cut into windows of WINDOW_WORDS words. Before compression each byte of a word becomes two bytes that hash the
word up to there, and words are kept apart by a mark, so that matches are word beginnings and whole words. Of each class
zstandard trains a dictionary on that class's own windows, all of them alike; nothing chooses words. A window's saving is
its length under the ordinary dictionary less its length under the toxic one put before the ordinary one, in bytes. Two
pairs of dictionaries are used (SIZES): small ones hold what is frequent in a class, large ones leave out what is merely
rare in ordinary text. How the savings of a document lie over thresholds is calibrated to a probability by a logistic
model. It is fitted on savings under dictionaries that have not seen the document (FOLDS parts, each left out once); the
dictionaries that score are then trained on all parts.

Labels, language, source and id are never inputs. Two labelled rows of one document that differ count as toxic.

Defined results: a null text counts as the empty one, which has no window and saves nothing; text is read whole, in any
number of windows; equal texts get equal scores; without labelled rows of both kinds every score is the share of label 1
(0 if there are none); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_crc, labels, one_label, small_batches
from .words import byte_chunks, prefix_hashes

WINDOW_WORDS = 4
#: At most so many labelled documents of either kind are used to fit, and of each so many windows (and about so many
#: bytes of them), spread evenly over it. Scoring reads whole texts.
FIT_DOCS, FIT_WINDOWS, FIT_BYTES = 3_000, 160, 1 << 15
#: Bytes of the toxic and of the ordinary dictionary, for each pair.
SIZES = ((16_384, 16_384), (65_536, 262_144))
#: The dictionary builder's segment and the strings it counts, in bytes; windows that make one of its samples.
SEGMENT, COUNTED, TOGETHER = 24, 8, 8
FOLDS = 3
#: A window's saving counts from each of these bytes on.
STEPS = (3, 5, 8, 11)
_FEATURES = 2 + 2 * len(STEPS) + 2

_APART = np.zeros(256, bool)  # white space, ASCII control characters and punctuation
_APART[list(range(33)) + [127]] = True
for _a, _b in ((33, 47), (58, 64), (91, 96), (123, 126)):
    _APART[_a : _b + 1] = True


@dataclass
class Windows:
    """The windows of some texts: [start, start + size) of data, and how many each text has."""

    data: bytes
    start: np.ndarray
    size: np.ndarray
    count: np.ndarray

    def pieces(self) -> list[bytes]:
        return [self.data[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]


def windows(texts: Sequence[str | None], k: int = WINDOW_WORDS) -> Windows:
    """Whole texts; the caller bounds their bytes."""
    raw = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    inside = ~_APART[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    at = np.flatnonzero(inside)
    word = np.repeat(np.arange(len(start)), stop - start)
    h = prefix_hashes(data[at], stop - start)
    # word i is at begin[i]; the two bytes before it, and those after the last word, are a mark
    size = 2 * (stop - start)
    begin = np.cumsum(size) - size + 2 * np.arange(1, len(start) + 1)
    out = np.ones(2 * len(at) + 2 * len(start) + 2, np.uint8)
    out[begin - 1] = 2
    out[-1] = 2
    place = 2 * np.arange(len(at)) + 2 * (word + 1)
    for i, shift in enumerate((33, 17)):
        out[place + i] = 3 + ((h >> np.uint64(shift)) % np.uint64(253)).astype(np.uint8)
    doc = np.searchsorted(ends, start)
    words = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(words) - words
    head = np.flatnonzero((np.arange(len(start)) - first[doc]) % k == 0)
    last = np.minimum(head + k, (first + words)[doc[head]]) - 1
    return Windows(out.tobytes(), begin[head] - 2, begin[last] + size[last] + 2 - begin[head] + 2, np.bincount(doc[head], minlength=len(raw)))


@dataclass
class Sample:
    """What a labelled document gives to a fit: some of its windows, and how many it has."""

    pieces: list[bytes]
    count: int


def sampled(texts: Sequence[str | None], most: int = FIT_WINDOWS, most_bytes: int = FIT_BYTES) -> list[Sample]:
    """Each text's windows, of more than most (or most_bytes) some that are spread evenly; longer single ones are left out."""
    w = windows(texts)
    pieces, out, lo = w.pieces(), [], 0
    for n in w.count.tolist():
        own = pieces[lo : lo + n]
        lo += n
        stride = max(-(-n // most), -(-sum(map(len, own)) // most_bytes), 1)
        out.append(Sample([p for p in own[::stride] if len(p) <= most_bytes], n))
    return out


class Compressor:
    """Lengths of windows under a dictionary."""

    def __init__(self, content: bytes):
        log = max(16, len(content).bit_length() + 1)
        p = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=5, min_match=6, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        if content:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.own = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
        else:
            self.own = zstandard.ZstdCompressor(compression_params=p)

    def lengths(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        segments = np.stack([start, size], 1).astype("<u8").tobytes()
        got = self.own.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
        return np.array([len(got[i]) for i in range(len(got))], np.int64)


def trained(samples: Sequence[Sample], size: int, seed: int = 1) -> bytes:
    """zstandard's dictionary of a class's windows, in a mixed order, so that no long run of them is of one document."""
    parts = [b"".join(s.pieces[i : i + TOGETHER]) for s in samples for i in range(0, len(s.pieces), TOGETHER)]
    parts = [p for p in parts if len(p) >= COUNTED]
    parts = [parts[i] for i in np.random.default_rng(seed).permutation(len(parts))]
    try:
        return zstandard.train_dictionary(size, parts, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(parts)[:size]


@dataclass
class CompressionPairs:
    #: For each pair the toxic and the ordinary dictionary.
    contents: list[tuple[bytes, bytes]]
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def __post_init__(self) -> None:
        self._ready: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def savings(self, data: bytes, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """For each pair, the bytes that its toxic dictionary saves on each window."""
        if self._ready is None:
            self._ready = [(Compressor(o), Compressor(t + o)) for t, o in self.contents]
        return [o.lengths(data, start, size) - t.lengths(data, start, size) for o, t in self._ready]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[0] + np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        out = []
        for lo, hi in byte_chunks(texts):
            if not self.contents:
                out.append(np.full(hi - lo, 1 / (1 + np.exp(-self.weights[0]))))
                continue
            w = windows(texts[lo:hi])
            out.append(self.probability(summaries(self.savings(w.data, w.start, w.size), w.count, w.count)))
        return np.concatenate(out) if out else np.zeros(0)


def summaries(saved: Sequence[np.ndarray], given: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row for each document: for each pair the mean saving, that of its three best windows, and how many of its count windows save
    as much as each of STEPS (judged by the given ones), as a share and as a log; at last the log of count."""
    doc = np.repeat(np.arange(len(given)), given)
    last = np.cumsum(given) - 1
    many, per = np.maximum(given, 1), []
    for s in saved:
        cols = [np.bincount(doc, np.clip(s, -4, 8), len(given)) / many]
        ranked = np.minimum(s, 12)[np.lexsort((s, doc))]
        best = [np.where(given > i, ranked[np.maximum(last - i, 0)], 0) if len(ranked) else np.zeros(len(given)) for i in range(3)]
        cols.append(sum(best) / np.clip(given, 1, 3))
        for t in STEPS:
            share = np.bincount(doc, s >= t, len(given)) / many
            cols += [share, np.log1p(share * count)]
        cols += [np.bincount(doc, s <= -t, len(given)) / many for t in (4, 8)]
        per += cols
    return np.stack([*per, np.log(np.maximum(count, 1))], 1)


def _rows(pairs: CompressionPairs, samples: Sequence[Sample]) -> np.ndarray:
    pieces = [p for s in samples for p in s.pieces]
    size = np.array([len(p) for p in pieces], np.int64)
    given, count = (np.array(v, np.int64) for v in ([len(s.pieces) for s in samples], [s.count for s in samples]))
    return summaries(pairs.savings(b"".join(pieces), np.cumsum(size) - size, size), given, count)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[Sample], ordinary: list[Sample], share: float | None = None) -> CompressionPairs:
    """share: how much of all labelled rows is toxic, where the samples are drawn by label."""
    if not toxic or not ordinary:
        p = (1 - 1e-6) if toxic else 1e-6
        return CompressionPairs([], weights=np.array([np.log(p / (1 - p))]))
    make = lambda t, o: CompressionPairs([(trained(t, a), trained(o, b)) for a, b in SIZES])
    own = lambda docs, f: [d for i, d in enumerate(docs) if i % FOLDS != f] or docs
    held = lambda docs, f: docs[f::FOLDS]
    rows, y = [], []
    for f in range(FOLDS):
        pairs = make(own(toxic, f), own(ordinary, f))
        for docs, label in ((held(toxic, f), 1.0), (held(ordinary, f), 0.0)):
            if docs:
                rows.append(_rows(pairs, docs))
                y += [label] * len(docs)
    x, out = np.concatenate(rows), make(toxic, ordinary)
    out.centre, out.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    out.weights = _logistic(np.clip((x - out.centre) / out.scale, -8, 8), np.array(y))
    if share is not None:  # the sample has its own share of toxic rows; weigh back
        out.weights[0] += np.log(share / (1 - share)) - np.log(len(toxic) / len(ordinary))
    return out


def train(docs: DataFrame, labelled: DataFrame, per_kind: int = FIT_DOCS) -> CompressionPairs:
    """Fits on labelled (doc_id, label): at most per_kind documents of either label, the least by a hash of the id."""
    small_batches(docs.sparkSession)
    known = one_label(labelled, F.max((F.col("label") > 0).cast("int"))).withColumn("h", F.xxhash64("doc_id"))
    n1, n = known.agg(F.sum("label"), F.count("*")).first()
    if not n:
        return fit([], [Sample([], 0)])
    parts = [known.where(F.col("label") == k).orderBy("h", "doc_id").limit(per_kind) for k in (1, 0)]
    own = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("text", "label", "h")

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            got = [s for lo, hi in byte_chunks(texts) for s in sampled(texts[lo:hi])]
            sizes = [np.array([len(p) for p in s.pieces], "<u4").tobytes() for s in got]
            yield pd.DataFrame({"h": pdf["h"], "label": pdf["label"], "count": [s.count for s in got], "sizes": sizes, "data": [b"".join(s.pieces) for s in got]})

    made = own.mapInPandas(rows_of, "h long, label int, count long, sizes binary, data binary")
    got = made.groupBy("h").agg(F.min(F.struct("label", "count", "sizes", "data")).alias("r")).select("h", "r.*").toPandas().sort_values("h")
    kinds: list[list[Sample]] = [[], []]
    for label, count, sizes, data in zip(got["label"], got["count"], got["sizes"], got["data"], strict=True):
        ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
        kinds[label].append(Sample([bytes(data[a:b]) for a, b in zip([0, *ends], ends)], count))
    return fit(kinds[1], kinds[0], share=n1 / n if 0 < n1 < n else None)


def score_toxicity(docs: DataFrame, pairs: CompressionPairs, name: str = "toxicity") -> DataFrame:
    """docs with the column name (0 to 1; one of that name is replaced)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pairs)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(text.tolist()))

    return docs.withColumn(name, scored("text"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).where(id_crc("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(docs, train(docs, known))
    return scored.select("doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
