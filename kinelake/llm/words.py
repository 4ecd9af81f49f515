"""Vectorised word hashing: whole batches of texts as numpy arrays, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Places in a word that have random numbers of their own for each byte; later ones mix them with how often they came round.
_PLACES = 64


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), seeded."""
    h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_NUMBERS = mix(np.arange(_PLACES * 256, dtype=np.uint64), 21)


def _byte_numbers(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each byte and its place in its span. Sums of them are hashes without algebraic structure to collide by."""
    v = _NUMBERS[(place & (_PLACES - 1)) * 256 + data]
    late = np.flatnonzero(place >= _PLACES)
    if len(late):
        v[late] = mix(v[late] + (place[late] // _PLACES).astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 22)
    return v


@dataclass
class Chunk:
    """Texts lo to hi of a batch: each word's hash and text (counted from lo), and the bytes themselves."""

    lo: int
    hi: int
    word: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    doc_start: np.ndarray
    doc_end: np.ndarray


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which ascend, don't overlap and aren't empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    v = _byte_numbers(data[place + np.repeat(start, size)], place)
    return mix(np.add.reduceat(v, begin) + size.astype(np.uint64))


def prefix_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each byte of spans of these sizes, one after the other in data, a hash of its span up to and with it."""
    begin = np.cumsum(size) - size
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_numbers(data, np.arange(len(data)) - np.repeat(begin, size)))])
    return mix(total[1:] - np.repeat(total[begin], size))


def byte_chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters, a longer text by itself."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(texts) > lo:
        yield lo, len(texts)


def chunks(texts: Sequence[str | None], lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts (null: empty) by chunks of about limit bytes; words are what ASCII white space separates."""
    held: list[bytes] = []
    lo = size = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and size + len(b) > limit:
            yield _chunk(held, lo, lower)
            held, lo, size = [], i, 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield _chunk(held, lo, lower)


def _chunk(held: list[bytes], lo: int, lower: bool) -> Chunk:
    raw = b"\n".join(held) + b"\n"
    data = np.frombuffer(raw.translate(_LOWER) if lower else raw, np.uint8)
    ends = np.cumsum([len(b) + 1 for b in held]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(ends, start).astype(np.int64)
    return Chunk(lo, lo + len(held), span_hashes(data, start, end), doc, start, end, data, starts, ends)


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, with their texts; a shorter text is one shingle of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    run = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.repeat(counts, counts)
    h = word.copy()
    for j in range(1, k):
        more = run + j < length
        nxt = np.zeros_like(word)
        nxt[: max(len(word) - j, 0)] = word[j:]
        h = np.where(more, h * np.uint64(0x100000001B3) + nxt, h)
    keep = (run + k <= length) | ((length < k) & (run == 0))
    return mix(h[keep], k), doc[keep]
