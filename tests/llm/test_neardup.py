"""Near-duplicate classes against all pairs of plain Python."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinelake.llm import neardup as N


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split()


def labelled(text):
    words = words_of(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    seen, out = Counter(), []
    for r in runs:
        out.append((r, seen[r]))
        seen[r] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    """By plain dynamic programming over whole texts."""
    x, y, e, f = words_of(a), words_of(b), labelled(a), labelled(b)
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < 0.8 * max(n, m) or len(set(e) & set(f)) < 0.4 * max(len(e), len(f)) - 1e-9:
        return False
    c = lcs(x, y)
    return c >= 0.8 * (n + m - c) - 1e-9


def brute(rows):
    """For each row the least doc_id of its class, by all pairs of distinct texts."""
    texts = sorted({t or "" for _, t in rows})
    root = list(range(len(texts)))
    have = defaultdict(list)
    for i, t in enumerate(texts):
        for r in labelled(t):
            have[r].append(i)
    pairs = Counter((i, j) for v in have.values() for i in v for j in v if j < i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        if find(i) != find(j) and alike(texts[i], texts[j]):
            root[find(i)] = find(j)
    place = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        r = place[t or ""]
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, least.get(place[t or ""])) for d, t in rows)


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.class_id) for r in N.op3_order_minhash(spark, sf_dir).collect())
    assert got == brute(rows)


@pytest.fixture(scope="module")
def grown(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    shared = [rnd.choice(words) for _ in range(60)]

    def add(ws, d=True):
        nonlocal i
        rows.append((i if d else None, None if ws is None else " ".join(ws)))
        i += 1

    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 120, 300]))]
        add(base)
        for _ in range(12):
            add([w if rnd.random() > rnd.choice([0.005, 0.015, 0.03]) else rnd.choice(words) for w in base])
        add(base)
        add(base[len(base) // 2 :] + base[: len(base) // 2])  # the same elements in another order
    for _ in range(60):  # a long passage in common is no near copy
        add(shared + [rnd.choice(words) for _ in range(rnd.randint(40, 90))])
    for ws in ([], [], None, ["one"], ["One"], ["one", "two"], ["x"] * 500, ["x"] * 480, ["x"] * 300):
        add(ws)
    add(["one"], False)
    add(["alone", "and", "without", "id"], False)
    return rows


@pytest.mark.parametrize("block", [2_000_000, 1_500])
def test_groups_passages_and_odd_rows(spark, grown, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_ELEMENTS", block)
    df = spark.createDataFrame(grown, "doc_id long, text string").selectExpr("*", "1 as _id", "2 as root", "'x' as n")
    rows, classes = N.near_duplicate_classes(df)
    got = Counter((r.doc_id, r.class_id) for r in rows.join(classes, "_root").collect())
    assert got == brute(grown)
    kept = N.keep_one(df).collect()
    assert Counter(r.doc_id for r in kept) == Counter({c for _, c in got}) and set(kept[0].asDict()) == {"doc_id", "text", "_id", "root", "n"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.keep_one(df).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(300):
        x, y = ([rnd.randrange(6) for _ in range(rnd.randint(1, 40))] for _ in "xy")
        a, b = np.array(x, np.uint64), np.array(y, np.uint64)
        assert N.common_length(N.places(a), len(x), b, 50) == lcs(x, y)
        c = lcs(x, y)
        assert N.similar(a, b) == (c >= 0.8 * (len(x) + len(y) - c) - 1e-9)


def edited(rnd, base, rate):
    return [f"new{rnd.random()}" if rnd.random() < rate else w for w in base]


@pytest.mark.parametrize("n,rate", [(60, 0.03), (200, 0.05), (200, 0.07), (1000, 0.05), (1000, 0.09)])
def test_recall_by_edit_rate(n, rate):
    """A sketch in common, and alike: nine in ten edited texts at least."""
    rnd, found = random.Random(n), 0
    pairs = [(base := [f"w{rnd.randrange(5000)}" for _ in range(n)], edited(rnd, base, rate)) for _ in range(100)]
    for x, y in pairs:
        e = next(N.elements([" ".join(x), " ".join(y)]))
        sk = N.sketches(e.h, e.doc, 2, N.SKETCHES)
        (a, _, p), (b, _, q) = e.sequences()
        share = len(np.intersect1d(p, q)) / max(len(p), len(q))
        found += bool((sk[0] == sk[1]).any() and share >= N.FLOOR and N.similar(a, b))
    assert found >= 90


def test_many_near_copies_are_linked_in_near_linear_time():
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(44)]
    texts = [" ".join(edited(rnd, base, 0.02)) for _ in range(16_000)]
    seqs = [s for e in N.elements(texts) for s in e.sequences()]
    began = time.time()
    none = np.zeros(len(seqs), np.int64)
    links = N.link(none, none, seqs)
    assert len(links) > 15_500 and time.time() - began < 60


def test_far_copies_of_one_text_are_counted_before_they_are_aligned(monkeypatch):
    rnd, tried = random.Random(4), []
    base = [f"w{i}" for i in range(60)]
    seqs = [s for e in N.elements([" ".join(edited(rnd, base, 0.12)) for _ in range(1500)]) for s in e.sequences()]
    plain = N.similar
    monkeypatch.setattr(N, "similar", lambda *a: tried.append(1) or plain(*a))
    none = np.zeros(len(seqs), np.int64)
    links = N.link(none, none, seqs)
    root = list(range(len(seqs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        assert find(i) != find(j)
        root[find(i)] = find(j)
    assert len(tried) < 3 * len(seqs)
    for i, j in ((rnd.randrange(1500), rnd.randrange(1500)) for _ in range(3000)):
        (x, _, e), (y, _, f) = seqs[i], seqs[j]
        if find(i) != find(j):
            assert not (plain(x, y) and len(np.intersect1d(e, f)) >= N.FLOOR * max(len(e), len(f)))
