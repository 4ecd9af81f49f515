"""Merkle manifest, filter audit and sum-of-squares packing against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import audit, levels, manifest
from kinelake.llm.queries import QUERIES

from .test_contracts import ODD, docs_of, empty_dir, odd_dir  # noqa: F401


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """All levels of a tree, a lone node being the last."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels_, i):
    out = []
    for nodes in levels_[:-1]:
        lo = i - i % 16
        out.append((i % 16, nodes[lo:i] + nodes[i + 1 : lo + 16]))
        i //= 16
    return out


def expected(rows):
    """leaf, subroot, root, proof of (group, key, leaf) rows, sorted by them with null first."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        by[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = [tree([r[2] for r in by[g]]) for g in groups]
    over = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(by[g]):
            out.append((r[1], r[2], trees[k][-1][0], over[-1][0], siblings(trees[k], i) + siblings(over, k)))
    return out


def test_manifest_of_many_blocks_and_groups(spark):
    # one group of several blocks over many ragged partitions, groups of one row, a null group, repeated and null keys
    rows = spark.range(14_000).select(
        F.when(F.col("id") < 9_500, "hot").when(F.col("id") < 13_500, F.concat(F.lit("ü"), F.col("id") % 3)).when(F.col("id") < 13_900, F.col("id").cast("string")).alias("source"),
        F.when(F.col("id") % 1000 != 7, F.floor(F.col("id") / 2) - 3000).alias("doc_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"),
    )
    got = manifest.manifest(rows.repartition(9), F.col("h")).collect()
    want = expected([(r.source, r.doc_id, r.h) for r in rows.collect()])
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [(s.place, s.siblings) for s in r.proof]) for r in got) == sorted((str(k), h, s, t, [(i, "".join(x)) for i, x in p]) for k, h, s, t, p in want)


def test_manifest_query_folds_and_finds_tampering(spark, odd_dir, sf_dir):  # noqa: F811
    for d in (odd_dir, sf_dir):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
        leaf = {r: sha(*map(told, r)) for r in docs}
        want = Counter()
        back = defaultdict(list)
        for r in docs:
            back[r[0], leaf[r]].append(r)
        for key, h, sub, root, proof in expected([(r[1], r[0], leaf[r]) for r in docs]):
            r = back[key, h].pop()
            lower = None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
            f = sha(*map(told, (*r[:4], lower))) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 else h
            for i, s in proof:
                f = sha(*s[:i], f, *s[i:])
            want[key, h, sub, root, sha(*[x for _, s in proof for x in s]), f, f == root] += 1
        got = QUERIES["op11_merkle_manifest"](spark, d).collect()
        assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
        assert {r.verified for r in got} == {True, False} if d == sf_dir else True


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_masks(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text] = min(doc_id, least.get(text, doc_id))
    for doc_id, text, part in rows:
        w = WORD.findall(text)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > least[text]]
        yield doc_id, part, {f for f, x in zip("ABCDE", fails) if x}


def test_audit_against_every_order_by_hand(spark, odd_dir, sf_dir):  # noqa: F811
    for d in (odd_dir, sf_dir):
        rows = [(r.doc_id, r.text or "", r.lang or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()]
        said = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id is not None}
        marks = list(plain_masks(rows))
        want = {}
        for part in {p for _, p, _ in marks}:
            own = [(i, f) for i, p, f in marks if p == part]
            shapley = Counter()
            for order in map("".join, permutations("ABCDE")):
                for k, x in enumerate(order):
                    out = [(i, f) for i, f in own if x in f and not f & set(order[:k])]
                    shapley[x] += len(out)
                    want[part, order, k + 1] = [
                        sum(not f & set(order[: k + 1]) for _, f in own), len(out), sum(x in f and bool(f & set(order[:k])) for _, f in own), sum(f == {x} for _, f in own),
                        sum(i in said and said[i].quality == 1 for i, _ in out), sum(i in said and said[i].toxic == 1 for i, _ in out),
                    ]
            for (p, order, k), v in want.items():
                if p == part:
                    v.append(shapley[order[k - 1]])
        got = QUERIES["op12_filter_audit"](spark, d).collect()
        assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


@pytest.mark.parametrize("first, hashed", [(256, F.xxhash64), (3, F.xxhash64), (3, lambda c: F.lit(1)), (2, lambda c: F.xxhash64(c) % 2)])
def test_repeats_are_exact_whatever_the_hash(spark, first, hashed):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab😀") for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))) for _ in range(60)]
    rows = [(i if i % 11 else None, rng.choice(texts) if i % 13 else None) for i in range(300)] + [(5, "twice"), (5, "twice"), (6, "twice")]
    got = audit.with_repeats(spark.createDataFrame(rows, "doc_id long, text string"), {"text": F.coalesce("text", F.lit(""))}, first, hashed).collect()
    rows = [(i, t or "") for i, t in rows]
    least = {}
    for i, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert Counter((r.doc_id, r.text, r.repeated) for r in got) == Counter((i, t, i is not None and i > least[t]) for i, t in rows)


def test_levels_are_those_of_least_squares():
    rng = random.Random(1)
    own, count = levels.Levels(30), [0] * 31
    for _ in range(2000):
        s = rng.choice([1, 2, 3, 7, 11, 15, 29, 30])
        best = None
        for h in range(31 - s):
            if h and not count[h]:
                continue
            after = list(count)
            after[h] -= h > 0
            after[h + s] += h + s < 30
            squares = sum(x * x for x in after)
            if best is None or squares <= best[0]:
                best = squares, h, after
        _, offset = own.place(s)
        assert offset == best[1]
        count = best[2]
    assert Counter(h for _, h in own.open()) == {h: n for h, n in enumerate(count) if n}


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_word_parts_have_the_ids_of_whole_texts():
    path, tok = _library()
    rng = random.Random(5)
    bits = ["don't", "it's", "x,y", "A1b2", "...", "'", "' s", "é", "é", "Σας", " ", "\x85", " ", "\n", "<|endoftext|>", "<|endof", "≠", "中文", "😀", "'LL", "ab", "#$", "​", "\x1c", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    own = levels.WordEncoder(path, 500)
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def check_pieces(rows, docs, size=4096):
    _, tok = _library()
    want = Counter()
    ids_of = {}
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        ids_of.setdefault(doc_id, []).append(ids)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in ids_of[r.doc_id])
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    # each id of each row in exactly one piece
    cover = Counter((r.doc_id, r.doc_tokens, p) for r in rows for p in range(r.start, r.start + r.length))
    many = Counter((d, n) for (d, n, _), k in want.items() for _ in range(k))
    assert cover == Counter({(d, n, p): k for (d, n), k in many.items() for p in range(n)})
    return len(by), sum(len(x) for v in ids_of.values() for x in v)


def test_packing_keeps_every_id_once_with_little_padding(spark, sf_dir, odd_dir):  # noqa: F811
    for d in (sf_dir, odd_dir):
        rows = QUERIES["op13_sum_of_squares"](spark, d).collect()
        n, tokens = check_pieces(rows, docs_of(spark, d))
        assert n == -(-tokens // 4096)  # one group: only its last window is padded


def test_packing_over_partitions_and_groups(spark):
    path, _ = _library()
    rng = random.Random(2)
    docs = [(i % 90, " ".join(rng.choice(["red", "arm", "cup", "moves"]) for _ in range(rng.choice([0, 3, 8, 20, 31, 70])))) for i in range(400)]
    made = levels.pack_levels(spark.createDataFrame(docs, "doc_id long, text string").repartition(10), path, size=32, group=3)
    n, tokens = check_pieces(made.collect(), docs, 32)
    assert n <= tokens / 32 + 4


def test_empty_texts_are_their_end(spark):
    path, _ = _library()
    rows = levels.pack_levels(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1), path).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in sorted(rows)] == [(1, 0, 1, 1), (2, 0, 1, 1)]
    assert {r.ids_crc32 for r in rows} == {zlib.crc32(np.array([2], "<u4").tobytes())}
    assert len(ODD) > 0
