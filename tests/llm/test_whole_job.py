"""The whole job where samples and cuts once stood in for it."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import hmm, mixing, toxicity

from .test_mix_pack import plain_rates


def kinds_of_text():
    rng = np.random.default_rng(0)
    vocabulary = ([f"toxic{i}word" for i in range(40)], [f"plain{i}text" for i in range(40)])
    return [[" ".join(rng.choice(words, 60)) for _ in range(90)] for words in vocabulary]


def test_op10_dictionaries_are_trained_on_their_own_class_alone():
    toxic, ordinary = (toxicity.sampled(texts) for texts in kinds_of_text())
    pairs = toxicity.fit(toxic, ordinary)
    assert [p for p in pairs.contents] == [(toxicity.trained(toxic, a), toxicity.trained(ordinary, b)) for a, b in toxicity.SIZES]
    p = pairs.score([*kinds_of_text()[0][:20], *kinds_of_text()[1][:20]])
    assert (p[:20] > 0.5).all() and (p[20:] < 0.5).all()


def test_op10_scores_equal_a_plain_loop_over_windows():
    toxic, ordinary = (toxicity.sampled(texts) for texts in kinds_of_text())
    pairs = toxicity.fit(toxic, ordinary)
    texts = ["", None, "One, two;  three", kinds_of_text()[0][0], "x" * 5000, kinds_of_text()[1][3] + " " + kinds_of_text()[0][1]]
    rows = []
    for t in texts:
        w = toxicity.windows([t])
        pieces, row = w.pieces(), []
        assert len(pieces) == -(-len(re.findall(r"\w+", (t or "").lower())) // toxicity.WINDOW_WORDS) == w.count[0]
        for bad, good in pairs.contents:
            a, b = toxicity.Compressor(good).own, toxicity.Compressor(bad + good).own
            s = np.array([len(a.compress(p)) - len(b.compress(p)) for p in pieces] or [0])
            best = np.minimum(np.sort(s)[-3:], 12)
            row += [np.clip(s, -4, 8).mean(), best.mean()]
            for step in toxicity.STEPS:
                row += [(s >= step).mean(), np.log1p((s >= step).sum())]
            row += [(s <= -4).mean(), (s <= -8).mean()]
        rows.append([*row, np.log(max(len(pieces), 1))])
    assert np.allclose(pairs.score(texts), pairs.probability(np.array(rows)))


def test_op10_fits_on_all_parts_of_long_texts():
    (s,) = toxicity.sampled([" ".join(f"{i}x" for i in range(100_000))])
    (short,) = toxicity.sampled(["a b c d e"])
    assert s.count == 25_000 and 0.5 * toxicity.FIT_WINDOWS < len(s.pieces) <= toxicity.FIT_WINDOWS
    last = toxicity.windows([" ".join(f"{i}x" for i in range(98_000, 100_000))]).pieces()
    assert s.pieces[-1] in last and short.count == len(short.pieces) == 2


def test_op8_trains_on_every_text_in_every_round(spark):
    rng = np.random.default_rng(0)
    # more texts than the old sample had; what a word is followed by differs between them
    texts = [" ".join(f"{'ab'[i % 2]}{(k + j) % 7}" for j in range(12)) for i, k in enumerate(rng.integers(0, 7, 1500))]
    lm = hmm.train_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    tokens, lengths, n = [], [], 0
    for c in hmm.chunks(texts):
        cls, size = hmm.class_sequences(c, lm.top)
        tokens, lengths = [*tokens, cls], [*lengths, size]
    tokens, lengths = np.concatenate(tokens), np.concatenate(lengths)
    shares = np.bincount(tokens, minlength=hmm.CLASSES) + hmm.SMOOTH
    unigram, before = shares / shares.sum(), -np.inf
    model = hmm.first_model(unigram)
    while True:
        counts = hmm.Counts.zero()
        logs = hmm.walk(tokens, lengths, model, counts).sum()
        model = hmm.maximised(counts, unigram)
        n += 1
        if logs - before < hmm.TOLERANCE * len(tokens):
            break
        before = logs
    assert n > 3
    assert np.allclose(model.move, lm.model.move, atol=1e-6) and np.allclose(model.emit, lm.model.emit, atol=1e-6)


def test_targets_are_of_domains_within_reach():
    shares = np.array([0.9, 0.1, 0.0])
    assert np.allclose(mixing.reached(np.array([0.6, 0.2, 0.2]), shares), [0.75, 0.25, 0])
    low = np.array([False, True, True])
    assert np.allclose(mixing.reached(np.array([0.985, 0.01, 0.005]), np.array([0.9, 0.004, 0.096]), low), [0.991, 0.004, 0.005])


def test_mixing_stage_meets_its_targets_without_poor_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, known = corpus_pipeline.documents(spark, sf_dir), mixing.quality_domains(corpus_pipeline.labels(spark, sf_dir))
    own = docs.join(known.where("label = 1"), "doc_id", "left_anti")  # no labelled row is poor
    rows = mixing.mixed(own, known, corpus_pipeline.TARGETS, docs, corpus_pipeline.REMOVED).select("doc_id", "__p", "__n", "__rate").collect()
    p, n, rate = (np.array([r[k] for r in rows], float) for k in ("__p", "__n", "__rate"))
    shares = lambda rate: (rate * n) @ p / n.sum()
    now, after = shares(np.ones(len(n))), shares(rate)
    want = np.minimum(now, [1, 0.01, 0.005])
    want[0] = 1 - want[1:].sum()
    # the 40 steps of the fit end a little before the plain descent's 400 do
    best = shares(plain_rates(p, n, want))
    assert np.abs(after - best).max() < 0.008 and np.abs(after - want)[:2].max() < 0.005 and (after[1:] <= now[1:] + 1e-3).all()
    poor = {r.doc_id for r, q in zip(rows, p, strict=True) if q.argmax() == 1}
    count = F.sum(F.when(F.col("doc_id").isin(list(poor)), 1).otherwise(0)) / F.count("*")
    mixed = corpus_pipeline.mix(spark, own, sf_dir)
    assert own.agg(count).first()[0] > 0.04 and mixed.agg(count).first()[0] < 0.02


def test_op4_ids_are_the_library_s_for_texts_made_to_collide_or_to_split_badly():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from kinelake.llm import tokenids, words

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library, rnd = tokenids.Encoder(path), Tokenizer.from_file(path), random.Random(1)
    one = "a"
    for _ in range(11):
        one += one.translate({97: 98, 98: 97})
    two = one.translate({97: 98, 98: 97})  # the pair that polynomial hashes modulo 2**64 can't tell apart
    data = np.frombuffer((one + " " + two).encode(), np.uint8)
    assert len(set(words.span_hashes(data, np.array([0, len(one) + 1]), np.array([len(one), len(data)])).tolist())) == 2
    texts = [one, two, "", "a <|endoftext|> b c", "x" * 100_000, *("".join(rnd.choice("ab s'é1<$#\n\t .,中|") for _ in range(rnd.randint(1, 30))) for _ in range(5000))]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_rows_of_one_doc_id_are_cut_up_in_order(spark):
    from kinelake.llm.common import ordered_parts

    rows = [(None, f"n{i}") for i in range(60)] + [(5, f"h{i}") for i in range(200)] + [(i, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for ascending in (True, False):
        part, n, cut_up = ordered_parts(df, 8, ascending)
        got = sorted((r.part, r.doc_id is not None, r.doc_id or 0, r.crc) for r in df.select(part.alias("part"), "doc_id", F.crc32(F.col("text").cast("binary")).alias("crc")).collect())
        key = (lambda r: (r[1], r[2], r[3])) if ascending else (lambda r: (not r[1], -r[2], r[3]))
        bounds = {}
        for r in got:
            bounds.setdefault(r[0], []).append(key(r))
        ordered = [bounds[p] for p in sorted(bounds)]
        assert cut_up and max(got)[0] < n and all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:]))
        assert len({r[0] for r in got if r[2] == 5}) > 4
