"""The queries' results against plain Python over all rows of the smallest tables, and over awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinelake.llm import hmm, media, tokenids
from kinelake.llm.queries import QUERIES

ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (None, "no id here\nat all", None, None, 17),
    (None, "no id here\nat all", None, None, 17),
    (3, "ÄÖ  x\x85y z\n\n\tend ", "de", "b", 18),
    (4, "short", "en", "a", 5),
    (5, "short", "en", "a", 5),
    (5, "same id, other text", "en", "a", 19),
    (6, "中文 text 😀 <|endoftext|> 's x  's", "zh", "c", 10),
    (7, "word " * 30_000, "en", "a", 150_000),
    (9_007_199_254_740_993, "a great id", "en", "a", 10),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"
    spark.createDataFrame([(*r, 0.5, 1) for r in ODD], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def docs_of(spark, d):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def fold(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_odd_tables(spark, name, empty_dir, odd_dir):
    assert QUERIES[name](spark, empty_dir).count() == 0
    rows = QUERIES[name](spark, odd_dir).collect()
    if name == "op12_filter_audit":  # counts by part
        assert {r.part for r in rows} == {r[2] or "" for r in ODD}
    else:
        assert {r.doc_id for r in rows} == {r[0] for r in ODD}


def test_op4_files_give_back_the_ids(spark, sf_dir, odd_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in (sf_dir, odd_dir):
        got = {}
        for r in QUERIES["op4_packed_ids"](spark, d).collect():
            got.setdefault(r.doc_id, []).append(r)
        start = 0
        rows = sorted(docs_of(spark, d), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
        for doc_id, text in rows:
            ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
            r = next(r for r in got[doc_id] if r.start == start)
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert sum(map(len, got.values())) == len(rows)


def test_op4_packing_round_trips_at_any_width():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 8, 13, 16, 17, 24, 31, 32):
        a = rng.integers(0, 1 << bits, 999).astype("<u4")
        data = tokenids.pack(a, bits)
        assert len(data) == -(-999 * bits // 8)
        assert (tokenids.unpack(data, bits, 0, 999) == a).all() and (tokenids.unpack(data, bits, 123, 7) == a[123:130]).all()


def test_op6_reads_back_what_it_stored(spark, sf_dir, odd_dir):
    for d in (sf_dir, odd_dir):
        want = Counter()
        for doc_id, text in docs_of(spark, d):
            raw = text.encode()
            p = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
            want[doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
        rows = QUERIES["op6_avi_clips"](spark, d).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def _baseline_jpeg(pixels, quality_step=1, restart=0, standard=True):
    """A plain encoder of grey pictures, a symbol at a time, with the standard tables."""
    h, w = pixels.shape
    codes = {}
    for kind, text in (("dc", media.STANDARD_DC[0]), ("ac", media.STANDARD_AC[0])):
        raw = bytes.fromhex(text)
        codes[kind] = {v: (c, n) for v, c, n in media._codes(raw[:16], raw[16:] if kind == "ac" else bytes(range(12)))}
    seg = lambda k, b: bytes([255, k]) + (len(b) + 2).to_bytes(2, "big") + b
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [quality_step] * 64)) + seg(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00")
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    head += seg(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    basis = media._basis()
    padded = np.pad(pixels.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    out, bits, pred, n = b"", "", 0, 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def value(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            if restart and n and n % restart == 0:
                out += flush(bits) + bytes([255, 0xD0 + (n // restart - 1) % 8])
                bits, pred = "", 0
            n += 1
            coef = np.rint(basis @ padded[y : y + 8, x : x + 8] @ basis.T / quality_step).astype(int).ravel()[media.ZIGZAG].tolist()
            s, extra = value(coef[0] - pred)
            pred = coef[0]
            c, k = codes["dc"][s]
            bits += format(c, f"0{k}b") + extra
            run = 0
            last = max((i for i in range(1, 64) if coef[i]), default=0)
            for i in range(1, last + 1):
                if not coef[i]:
                    run += 1
                    continue
                while run > 15:
                    c, k = codes["ac"][0xF0]
                    bits += format(c, f"0{k}b")
                    run -= 16
                s, extra = value(coef[i])
                c, k = codes["ac"][run << 4 | s]
                bits += format(c, f"0{k}b") + extra
                run = 0
            if last < 63:
                c, k = codes["ac"][0]
                bits += format(c, f"0{k}b")
    return head + out + flush(bits) + b"\xff\xd9"


def test_op6_decodes_frames_with_detail_and_finds_the_cut(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:45, 0:70]
    scenes = [(x * 2 + y) % 160 + rng.integers(0, 3, (45, 70)), 255 - (x + y * 2) % 90 - rng.integers(0, 3, (45, 70))]
    pictures = [scenes[t >= 20].astype(np.uint8) for t in range(30)]
    for restart in (0, 1, 5):
        frames = [_baseline_jpeg(p, 1, restart) for p in (pictures[0], pictures[25])]
        got = media.decode_pixels(frames)
        assert max(np.abs(g[:, :, 0].astype(int) - p).max() for g, p in zip(got, (pictures[0], pictures[25]), strict=True)) <= 2
    film = media.write_avi([_baseline_jpeg(p, 2) for p in pictures], 70, 45, 10)
    avi = media.read_avi(film)
    assert (avi.width, avi.height, avi.fps, len(avi.frames)) == (70, 45, 10.0, 30)
    no_index = film[: film.rfind(b"idx1")]
    assert [f[:2] for f in media.read_avi(no_index).frames] == [f[:2] for f in avi.frames]
    df = spark.createDataFrame([(1, bytearray(film)), (2, None), (3, bytearray(b"RIFF....")), (4, bytearray(film[:-700]))], "id int, media binary")
    rows = [r.asDict() for r in media.clips(df).where("id = 1").orderBy("clip").collect()]
    assert [(r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]) for r in rows] == [(0, 20, 0.0, 2.0), (20, 10, 2.0, 3.0)]
    assert {r.id for r in media.clips(df).collect()} == {1, 4}


def test_op7_edited_texts_and_likeness(spark, sf_dir, odd_dir):
    for d in (sf_dir, odd_dir):
        rows = sorted(docs_of(spark, d), key=lambda r: (r[0] is None, -(r[0] or 0), zlib.crc32(r[1].encode())))
        want = Counter()
        for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            k = len(text) // 2
            want[doc_id, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()] += 1
        got = QUERIES["op7_paragraph_multiset_hash"](spark, d).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert all((r.fingerprint != r.edited_fingerprint) or r.near_edited == 1 for r in got)
    assert np.mean([r.near_edited > r.near_next for r in QUERIES["op7_paragraph_multiset_hash"](spark, sf_dir).collect()]) > 0.9


def test_op8_base_and_model_scores(spark, sf_dir, odd_dir):
    for d in (sf_dir, odd_dir):
        docs = docs_of(spark, d)
        words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
        c = Counter(w for i, t in docs if fold(i, 10) for w in words(t))
        n, v = sum(c.values()), len(c)
        want = sorted((i is None, i or 0, len(w := words(t)), sum(x in c for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, t in docs)
        got = QUERIES["op8_hidden_markov"](spark, d).collect()
        have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got)
        assert [w[:4] for w in want] == [h[:4] for h in have] and np.allclose([w[4] for w in want], [h[4] for h in have], rtol=1e-9, atol=1e-4)
        assert all(r.train_tokens == n and r.held_out == (fold(r.doc_id, 10) == 0) for r in got)


def test_op8_recursion_matches_plain_forward_backward(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    rng = np.random.default_rng(1)
    m = hmm.first_model(np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    lengths = np.array([1, 3, 7, 8, 20, 33, 14, 50])
    tokens = rng.integers(0, hmm.CLASSES, lengths.sum())
    got, want, logs = hmm.Counts.zero(), hmm.Counts.zero(), []
    for seq in np.split(tokens, np.cumsum(lengths)[:-1]):
        t = len(seq)
        a, b = np.zeros((t, hmm.STATES)), np.ones((t, hmm.STATES))
        a[0] = m.start * m.emit[:, seq[0]]
        for i in range(1, t):
            a[i] = (a[i - 1] @ m.move) * m.emit[:, seq[i]]
        for i in range(t - 2, -1, -1):
            b[i] = m.move @ (m.emit[:, seq[i + 1]] * b[i + 1])
        p = a[-1].sum()
        logs.append(math.log(p))
        want.start += a[0] * b[0] / p
        for i in range(t):
            want.emit[:, seq[i]] += a[i] * b[i] / p
            if i:
                want.move += a[i - 1][:, None] * m.move * (m.emit[:, seq[i]] * b[i])[None] / p
    assert np.allclose(hmm.walk(tokens, lengths, m, got), logs) and np.allclose(hmm.walk(tokens, lengths, m), logs)
    assert np.allclose(got.flat(), want.flat())


def test_op9_key_law(spark, sf_dir, odd_dir):
    for d in (sf_dir, odd_dir):
        docs = docs_of(spark, d)
        rows = QUERIES["op9_rendezvous_shards"](spark, d).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs)
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in rows)


@pytest.mark.parametrize("name,column,m,k", [("op1_quality_fm", "quality", 3, 1), ("op10_compression_toxicity", "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, name, column, m, k):
    d = "/root/testdata/sf0.01"
    label = {r.doc_id: r[column] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, d).collect() if r.doc_id in label]
    assert all(r.held_out == (fold(r.doc_id, m) == k) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in rows if r.held_out]) > 0.9


def test_op7_takes_the_least_and_the_greatest_id(spark):
    from kinelake.llm import fingerprint

    rows = [(-(1 << 63), "least id here"), (0, "zero"), ((1 << 63) - 1, "greatest"), (None, "none at all")]
    got = {r.doc_id: r for r in fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [(1 << 63) - 1, 0, -(1 << 63), None]
    text = dict(rows)
    for i, d in enumerate(order):
        after = text[order[(i + 1) % 4]]
        t = text[d]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_op8_recursion_of_rare_classes_stays_a_number():
    """Emissions of 1e-9 and less over many segments: single precision has no such products."""
    rng = np.random.default_rng(4)
    emit = np.full((hmm.STATES, hmm.CLASSES), 1e-12)
    emit[:, :7] = rng.dirichlet(np.ones(7), hmm.STATES)
    emit[:, 100:200] = 10.0 ** rng.uniform(-12, -8, (hmm.STATES, 100))
    model = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit / emit.sum(1, keepdims=True))
    lengths = np.array([3000, 1, 255, 256, 257, 900, 40])
    tokens = np.where(rng.random(lengths.sum()) < 0.7, rng.integers(100, 200, lengths.sum()), rng.integers(0, 7, lengths.sum()))
    counts = hmm.Counts.zero()
    fitted, scored = hmm.walk(tokens, lengths, model, counts), hmm.walk(tokens, lengths, model)
    assert np.isfinite(counts.flat()).all() and np.allclose(fitted, scored, rtol=1e-5)
    assert np.isclose(counts.start.sum(), len(lengths), rtol=1e-4) and np.isclose(counts.emit.sum(), lengths.sum(), rtol=1e-4) and np.isclose(counts.move.sum(), lengths.sum() - len(lengths), rtol=1e-4)
    # the likelihood by one plain pass
    for text, want in zip(np.split(tokens, np.cumsum(lengths)[:-1]), scored, strict=True):
        v, logs = model.start * model.emit[:, text[0]], 0.0
        for c in text[1:]:
            logs += math.log(v.sum())
            v = (v / v.sum()) @ model.move * model.emit[:, c]
        assert np.isclose(logs + math.log(v.sum()), want, rtol=1e-9)
