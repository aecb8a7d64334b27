"""Whitening, hard negatives and the subword lattice against brute force, with nulls, ties, repeated rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from podium.llm import lattice, lm, negatives, vectors, whitening
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, n string, score string"
ODD = [(None, [0.5, 0.25, -0.5, 0.125], 1), (900, None, 1), (901, [0.1, None, 0.2, 0.3], 1), (902, [0.1, float("nan"), 0.2, 0.3], 2), (903, [float("inf"), 0.0, 0.0, 0.0], 2), (904, [0.5, 0.25], 3), (905, [], 1)]


def rows(seed=1, n=160, dim=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * [0.5, 0.3, 0.2, 0.1]
    v[n // 2 : n // 2 + 30] = v[3]  # a large group of copies
    out = [(i, x, i % 3 if i % 11 else None) for i, x in enumerate(v.tolist())]
    return [(*r, "x", "y") for r in [*out, *ODD, out[5], out[50]]]


def usable(data, dim=4):
    """(row, id, label, x) of the rows that take part."""
    out = []
    for k, (i, v, label, *_) in enumerate(data):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((k, i, label, [math.floor(256 * c) for c in v] + [0] * (dim - len(v))))
    return out


def test_whitening(spark):
    data = rows()
    got = whitening.whiten_embeddings(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    x = np.array([r[3] for r in usable(data)])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = (x - sums / n) @ u / np.sqrt(e)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    by_row = sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.whitened, r.deviation) for r in got)
    signs = np.ones(4)
    ids = [-1 if r[1] is None else r[1] for r in usable(data)]
    for c in range(4):
        a = np.array([w for _, k, w, _ in by_row if k == c + 1])
        b = np.array([w for _, w in sorted(zip(ids, want[:, c]))])
        signs[c] = np.sign(a @ b)
        assert np.allclose(a, signs[c] * b, atol=1e-9)
    assert sorted(d for _, c, _, d in by_row if c == 1) == sorted(deviation.tolist())
    assert {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    for r in got:
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12


def test_whitening_of_few_rows(spark):
    of = lambda data: whitening.whiten_embeddings(spark.createDataFrame([(i, v, 1, "x", "y") for i, v in data], SCHEMA)).collect()
    assert of([]) == [] and of([(1, [0.5, 0.5])]) == [] and of([(1, [0.5]), (2, [0.5])]) == [] and of([(1, []), (2, [])]) == []
    two = of([(1, [0.5, 0.25]), (2, [0.25, 0.5]), (2, [0.25, 0.5])])  # one component only, copies answered too
    assert [r.component for r in two] == [1, 1, 1] and sorted(abs(round(r.whitened, 9)) for r in two) == [1.0] * 3


def test_exact_sums_beyond_long():
    x = np.array([[2**61, -5], [2**61, 7], [2**61, 1]])
    assert vectors.exact_sums(x).tolist() == [3 * 2**61, 3]
    assert vectors.square_sums(vectors.numerators(x, 3, [3 * 2**61, 3])).tolist() == [18**2, 18**2, 0]
    assert vectors.inner(x, x).tolist()[0] == 2**63 - 1


def mined(data, anchors, positives=5, count=3):
    part = [(k, i, label, np.array(x, object)) for k, i, label, x in usable(data) if label is not None]
    order = lambda pair: (-pair[0], pair[1][1] is None, pair[1][1] or 0, pair[1][0])
    out = []
    for a in part:
        if a[1] is None or not anchors(a[1]):
            continue
        met = sorted(((int(a[3] @ r[3]), r) for r in part if r[0] != a[0]), key=order)
        for p, row in [m for m in met if m[1][2] == a[2]][:positives]:
            hard = [m for m in met if m[1][2] != a[2] and 50 * p <= 100 * m[0] <= 95 * p][:count]
            out += [(a[1], row[1], k, r[1], p, s) for k, (s, r) in enumerate(hard, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [8192, 3])
def test_hard_negatives(spark, block):
    data = rows(4)
    got = negatives.mine_hard_negatives(spark.createDataFrame(data, SCHEMA).repartition(4), F.col("vec_id") % 5 == 0, block=block).collect()
    assert sorted(str((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in got) == mined(data, lambda i: i % 5 == 0)
    assert len(got) > 50


def test_hard_negatives_of_few_rows(spark):
    of = lambda data: negatives.mine_hard_negatives(spark.createDataFrame([(i, v, x, "x", "y") for i, v, x in data], SCHEMA), F.col("vec_id") % 5 == 0).count()
    assert of([]) == 0 and of([(5, [0.5], 1)]) == 0 and of([(5, [], 1), (6, [], 1), (7, [], 2)]) == 3 - 2
    assert of([(5, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [0.9, 0.0], 2), (8, [0.96, 0.0], 2)]) == 1


def test_hard_negatives_with_bounds_over_many_chunks():
    """Copies and ties far beyond what is kept, in small chunks: the bounds leave no answer out."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (400, 8))
    x[100:220] = x[7]
    rotation = negatives.Rotation(np.linalg.qr(rng.normal(size=(8, 8)))[0])
    label, ids = rng.integers(0, 2, 400), rng.permutation(400) // 2
    a = negatives.Anchors(np.arange(20), label[:20], x[:20], np.full((20, 1), -(2**62)), np.full((20, 1), 2**62))
    best = negatives._Best(a, rotation, 5)
    for at in range(0, 400, 16):
        own = slice(at, at + 16)
        best.meet(x[own], label[own], ids[own], np.arange(400)[own], rotation.turn(x[own]), rotation.steps, True)
    for k in range(20):
        want = sorted((-int(x[k] @ x[r]), ids[r], r) for r in range(400) if r != k and label[r] == label[k])[:5]
        assert [(-s, i) for s, i in zip(best.score[k, 0], best.id[k, 0])] == [(s, i) for s, i, _ in want]


PIECES = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b" ", b" a", b" ab", b"\x00"]


def ways(word, weight):
    """Every segmentation, with its weight."""
    if not word:
        return [(1.0, [])]
    return [(math.exp(weight[i]) * v, [i, *s]) for i, p in enumerate(PIECES) if word.startswith(p) for v, s in ways(word[len(p) :], weight)]


@pytest.mark.parametrize("long", [64, 3])
def test_lattice_sums_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(lattice, "LONG", long)
    rng, weight = random.Random(1), np.log(np.random.default_rng(0).random(len(PIECES)))
    words = [bytes(rng.choices(b"abc", k=rng.randrange(0, 11))) for _ in range(120)] + [b" abc", b"x", b"axb", b"\x00a"]
    counts, want = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    got = lattice.log_sums(words, lattice.Pieces(PIECES), weight, counts)
    for word, g in zip(words, got):
        all_ways = ways(word, weight)
        total = sum(v for v, _ in all_ways)
        assert g == (pytest.approx(math.log(total), abs=1e-9) if total else -math.inf)
        for v, s in all_ways:
            for i in s:
                want[i] += v / total
    assert np.allclose(counts, want, atol=1e-9)


def test_long_words_need_little_time():
    word = bytes(random.Random(2).choices(b"abc", k=120_000))
    weight = np.log(np.full(len(PIECES), 0.1))
    halves = lattice.log_sums([word], lattice.Pieces([b"a", b"b", b"c"]), weight[:3])
    assert halves[0] == pytest.approx(120_000 * math.log(0.1))
    assert lattice.log_sums([word], lattice.Pieces(PIECES), weight)[0] > halves[0]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(6)
    words = ["the", "of", "cat", "Cats", "DOG", "dogs", "naïve", "x" * 70, "İ"]
    out = [(i, " ".join(rng.choices(words, weights=[40, 20, 5, 5, 5, 5, 2, 1, 1], k=rng.randrange(0, 60)))) for i in range(200)]
    return [*out, (500, None), (501, ""), (502, " \n\t"), (503, "unseen" * 20 + " zzz\x0b qq"), (out[3]), (None, "the cat"), (504, "the " * 50_000)]


def test_lm_scores(spark):
    pieces = [bytes([b]) for b in range(256)] + [b" the", b" ca", b"ts", b"dog", b" d", b"og"]
    data = texts()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in data], "doc_id long, text string, row string, n string").repartition(3)
    train, ends = Counter(), 0
    for i, t in data:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            train.update(WORD.findall((t or "").translate(LOWER)))
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    one, two = sum(c == 1 for c in train.values()), sum(c == 2 for c in train.values())
    discount = one / (one + 2 * two) if one and two else 0.5
    known = spark.createDataFrame([(w,) for w in train], "word string")
    weight = lm.fit_weights(known, pieces, True)
    sums = lattice.log_sums([b" " + w.encode() for w in train], lattice.Pieces(pieces), weight[:-1])
    assert abs(np.exp(weight).sum() - 1) < 1e-9 and np.isfinite(sums).all()

    def score(w):
        c = ends if w is None else train[w]
        lat = weight[-1] if w is None else lattice.log_sums([b" " + w.encode()], lattice.Pieces(pieces), weight[:-1])[0]
        own = max(c - discount, 0) / n
        return math.log10((c + 0.1) / (n + 0.1 * (v + 1))), math.log10(own + discount * v / n * math.exp(lat)) if own or lat > -600 else math.log10(discount * v / n) + lat / math.log(10)

    cache = {w: score(w) for w in {None, *(w for _, t in data for w in WORD.findall((t or "").translate(LOWER)))}}
    for frequent in (20_000, 3):  # nearly all words sent to tasks; nearly all looked up by a join
        got = lm.score_documents(docs, pieces, frequent=frequent).collect()
        assert len(got) == len(data)
        want = []
        for i, t in data:
            words = [*WORD.findall((t or "").translate(LOWER)), None]
            seen = sum(w is None or train[w] > 0 for w in words)
            want.append((i is None, i or 0, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(words), seen, n, *[round(sum(cache[w][k] for w in words), 4) for k in (0, 1)]))
        mine = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got]
        for a, b in zip(sorted(mine), sorted(want), strict=True):
            assert a[:6] == b[:6] and abs(a[6] - b[6]) < 1e-3 + 1e-9 * abs(b[6]) and abs(a[7] - b[7]) < 1e-3 + 1e-9 * abs(b[7])
    assert lm.score_documents(docs.limit(0), pieces).count() == 0
    alone = lm.score_documents(docs.where("doc_id is null"), pieces).first()  # nothing to learn from
    assert alone.held_out and alone.train_tokens == 0 and alone.score < 0 and alone.base_score == 0


def test_lm_prefers_text_like_what_it_learned(spark):
    """Held-out texts of known syllables in new orders get more than shuffled letters, and known words more than either."""
    rng = random.Random(9)
    syllables = ["ing", "er", "tion", "an", "the", "ou"]
    invent = lambda: "".join(rng.choices(syllables, k=3))
    data = [(i, " ".join(["the", *(invent() for _ in range(30))])) for i in range(1, 120)]
    held = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 10 == 0]
    probe = list(zip(held, ["theanou ingertion tionthean", "hteaoun gniretion ntoihetan", "the the the"]))
    docs = spark.createDataFrame(data + probe, "doc_id long, text string")
    import public_tokenizers

    pieces = lm.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.score for r in lm.score_documents(docs, pieces).collect()}
    assert got[held[2]] > got[held[0]] > got[held[1]]
