"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from podium.llm import fingerprints, html, lines, minhash, mixing, near, packing, quality, substrings, toxicity, urls
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string, label string"


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        rows.append([rng.choice(words) for _ in range(rng.choice([3, 20, 60, 120]))])
    for i in range(25):
        copy = list(rows[i % 8])
        copy[rng.randrange(len(copy))] = "edit"
        rows.append(copy)
    shared = [rng.choice(words) for _ in range(30)]
    texts = [" ".join(w if rng.random() > 0.1 else w + "\n" for w in r) for r in rows]
    texts += [" ".join(["x", *shared, "y"]), " ".join(shared), "", " \n\t ", "é" * 5000, "one", "one two", "One TWO", texts[0]]
    out = [(i, t, f"s{i % 4}" if i % 9 else None, "old", "old") for i, t in enumerate(texts)]
    return [*out, (1000, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(spark, docs):
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    first = {}
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_minhash(spark, docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 3, 85).collect()}
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        return i if top[i] == i else find(top[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_dedup_null_and_repeated_ids(spark):
    """Rows are what is compared: null doc_id, several texts under one doc_id, repeated rows."""
    import corpus_pipeline

    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (7, b), (7, c), (7, c), (3, c + " end"), (None, d), (None, d + " end"), (9, b), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    out = minhash.near_duplicates(docs, 5, 80).collect()
    assert Counter((r.doc_id, r.component_id) for r in out if r.n_shingles) == Counter({(None, None): 3, (7, 7): 1, (7, 3): 2, (3, 3): 1, (9, 7): 1})
    assert len(out) == len(rows) and sum(r.kept for r in out) == 7
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got.total() == 7 and got[None, a] == got[7, b] == got[3, c + " end"] == got[None, None] == 1 and got[5, ""] == 2
    assert got[None, d] + got[None, d + " end"] == 1


@pytest.mark.parametrize(("most", "exact"), [(200, True), (3, True), (200, False)])
def test_settle(spark, most, exact):
    """All links across components of open buckets are among the pairs, by comparison of small parts or by rare elements."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 10**9, 40) for _ in range(6)]
    sets = {i: {*base[i % 6][: 40 - i % 9].tolist(), *rng.integers(0, 10**9, i % 5).tolist()} for i in range(150)}
    store = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    rows = spark.createDataFrame([(k, i, i) for i in sets for k in (0, i % 6)], "bucket long, id long, component long")

    def elements(ids, store):
        return store.join(ids, "id", "left_semi").select("id", F.explode("s").alias("s"))

    known = store.select("id", F.explode("s").alias("s")).groupBy("id").agg(F.count("*").alias("n"), F.array(*near.sketch_words(F.col("s"), 2)).alias("words"))
    sets_ = near.Sets(None, elements, 80, 2, exact, most)
    pairs = {(r.a, r.b) for r in near.settle(rows.distinct(), store, known, sets_).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= pairs and len(pairs) < 6 * len(links)
    assert {(r.a, r.b) for r in sets_.likely(spark.createDataFrame(sorted(pairs | links), "a long, b long"), known).collect()} >= links


@pytest.mark.parametrize(("most", "parity"), [(200, True), (3, True), (200, False), (3, False)])
def test_settle_near_group(spark, monkeypatch, most, parity):
    """A group whose members share most elements without being links: they don't meet, real links among them do."""
    rng = np.random.default_rng(5)
    passage = rng.integers(-(2**62), 2**62, 40).tolist()
    sets = {i: {*passage, *rng.integers(-(2**62), 2**62, 7).tolist()} for i in range(60)}
    sets |= {100 + i: {*sorted(sets[i])[1:], 7} for i in range(0, 60, 10)}
    store = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    rows = spark.createDataFrame([(k, i, i) for i in sets for k in (0, 1)], "bucket long, id long, component long")

    def words(s):
        at = Counter((e >> 6) % 32 * 64 + e % 64 for e in s)
        bits = sum(1 << k for k, n in at.items() if n % 2 or not parity)
        return [w - (1 << 64) if w >> 63 else w for w in (bits >> 64 * i & (1 << 64) - 1 for i in range(32))]

    known = spark.createDataFrame([(i, len(s), words(s)) for i, s in sets.items()], "id long, n long, words array<long>")
    elements = lambda ids, store: store.join(ids, "id", "left_semi").select("id", F.explode("s").alias("s"))
    met, real = [], near._strangers_met
    monkeypatch.setattr(near, "_strangers_met", lambda *a: (met.append(real(*a)), met[-1])[1])
    pairs = {(r.a, r.b) for r in near.settle(rows, store, known, near.Sets(None, elements, 80, 32, True, most, **({"parity": True} if parity else {}))).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) == 6 and links <= pairs and len(pairs) < 60
    assert sum(m.count() for m in met) < 600  # all pairs of a bucket: 2145


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert got[0].source is None and not got[1000].kept
    rng = random.Random(1)
    plain = " ".join("".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 8))) for _ in range(300))
    flat = spark.createDataFrame([(1, "spam eggs " * 400), (2, plain)], "doc_id long, text string").withColumn("a.b", F.lit(1))
    kept = quality.keep_quality(flat)
    assert kept.columns == flat.columns and [r.doc_id for r in kept.collect()] == [2]
    assert quality.score_quality(empty(spark)).count() == 0


def quality_by_hand(text):
    """Counts and verdict of one text, as the rules say, one at a time."""
    import math

    import zstandard

    b, w = quality.Bands(), WORD.findall(text or "")
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    data = (text or "").encode()
    n = len(data)
    press = lambda x: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x)) / len(x)
    ok = True
    if n >= b.knots[0]:
        k = max(i for i, x in enumerate(b.knots) if x <= n)
        share = (math.log(n) - math.log(b.knots[k])) / (math.log(b.knots[k + 1]) - math.log(b.knots[k])) if k + 1 < len(b.knots) else 0
        limit = lambda v: v[k] + share * (v[min(k + 1, len(v) - 1)] - v[k])
        ok = limit(b.whole_low) <= press(data) <= limit(b.whole_high)
        if n >= 2 * b.chunk_bytes:
            at = sorted({*range(0, n - b.chunk_bytes + 1, b.chunk_bytes), n - b.chunk_bytes})
            each = [press(data[x : x + b.chunk_bytes]) for x in at]
            ok &= sum(x < b.chunk_low for x in each) <= len(each) * b.chunk_share >= sum(x > b.chunk_high for x in each)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed, not failed and ok


def test_quality_bands(spark):
    """Junk that passes the base rules is rejected by the bands, prose stays; all columns as by hand."""
    rng = random.Random(12)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    vocabulary = ["".join(rng.choices(letters, [26 - i for i in range(26)], k=rng.randint(2, 9))) for _ in range(3000)]
    prose = [" ".join(rng.choices(vocabulary, k=n)) for n in (60, 200, 500, 1500, 4000)]
    listed = [" | ".join(rng.choice(vocabulary[:n]) + rng.choice("#$%&") * 3 for _ in range(n)) for n in (200, 500, 1500)]
    noise = ["".join(rng.choices("".join(map(chr, range(33, 127))), k=8 * n)) for n in (1000,)]
    noise = [" ".join(x[i : i + 8] for i in range(0, len(x), 8)) for x in noise]
    lines_ = "\n".join(["the same line", *prose[1].split("\n"), "the same line", "a < b | c", "", " ", "the same line"])
    long = " ".join(rng.choices(vocabulary, k=150_000))
    texts = [*prose, *listed, *noise, lines_, long, None, "", " \n", "é" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.score_quality(rows.unionAll(rows)).collect()}
    assert got == {i: quality_by_hand(t) for i, t in enumerate(texts)}
    assert all(got[i][6] for i in range(5)) and not any(got[i][6] for i in range(5, 9)) and not any(got[i][5] for i in range(5, 9))


def test_packing(spark, docs):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in corpus()}
    sequences, total = defaultdict(list), Counter()
    for r in packing.pack_documents(docs, path, most=64).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
    assert total == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_encoder_equals_tokenizer():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    encoder, rng = packing.Encoder(path), random.Random(2)
    letters = [" ", "\n", "a", "b", "!", "é", "the", "\t", " ", "1", "'s", "\r", "中", "Ж", "_", "\xa0", "’", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert all(a.tolist() == b for a, b in zip(encoder(texts), encoder._encode(texts), strict=True))


def test_mixing(spark, docs):
    got = mixing.mix_documents(docs, block=4, shard_words=500).collect()
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source][0], by[r.source][1] = r.source_size, r.target
        by[r.source][2] += r.taken
    for size, target, taken, _ in by.values():
        assert target <= 2 * size and abs(taken - target) <= 0.03 * target + 16
    assert abs(sum(x[1] for x in by.values()) - 1.5 * sum(x[0] for x in by.values())) < 1e-6
    again = mixing.mix_documents(docs.repartition(5), block=4, shard_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = mixing.take_documents(docs, block=4, shard_words=500)
    assert taken.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in taken.collect()) == sum(r.taken for r in got)
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_small_sources_come_near_their_targets(spark):
    rows = [(100 * s + i, f"s{s}", n) for s, n in ((0, 5), (1, 10), (2, 25), (3, 3000)) for i in range(2)]
    rows += [(900, "s4", 0), (901, None, 1), (None, "s3", 7), (None, "s3", 7)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    by = defaultdict(lambda: [0.0, 0])
    for r in mixing.mix_sizes(sized).collect():
        assert 0 <= r.taken <= 2 * r.size
        by[r.source][0], by[r.source][1] = r.target, by[r.source][1] + r.taken
    assert len(by) == 6 and all(abs(taken - target) <= max(1, 0.1 * target) for target, taken in by.values())


def test_quotas_by_hand(spark):
    """Blocks go one by one to the highest quotient, ties by source and shard, and never beyond `most`."""
    rows = [("a", 0, 300.0, 9), ("a", 1, 300.0, 2), ("b", 0, 100.0, 9), ("c", 0, 55.5, 9), ("c", 1, 0.0, 5), (None, 0, 120.0, 9)]
    units = spark.createDataFrame(rows, "source string, shard long, votes double, most long")
    got = {(r.source, r.shard): r.quota for r in mixing.quotas(units, 50).collect()}
    want = {r[:2]: 0 for r in rows}
    for _ in range(int(sum(r[2] for r in rows) / 50 + 0.5)):
        open_ = [r for r in rows if want[r[:2]] < r[3]]
        best = min(open_, key=lambda r: (-r[2] / (2 * want[r[:2]] + 1), r[0] is None, r[0] or "", r[1]))
        want[best[:2]] += 1
    assert got == want


def test_fingerprints(spark, docs):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    import hashlib

    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        own, other, following = (fingerprints.order_minhash(x) for x in (t, edited, after))
        assert got[i].fingerprint == own.astype(">u2").tobytes().hex()
        assert (got[i].near_edited, got[i].near_next) == (fingerprints.likeness(own, other), fingerprints.likeness(own, following))
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
    assert fingerprints.fingerprint_documents(docs.where("doc_id = 3")).first().near_next == 1.0


def test_drop_near_duplicates_unordered_columns(spark):
    """Maps and variants may lie beside the text; repeated rows give one."""
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (3, "own words here"), (4, None)], "doc_id long, text string")
    df = df.selectExpr("*", "map('a', doc_id) m", "array(map(1, 2)) `n.m`", "parse_json('{\"a\": 1}') v", "1 t")
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.m["a"]) for r in got.select("doc_id", "m").collect()) == [(1, 1), (3, 3), (4, 4)]


def test_fuzzy_lines(spark):
    rng = random.Random(3)
    line = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(90)) for _ in range(30))
    near = line.replace(line[40:46], "edited", 1)
    rows = [(1, f"{line}\nshort\nan own line of the first text here"), (2, f"  {line}  \nshort\nanother line that only the second has"), (3, f"{near}\n\nwholly different words stand in this third line"), (4, None), (5, ""), (None, line), (2, "a second row of the same document")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("a.b", F.lit(1))).collect()
    texts = {(r.doc_id, r.n_lines): (r.text, r.n_removed) for r in got}
    assert texts[1, 3] == (rows[0][1], 0) and texts[2, 3] == ("another line that only the second has", 2)
    assert texts[3, 3] == ("\nwholly different words stand in this third line", 1)
    assert texts[4, 0] == (None, 0) and texts[5, 1] == ("", 0) and texts[None, 1] == ("", 1) and texts[2, 1][1] == 0
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fuzzy_lines_short(spark):
    """The query and the pipeline's stage take every line that isn't blank, also those shorter than a shingle."""
    import corpus_pipeline
    from podium.llm import queries

    rows = [(1, "Read more\n\n}\nonly here"), (2, " Read more\n\n}\n}"), (3, "own text\nRead more\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    kept = {1: rows[0][1], 2: "", 3: "own text\n"}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == kept
    path = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op9_fuzzy_lines(spark, path).collect()} == {1: 0, 2: 3, 3: 1}


def test_fuzzy_lines_repeated_phrases(spark):
    """Lines whose sets are equal share all buckets, however often a phrase is repeated; few distinct shingles suffice."""
    phrase = "click here to subscribe now! "
    rows = [(0, phrase * 4), (1, phrase * 9), (2, "-" * 40), (3, "-" * 900), (4, "ab" * 50), (5, "ab" * 500)]
    buckets = lines.line_buckets(spark.createDataFrame(rows, "id long, line string"), lines.Fuzzy())
    got = {r.id: r.b for r in buckets.groupBy("id").agg(F.collect_set("bucket").alias("b")).collect()}
    assert all(set(got[i]) == set(got[i + 1]) for i in (0, 2, 4))


def test_fuzzy_lines_recall(spark):
    """Every pair of lines just above 80 % by brute force shares a bucket."""
    rng, rows = random.Random(8), []
    for k in range(3000):
        n = (24, 60, 106, 220)[k % 4]
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        b = a[: n - (n - 6) // 9] + "".join(rng.choice("ABCDEFGHIJ") for _ in range((n - 6) // 9))
        x, y = ({t[i : i + 7] for i in range(n - 6)} for t in (a, b))
        assert 80 * len(x | y) <= 100 * len(x & y) < 86 * len(x | y)
        rows += [(2 * k, a), (2 * k + 1, b)]
    buckets = lines.line_buckets(spark.createDataFrame(rows, "id long, line string"), lines.Fuzzy())
    met = buckets.groupBy("bucket", F.expr("id div 2").alias("pair")).agg(F.countDistinct("id").alias("n")).where("n = 2")
    assert met.select("pair").distinct().count() == 3000


def test_fuzzy_lines_buckets_once(spark, monkeypatch):
    """Lines are cut into shingles once for all buckets; shared buckets as by a plain loop."""
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(-9, 9)) for _ in range(60)] + [(99, 5), (99, 5), (98, 1)]
    members = {}
    for k, i in rows:
        members.setdefault(k, set()).add(i)
    want = {(k, i, min(m)) for k, m in members.items() if len(m) > 1 for i in m}
    got = near.shared_buckets(spark.createDataFrame(rows, "bucket long, id long"))
    assert {tuple(r) for r in got.select("bucket", "id", "hub").collect()} == want
    plans, real = [], near.materialize
    monkeypatch.setattr(near, "materialize", lambda df, name: (name == "buckets" and plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    docs = spark.createDataFrame([(i, f"a line of some forty letters, number {i}") for i in range(20)], "doc_id long, text string")
    assert lines.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] > 0
    assert len(plans) == 1 and plans[0].count("Generate explode(sequence(") == 1


def test_fuzzy_lines_phrases_in_common(spark):
    """Few lines that have only a phrase or two in common share a bucket: such pairs grow with the square of the lines."""
    rng = random.Random(4)
    phrases = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20)) for _ in range(400)]
    rows = [(i, " ".join(rng.sample(phrases, 12))) for i in range(3000)]
    met = near.shared_buckets(lines.line_buckets(spark.createDataFrame(rows, "id long, line string"), lines.Fuzzy()))
    assert met.select("id").distinct().count() < 1000


def test_fuzzy_lines_dealt_in_turns(spark, monkeypatch):
    """Neither texts nor all buckets are dealt out at once; the shared ones are those of one pass."""
    plans, real = [], near.materialize
    monkeypatch.setattr(near, "materialize", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name))[1])
    rng = random.Random(4)
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120)) for _ in range(30)]
    df = spark.createDataFrame([(2 * i + k, x[: 115 + 5 * k]) for i, x in enumerate(own) for k in (0, 1)], "id long, line string")
    signed = lines.line_signatures(df, lines.Fuzzy())
    turns = near.shared_in_turns(signed)
    assert len(turns) == -(-len(signed.buckets) // near.BANDS) > 1 and [name for name, _ in plans] == ["buckets", *["shared"] * len(turns)]
    assert plans[0][1].count("Exchange hashpartitioning(id#") == plans[0][1].count("Exchange ") == 1
    got = [tuple(r) for t in turns for r in t.collect()]
    assert len(got) >= 60 and sorted(got) == sorted(map(tuple, near.shared_buckets(lines.line_buckets(df, lines.Fuzzy())).collect()))


def test_similar_classes_rounds(spark, monkeypatch):
    """Small buckets are settled in one round, whatever strangers they hold; a group larger than these in the rounds that follow."""
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**62), 2**62, (3, 60)).tolist()
    own = lambda k: rng.integers(-(2**62), 2**62, k).tolist()
    small = {i: {*base[i % 2][: 58 - i % 3], *own(2)} for i in range(8)} | {8: {*own(60)}}
    large = small | {i: {*base[2], *own(2)} for i in range(100, 140)}  # hub 8 isn't like any of them
    links_of = lambda sets: {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    real, names = near.materialize, []
    monkeypatch.setattr(near, "materialize", lambda df, name: (names.append(name), real(df, name))[1])
    for sets, members, rounds in ((small, [range(9)], 1), (large, [range(9), [8, *range(100, 140)]], 2)):
        links = links_of(sets)
        of = {i: i for i in sets}
        for _ in sets:
            of = {i: min([of[i], *[of[a + b - i] for a, b in links if i in (a, b)]]) for i in sets}
        store = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
        elements = lambda ids, store: store.join(ids, "id", "left_semi").select("id", F.explode("s").alias("s"))
        sketch = lambda store: store.select("id", F.explode("s").alias("s")).groupBy("id").agg(F.count("*").alias("n"), F.array(*near.sketch_words(F.col("s"), 32)).alias("words"))
        verified = spark.createDataFrame(sorted(links), "a long, b long")
        verify = lambda pairs, store, v=verified: pairs.join(v, ["a", "b"])
        buckets = spark.createDataFrame([(k, i) for k, m in enumerate(members) for i in m], "bucket long, id long")
        names.clear()
        found = near.similar_classes(buckets, lambda ids, store=store: real(store.join(ids, "id", "left_semi"), "store"), verify, near.Sets(sketch, elements, 80, 32))
        assert {r.node: r.component for r in found.collect()} == {i: c for i, c in of.items() if any(i in x for x in links)}
        assert names.count("classes") == rounds and ("parts" in names) == (rounds > 1)


def test_fuzzy_lines_at_once(spark):
    """Rows of several shingles hold those of the line and no others; looked up by id, they are an eighth of the shingles."""
    rows = [(n, "".join(chr(97 + (i * i + n) % 26) for i in range(n)) + "é😀"[: n % 3]) for n in range(7, 60)]
    df = spark.createDataFrame(rows, "id long, line string")
    got = lines._shingle_rows(df, 7)
    each = got.select("id", F.explode(F.array(*[f"s{j}" for j in range(lines.AT_ONCE)])).alias("s"))
    assert {tuple(r) for r in each.distinct().collect()} == {tuple(r) for r in lines._shingles(df, 7).distinct().collect()}
    assert got.count() == sum(-(-(len(t) - 6) // 8) for _, t in rows)


def test_fuzzy_lines_sketches(spark):
    """Bits by hand; sketches of lines of 900 characters that share a third of their text tell them apart."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß😀") for _ in range(n))
    shared = word(300)
    rows = [(1, shared + word(600)), (2, shared + word(600)), (3, "ab" * 200), (4, word(9))]
    df = spark.createDataFrame(rows, "id long, line string")
    got = {r.id: (r.n, list(r.words)) for r in lines.line_sketches(df, lines.Fuzzy()).collect()}
    for r in lines._shingles(df, 7).groupBy("id").agg(F.collect_list("s").alias("s")).collect():
        words = [0] * lines.SKETCH
        for s in r.s:
            words[(s >> 6) % lines.SKETCH] |= 1 << (s % 64)
        assert got[r.id] == (len(r.s), [w - (1 << 64) if w >> 63 else w for w in words])
    sets = near.Sets(None, None, 80, lines.SKETCH, exact=False)
    pairs = spark.createDataFrame([(1, 2), (1, 1), (3, 3)], "a long, b long")
    assert {tuple(r) for r in sets.likely(pairs, lines.line_sketches(df, lines.Fuzzy())).collect()} == {(1, 1), (3, 3)}


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        t = [rng.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            t[rng.randrange(30)] = rng.choice(["nastyslur", "vileinsult"])
        rows.append((i, " ".join(t), int(i % 5 == 0)))
    rows += [(900, None, None), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df.withColumn("label", F.lit("x")), df.select("doc_id", "toxic")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    assert sum(got[i].predicted == y for i, _, y in rows[:600] if got[i].held_out) >= 0.97 * sum(got[i].held_out for i in range(600))
    none = toxicity.score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert none.count() == len(rows)


def test_toxicity_by_hand():
    """Ratios and n-grams against counting one at a time; a text longer than a piece has the n-grams of the whole."""
    s = toxicity.Settings(bits=16)
    texts = ["Abcd", "", "bcdE" * 300_000, "xyz", "abcd"]
    row, feature = toxicity.present(texts, s)
    grams = [{t.lower()[i : i + n] for n in s.sizes for i in range(len(t) - n + 1)} for t in (*texts[:2], texts[2][:40], *texts[3:])]
    found = [set(feature[row == i].tolist()) for i in range(5)]
    assert [len(x) for x in found] == [len(g) for g in grams] and found[0] == found[4] and not found[1]
    one = toxicity.present([texts[2][:40]], s)[1]
    assert found[2] == set(one.tolist())
    counts, rows = np.array([[1, 0, 40, 0], [30, 0, 38, 1]]), np.array([100, 80])
    got = toxicity.shrunk_ratios(counts, rows, s)
    for k in range(4):
        p, q = (counts[1, k] + 1) / 82, (counts[0, k] + 1) / 102
        error = (1 / (counts[1, k] + 1) - 1 / 82 + 1 / (counts[0, k] + 1) - 1 / 102) ** 0.5
        want = max(0, abs(np.log(p / q)) - s.shrink * error) * np.sign(np.log(p / q)) if counts[:, k].any() else 0
        assert abs(got[k] - want) < 1e-12
    assert got[0] > 0 and not got[1:].any()


def test_urls(spark):
    rows = [(i, f"http://bad{i % 3}.spam.com/buy/{i}" if i % 2 else f"http://site{i % 3}.info/read/{i}") for i in range(400)]
    rows += [(1000, None), (1001, "no scheme"), (1002, "http://A.Example.NET/en/x?y#z"), (1003, "http://net"), (1004, "x://sub.example.com/de/"), (1005, "https://evilnet/"), (1006, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("x"))
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels).collect()}
    assert all(got[i][3] == ("block" if i % 2 else "allow") for i in range(400))
    assert got[1000] == ("", "", None, "allow") and got[1001] == ("", "", None, "allow")
    assert got[1002] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1003][:3] == ("net", "", None) and got[1004][2:] == ("example.com/de/", "block") and got[1005][2] is None
    assert urls.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_url_rules_by_hand(spark):
    """Mined rules against all token combinations counted one at a time, and verdicts on pages without a label."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        host, path, query = rng.choice(["shop", "blog", "news"]), rng.choice(["win", "read", "buy"]), rng.choice(["id", "ref"])
        bad = rng.random() < (0.9 if host == "shop" and path == "win" else 0.5 if query == "ref" and path == "buy" else 0.1)
        rows.append((i, f"http://{host}.example.com/{path}/{i}?{query}=1", bad))
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    host, path = urls.host_path(F.col("url"))
    mining = urls.Mining(min_count=10)
    rules = urls.mine_rules(labelled.select(urls.tokens(host, path, F.col("url")).alias("tokens"), "bad"), mining).collect()
    from itertools import combinations

    sets = [({f"h:{x}" for x in u.split("/")[2].split(".")} | {f"p:{u.split('/')[3]}", f"q:{u.split('?')[1][:-2]}"}, b) for _, u, b in rows]
    items = sorted(set().union(*(x for x, _ in sets)))
    share, want = sum(b for _, b in sets) / len(sets), {}
    for n in range(1, len(items) + 1):
        for c in combinations(items, n):
            of = [b for x, b in sets if x.issuperset(c)]
            if sum(of) < 10:
                continue
            p, m, z = sum(of) / len(of), len(of), mining.z
            low = (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
            if p >= mining.min_lift * share and low > share:
                want[c] = p
    want = {c: p for c, p in want.items() if not any(set(d) < set(c) and q >= p for d, q in want.items())}
    assert want and {tuple(sorted(r.antecedent)): round(r.confidence, 9) for r in rules} == {c: round(p, 9) for c, p in want.items()}


def test_url_rules_of_repeated_urls(spark):
    """Urls of many tokens that repeat as a whole, which have 2**25 combinations; one of their tokens tells as much as all."""
    import time

    words = "/".join(f"w{chr(97 + j)}x" for j in range(25))
    rows = [(i, f"http://a.spam.com/{words}?q=1") for i in range(30)] + [(100 + i, f"http://site{i % 7}.info/read/{i}") for i in range(300)]
    rows += [(900, "http://other.org/xx/wdx/zz"), (901, "http://other.org/xx/zz"), (902, "http://b.spam.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 30), 0) for i, _ in rows if i < 900], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: (r.verdict, r.confidence) for r in urls.judge_urls(pages, labels).collect()}
    assert time.time() - began < 60
    assert all((got[i][0] == "block") == (i < 30 or i in (900, 902)) for i in got)
    assert got[900] == got[0] == ("block", 1.0)


def test_html_tree_and_time():
    """Link density splits first, neighbours decide too; pages the tree wasn't grown from; time in proportion."""
    import time

    tree = html.trained()
    used = lambda t: {t[0]} | used(t[2]) | used(t[3]) if len(t) > 1 else set()
    assert tree[0] == 1 and {0, 1, 2, 4} <= used(tree)
    lines_ = html.LABELLED.strip().split("\n")
    right = total = 0
    for k in range(5):
        grown = html.grow(html.labelled_rows([x for i, x in enumerate(lines_) if i % 5 != k]))
        rows = html.labelled_rows([x for i, x in enumerate(lines_) if i % 5 == k])
        right, total = right + sum(html.is_content(grown, r) == bool(r[-1]) for r in rows), total + len(rows)
    assert right >= 0.85 * total
    p = lambda n: f"<p>{'word ' * n}</p>"
    assert html.main_text("<div>" + p(80) + p(40) + p(30) + p(18) + "</div>").count("\n") == 3
    assert html.main_text("<a>Home</a> <a>News</a>" + p(60)).startswith("word")
    for x in ("<a x", '<a ">"', "<div>", "<div hidden>", "</p>", "<a class=", "<!", "<p hidden class='x", "<svg><text>a</text>"):
        began = time.time()
        html.main_text(f"<article>{x * (1_000_000 // len(x))}")
        assert time.time() - began < 8
    assert html.main_text("<article><p>The area is <math><mi>x</mi></math> by <svg><text>y</text></svg>.</p></article>") == "The area is x by y."


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='ad banner'>Buy now, a long advert text that goes on and on for many words.</div><article><h1>Title &amp; more</h1><p>First\n  para<b>graph</b>.<p>Second &lt;one&gt;."
        "<aside>Related things</aside><form><input value=x>Subscribe</form></article><section id=comments><p>A reader comment that is long enough to look like text.</p></section><footer>&copy; us</footer></body></html>"
    )
    assert html.main_text(page) == "Title & more\nFirst paragraph.\nSecond <one>."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 200_000), (5, "u", "<article>< broken <p 'x>y")]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "'y' n_chars", "1 `a.b`")).collect()}
    assert got[2].text == "" and got[3].n_chars == 0 and got[4].n_chars == 999_999
    assert got[1].n_chars == len(html.main_text(page))


def test_html_names():
    """A name tells by whole parts and on small containers only: no article goes by one, comments go however many they are."""
    p = lambda *ns: "".join(f"<p>{' '.join(f'w{n}x{i}' for i in range(n))}</p>" for n in ns)
    words = lambda page: [len(x.split()) for x in html.main_text(page).split("\n")]
    for x in ('div class="layout has-sidebar"', 'div class="post comments-open"', 'section class="social-sciences"', 'div class="sidebar"', 'div id="search"'):
        end = x.split()[0]
        assert words(f"<body><{x}><article>{p(60, 70)}</article></{end}></body>") == [60, 70]
        assert words(f"<body><{x}>{p(60, 70)}</{end}></body>") == [60, 70]
    assert words(f'<article class="post no-ads">{p(60, 70)}</article>') == [60, 70]
    for x in ("ad", "ad_box", "sidebar-left", "siteFooter", "widget box", "comments", "comment-list"):
        assert words(f'<body><div class="{x}">{p(40)}</div><div>{p(60, 70)}</div></body>') == [60, 70]
        assert words(f'<body><article>{p(60, 70)}</article><div class="{x}">{p(200)}</div></body>') == [60, 70]
    thread = f"<section id=comments><article class=comment>{p(200)}</article><article>{p(300)}</article></section>"
    assert words(f"<body><div>{p(60, 70)}</div>{thread}</body>") == words(f"<body><article>{p(60, 70)}{thread}</article></body>") == [60, 70]
    assert words(f"<body><a href=x>Home</a>{p(80, 1, 1, 2, 70)}</body>") == [80, 1, 1, 2, 70]


def test_html_hidden_attribute():
    words = "an article text of enough words to stand as the content of this page " * 2
    for attribute in ('title="The hidden cost of tea"', 'class="flex hidden md:block"', "data-note='display:none'"):
        assert html.main_text(f"<article><p {attribute}>{words}</p></article>") == words.strip()
    for attribute in ("hidden", 'class=x hidden=""', 'style="color:red; display: none"', "aria-hidden=true"):
        assert html.main_text(f"<article><p {attribute}>{words}</p></article>") == ""


def test_encoder_keeps_as_many_pieces_as_told():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    few, many = packing.Encoder(path, 100), packing.Encoder(path, 1_000)
    texts = [" ".join(f"w{k}x" for k in range(500)), "w1x and others", "w2x"]
    for text in texts:
        assert few([text])[0].tolist() == many([text])[0].tolist() == many._encode([text])[0]
    assert len(few._place) < 10 and len(many._place) > 500
