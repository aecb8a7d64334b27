"""Line dedup and the stages of the pipeline against brute force on a small table with nulls, ties, repeated rows and junk."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from podium.llm import lines
from test_operators import quality_by_hand

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


class Classes:
    def __init__(self):
        self.top = {}

    def find(self, x):
        while self.top.setdefault(x, x) != x:
            x = self.top[x]
        return x

    def join(self, a, b):
        self.top[self.find(a)] = self.find(b)


def lines_by_hand(rows):
    """(doc_id, text) with distinct ids -> doc_id: text left."""
    places = defaultdict(list)
    for i, t in rows:
        for pos, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                places[x.strip(" \t\n\x0b\x0c\r")].append((i is None, i or 0, pos, i))
    sets = {x: {x[k : k + 7] for k in range(len(x) - 6)} or {("short", x)} for x in places}
    classes, every = Classes(), sorted(sets)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                classes.join(a, b)
    groups = defaultdict(list)
    for x, p in places.items():
        groups[classes.find(x)] += p
    gone = {p[2:] for g in groups.values() for p in sorted(g)[1:]}
    return {i: None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if (pos, i) not in gone) for i, t in rows}


def near_by_hand(rows):
    """The (doc_id, text) that stay of each group of near copies (5 words, 80 %)."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    classes = Classes()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                classes.join(a, b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[classes.find(k)].append(k)
    return [sorted(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))[0] for g in groups.values()]


def prose(rng, n, vocabulary):
    out, line = [], 0
    for w in rng.choices(vocabulary, k=n):
        line += 1
        out.append(w + ("\n" if line % 12 == 0 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="module")
def table():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", [26 - i for i in range(26)], k=rng.randint(2, 9))) for _ in range(2500)]
    texts = [prose(rng, rng.randint(60, 160), vocabulary) for _ in range(24)]
    notice = "this very same notice stands in many of the texts of this table"
    texts = [t + ("\n" + notice if i % 3 == 0 else "\n" + notice.replace("many", "most") if i % 3 == 1 else "") for i, t in enumerate(texts)]
    copies = [texts[i].replace("e", "E", 1) for i in (2, 5)] + [" ".join(["edit", *texts[8].split(" ")[1:]])]
    junk = ["spam eggs " * 90, " | ".join(rng.choice(vocabulary[:150]) + "%%%" for _ in range(150)), "too short", "", " \n ", None]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate([*texts, *copies, *junk])]
    return [*rows, (None, prose(rng, 90, vocabulary), None, "s1", None)]


def test_lines_by_hand(spark, table):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in table]
    base = ["a line of about forty letters number one", "click here", "}", "Zeile mit Umläuten äöü und mehr davon", "-" * 30]
    for i in range(100, 130):
        picked = [rng.choice(base) + ("x" if rng.random() < 0.2 else "") + (" " if rng.random() < 0.3 else "") for _ in range(3)]
        rows.append((i, "\n".join([*picked, f"own {i * 7919} line of text {i * 104729}"])))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_by_hand(rows)


def test_stages(spark, table):
    docs = spark.createDataFrame(table, COLUMNS)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(map(str, rows)) == sorted(str(r) for r in table if quality_by_hand(r[1])[-1]) and len(rows) >= 25
    lined = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert lined.columns == docs.columns
    by_hand = lines_by_hand([r[:2] for r in rows])
    out = [tuple(r) for r in lined.collect()]
    assert {r[0]: r[1] for r in out} == by_hand and all(r[4] == len(r[1]) for r in out)
    # repeated rows too
    out = sorted(out, key=str) + [out[0]]
    near = corpus_pipeline.near_dedup(spark, spark.createDataFrame(out, COLUMNS), "")
    stay = Counter(str(out[k]) for k in near_by_hand([r[:2] for r in out]))
    got = [tuple(r) for r in near.collect()]
    assert Counter(map(str, got)) == stay and len(got) < len(out)
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, spark.createDataFrame(got, COLUMNS), "").collect()]
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in mixed:
        taken[r[3]] += len(WORD.findall(r[1]))
        assert " ".join(WORD.findall(r[1])) in " ".join(WORD.findall(next(x[1] for x in got if x[0] == r[0])))
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2, 3), strict=False))
    target, open_ = {}, set(sizes)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 8 for s in sizes)
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(mixed, COLUMNS), "").collect()
    want = Counter()
    for r in mixed:
        want[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    have = Counter()
    for r in packed:
        have[r.doc_id] += r.length
    assert have == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
