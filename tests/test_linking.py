"""Similarity joins, merges and reconciliation against plain loops."""

import difflib
import random
from itertools import combinations

import pytest
from podium.functions.ratio import ratios
from podium.operators import matching, reconciling
from podium.operators.choice import choose_in_turn
from pyspark.sql import functions as F

WORDS = "the of love you honden hond queen dance la vida loca remix live".split()
ROW = "g int, id long, naam string, punten long, weken long, hoogste long"


def likeness(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def spoilt(rng, text, most):
    x = list(text)
    for _ in range(rng.randrange(1, most)):
        i, kind = rng.randrange(len(x)), rng.random()
        if kind < 0.4:
            x[i] = rng.choice("abcdéf")
        elif kind < 0.7:
            x.insert(i, rng.choice("abcdéf"))
        elif len(x) > 3:
            del x[i]
    return "".join(x)


def some_keys(seed=7, n=120):
    rng = random.Random(seed)
    keys = {"jan & piet|honden", "piet|hond", "the beatles|help", "the beatles|help!", "you|", "|you", "a|b", "queen|cheerio", "queen|cheerio remix", "plain"}
    for _ in range(n):
        key = " ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) + "|" + " ".join(rng.choices(WORDS, k=rng.randrange(1, 5)))
        keys |= {key, spoilt(rng, key, 6)}
    return sorted(k for k in keys if k.count("|") < 2)


def test_likeness_counts_as_difflib_does():
    rng = random.Random(3)
    a = ["".join(rng.choices("abcde ", k=rng.randrange(0, 40))) for _ in range(600)]
    b = [spoilt(rng, x, 5) if x and k % 2 else "".join(rng.choices("abcde ", k=rng.randrange(0, 40))) for k, x in enumerate(a)]
    assert ratios(a, b).tolist() == [likeness(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("least", [0.9, 0.75])
def test_suspicious_pairs_are_all_pairs(spark, least):
    keys = some_keys()
    e = spark.createDataFrame([("t", 2020 + i % 2, 1, i, k) for i, k in enumerate(keys)] + [("t", 2020, 2, 1, None)], "lijst string, jaar int, week int, positie int, sleutel string")
    got = {(r.jaar, r.a, r.b): r.score for r in matching.suspicious_pairs(e, least).collect()}
    want = {}
    for i, a in enumerate(keys):
        for j in range(i + 2, len(keys), 2):
            b = keys[j]
            (aa, _, at), (ba, _, bt) = a.partition("|"), b.partition("|")
            if at and bt and (at in bt or bt in at) and (aa in ba or ba in aa):
                want[2020 + i % 2, a, b] = 1.0
            elif abs(len(a) - len(b)) <= 12 and likeness(a, b) >= least:
                want[2020 + i % 2, a, b] = round(likeness(a, b), 3)
    assert got == want


def test_similar_pairs_are_all_pairs(spark):
    names = some_keys(8)
    got = {(r.a, r.b) for r in matching.similar_pairs(spark.createDataFrame([(n,) for n in [*names, None, ""]], "naam string"), 0.8).collect()}
    assert got == {(a, b) for a, b in combinations(names, 2) if a[:2] == b[:2] and abs(len(a) - len(b)) <= 3 and likeness(a, b) >= 0.8}


def test_typo_proposals_are_all_pairs(spark):
    """Also of names that differ in their first two characters, or by more than three in length."""
    names = some_keys(8)
    names = sorted({*names, *["#" + x[1:] for x in names[::3]], *[x + " 1234"[: 4 + len(x) % 2] for x in names[1::3]], "ibrahim ferrer", "ybrahim ferrer", "the rook and the raven", "the rook and the ravenous"})
    n = {x: (1, 8, 9, 12)[i % 4] for i, x in enumerate(names)} | {"ibrahim ferrer": 9, "ybrahim ferrer": 1, "the rook and the raven": 9}
    e = spark.createDataFrame([(x,) for x, k in n.items() for _ in range(k)] + [(None,), ("",)], "artiest string")
    got = {(r.a, r.b, r.n_a, r.n_b) for r in matching.typo_proposals(e).collect()}
    bare = lambda x: x.lower().removeprefix("the ")
    want = {(a, b, n[a], n[b]) for a, b in combinations(names, 2) if min(n[a], n[b]) <= 8 <= max(n[a], n[b]) and bare(a) != bare(b) and likeness(a, b) >= 0.9}
    assert got == want and ("ibrahim ferrer", "ybrahim ferrer", 9, 1) in got
    assert any(a[:2] != b[:2] for a, b, *_ in got) and any(abs(len(a) - len(b)) > 3 for a, b, *_ in got)


def test_verdict_counts_whole_weeks_between(spark):
    weeks = {"a": [1, 2], "b": [6, 7], "c": [7], "d": [2, 9], "e": [3]}
    e = spark.createDataFrame([("t", 2020, w, 1, k) for k, ws in weeks.items() for w in ws], "lijst string, jaar int, week int, positie int, sleutel string")
    pairs = spark.createDataFrame([("t", 2020, a, b) for a, b in [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "d")]], "lijst string, jaar int, a string, b string")
    got = {(r.a, r.b): r.oordeel for r in matching.pair_verdicts(e, pairs).collect()}
    # three weeks (3, 4, 5) lie between 2 and 6; four between 2 and 7
    assert got == {("a", "b"): "hernoemd", ("a", "c"): "los", ("a", "d"): "anders", ("a", "e"): "hernoemd", ("b", "d"): "hernoemd"}


def test_fuzzy_search_by_words_and_fields(spark):
    rows = [("q|b", "Queen", "Bohemian Rhapsody"), ("a|w", "Abba", "Waterloo"), ("k|w", "Kinks", "Waterloo Sunset"), ("t|x", "Tide", "Clean"), ("n|n", None, None)]
    keys = spark.createDataFrame(rows, "sleutel string, artiest string, titel string")
    of = lambda term, **kw: {r.sleutel: r.score for r in matching.fuzzy_search(keys, term, **kw).collect()}
    assert of("bohem queen") == {"q|b": 0.95}  # "bohem" lies within a word
    assert of("rapsody queen")["q|b"] == round(0.95 * likeness("rhapsody", "rapsody"), 3)
    assert of("waterloo") == {"a|w": 1.0, "k|w": 1.0} and of("waterloo", field="artiest") == {}
    assert of("waterloo sunst", field="titel") == {"k|w": round(likeness("waterloo sunset", "waterloo sunst"), 3), "a|w": round(16 / 22, 3)}
    assert of("diet") == {} and of("diet", least=0.25, field="artiest")["t|x"] == 0.25  # the name comes first: tide, diet; the other way round 0.5
    assert of("ab") == {}


def test_turns(spark):
    rng = random.Random(11)
    options = [(g, w, r, sorted(rng.sample(range(14), rng.choice([1, 1, 2, 3])))) for g in (1, 2) for w in range(9) for r in range(rng.choice([0, 1, 3]))]
    got, _ = choose_in_turn(spark.createDataFrame(options, "g int, wie long, rang int, stukken array<long>"), ["g"])
    want, taken, done = set(), set(), set()
    for g, w, r, pieces in sorted(options):
        if (g, w) not in done and not any((g, p) in taken for p in pieces):
            want.add((g, w, r))
            done.add((g, w))
            taken |= {(g, p) for p in pieces}
    assert {(r.g, r.wie, r.rang) for r in got.collect()} == want


def a_year(seed, n=22):
    """Totals of two archives of one year: equal, differing, renamed, in pieces, weakly alike and missing songs."""
    rng = random.Random(seed)
    acts = ["abba", "queen", "kinks", "doe maar"]
    ours, theirs = [], []
    for i in range(n):
        name = " ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) + " - " + rng.choice(acts)
        kind, parts = rng.random(), rng.choice([1, 1, 1, 2, 3, 4])
        own = [(name + ("" if not k else " " + rng.choice(WORDS)), rng.randrange(1, 60), rng.randrange(1, 9), rng.randrange(1, 9)) for k in range(parts)]
        ours += own if kind > 0.1 else []
        p, w, h = sum(x[1] for x in own), sum(x[2] for x in own), min(x[3] for x in own)
        p, w = (p, w) if kind < 0.7 else (p + rng.choice([1, 2, 9]), w + rng.choice([0, 0, 3]))
        if kind < 0.95:
            theirs.append((own[-1][0] if rng.random() < 0.6 else name + " " + rng.choice(WORDS), p, w, h))
    rng.shuffle(ours)
    rng.shuffle(theirs)
    return [(i, *x) for i, x in enumerate(theirs)], [(i, *x) for i, x in enumerate(ours)]


def bag(name):
    return {w for w in name.split() if w != "-"}


def plainly(theirs, ours):
    """One row of theirs after the other."""
    link, score, busy = {}, {}, set()
    for i, name, *_ in theirs:
        free = [k for k, n, *_ in ours if k not in busy and bag(n) == bag(name)]
        if free:
            link[i], score[i] = free[0], 1.0
            busy.add(free[0])
    for i, name, *_ in theirs:
        near = [(-len(bag(n) & bag(name)) / len(bag(n) | bag(name)), k) for k, n, *_ in ours if k not in busy]
        if i not in link and near and -min(near)[0] >= 0.6:
            score[i], link[i] = -min(near)[0], min(near)[1]
            busy.add(link[i])
    out = []
    for i, name, *totals in theirs:
        if i in link and list(ours[link[i]][2:]) == totals:
            out.append(("gelijk", i, (link[i],)))
            continue
        pool = [o for o in ours if o[0] not in busy or o[0] == link.get(i)]
        merge = None
        for bar in (0.6, 0.35):
            some = [o for o in pool if len(bag(o[1]) & bag(name)) / len(bag(o[1])) >= bar]
            for n in (2, 3, 4):
                for c in combinations(some, n):
                    if merge is None and [sum(o[2] for o in c), sum(o[3] for o in c), min(o[4] for o in c)] == totals:
                        merge = tuple(o[0] for o in c)
        if merge:
            busy |= set(merge)
            out.append(("samen", i, merge))
        elif i in link and score[i] >= 0.75:
            own = ours[link[i]]
            large = abs(totals[1] - own[3]) > 2 or abs(totals[0] - own[2]) > max(2, round(totals[0] * 0.05))
            out.append(("groot" if large else "klein", i, (link[i],)))
        else:
            busy.discard(link.get(i))
            out.append(("alleen_zij", i, ()))
    return out + [("alleen_wij", None, (o[0],)) for o in ours if o[0] not in busy]


def test_reconciliation(spark):
    years = {g: a_year(g) for g in range(12)}
    theirs = spark.createDataFrame([(g, *x) for g, (t, _) in years.items() for x in t], ROW)
    ours = spark.createDataFrame([(g, *x) for g, (_, o) in years.items() for x in o], ROW).withColumn("sleutel", F.concat_ws("-", "g", "id"))
    got = reconciling.reconcile_years(theirs, ours, ["g"]).collect()
    want = {(g, *x) for g, (t, o) in years.items() for x in plainly(t, o)}
    assert {(r.g, r.soort, r.hun, tuple(r.ons)) for r in got} == want and len(got) == len(want)
    kinds = {x[1] for x in want}
    assert kinds == {"gelijk", "samen", "klein", "groot", "alleen_zij", "alleen_wij"} and any(len(x[3]) > 2 for x in want)
    for r in got:
        if r.soort == "samen":
            o = years[r.g][1]
            assert r.doel == f"{r.g}-{min(r.ons, key=lambda k: (-o[k][3], -o[k][2], k))}"
    assert reconciling.reconcile_years(theirs.limit(0), ours.limit(0), ["g"]).count() == 0


def test_awards_by_words_or_as_a_whole(spark):
    songs = [("mimimi|x", 2020, "Serebro", "Mimimi"), ("vanvelzen|when", 2020, "VanVelzen", "When Summer Ends"), ("abba|w", 2021, "Abba", "Waterloo [Live]")]
    awards = [(1, 2020, "Mi Mi Mi - Serebro"), (2, 2020, "When Summer Ends - Van Velzen"), (3, 2020, "Waterloo - Abba"), (4, 2022, "Waterloo - Abba"), (5, 2020, "Zoiets - Niemand")]
    got = matching.award_links(spark.createDataFrame(awards, "id long, jaar int, naam string"), spark.createDataFrame(songs, "sleutel string, jaar int, artiest string, titel string")).collect()
    assert {r.id: (r.sleutel, r.score) for r in got} == {1: ("mimimi|x", 1.0), 2: ("vanvelzen|when", 0.7), 3: ("abba|w", 1.0)}
