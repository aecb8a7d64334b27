"""Golden cases of the chart operators on literal rows."""

from podium.functions import text
from podium.operators import cleaning, matching, points, rankings, reconciling, reports, runs
from podium.sources.entries import ENTRY_SCHEMA, read_entries, replace_weeks, write_entries
from pyspark.sql import functions as F


def entries(spark, rows):
    """(chart, year, week, position, key); the key stands for title and artist."""
    return spark.createDataFrame([(c, y, w, p, k, k, k) for c, y, w, p, k in rows], ENTRY_SCHEMA)


def filled(rows, length):
    """Each edition filled up with other songs to `length` places."""
    taken = {(c, y, w): set() for c, y, w, _, _ in rows}
    for c, y, w, p, _ in rows:
        taken[c, y, w].add(p)
    return rows + [(c, y, w, p, f"vul{p}-{c}-{y}-{w}|x") for (c, y, w), own in taken.items() for p in range(1, length + 1) if p not in own]


def test_points_and_shared_positions(spark):
    rows = filled([("t", 2026, w, 1, "a|b") for w in (1, 2, 3, 4, 6, 7)] + [("t", 2026, 1, 7, "c|d"), ("t", 2026, 1, 9, "c|d")], 40)
    got = {r.sleutel: r for r in points.year_ranking(entries(spark, rows)).collect()}
    assert (got["a|b"].punten, got["a|b"].weken, got["a|b"].plek) == (240, 6, 1)
    assert (got["c|d"].punten, got["c|d"].weken) == (34, 1)


def test_totals_with_override(spark):
    e = entries(spark, filled([("t", 2021, 1, 1, "a|b"), ("t", 2022, 1, 5, "a|b")], 40))
    plain = points.range_totals(e, 2020, 2029).where("sleutel = 'a|b'").first()
    assert (plain.punten, plain.weken, plain.hoogste, plain.beste_jaar) == (76, 2, 1, 2021)
    over = spark.createDataFrame([("t", 2021, "a|b", 100, 2, 7)], "lijst string, jaar int, sleutel string, punten long, hoogste int, weken long")
    got = points.range_totals(e, 2020, 2029, over).where("sleutel = 'a|b'").first()
    assert (got.punten, got.weken, got.hoogste) == (136, 8, 2)


def test_runs_over_new_year_jumps_and_absence(spark):
    weeks = [(2018, 50), (2018, 51), (2018, 52), (2019, 1), (2019, 2), (2019, 3)]
    rows = [("t", y, w, p, "a|b") for (y, w), p in zip(weeks, (30, 29, 4, 4, 5, 6), strict=True)] + [("t", 2019, w, 9, "z|z") for w in range(1, 12)] + [("t", 2019, 10, 8, "a|b")]
    e = entries(spark, rows)
    own = sorted((r.begin_idx, r.eind_idx, r.weken) for r in runs.runs(e).where("sleutel = 'a|b'").collect())
    assert own == [(1, 6, 6), (13, 13, 1)]
    assert runs.biggest_jumps(e).where("sleutel = 'a|b'").first().sprong == 25
    assert runs.longest_absences(e).where("sleutel = 'a|b'").first().stap == 7
    span = runs.run_span(e, 2019).where("sleutel = 'a|b'").first()
    assert (span.begin_idx, span.eind_idx, span.begon_eerder, span.loopt_door) == (1, 13, True, False)


def test_empty_entries(spark):
    e = entries(spark, [])
    for f in (points.year_ranking, points.artist_ranking, runs.runs, runs.waves, reports.week_summary, reports.drop_outs, reports.missing_positions):
        assert f(e).count() == 0


def test_closure_keys_and_search(spark):
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("x", "d")]
    got = {r.van: r.eind for r in matching.alias_closure(spark.createDataFrame(pairs, "van string, naar string")).collect()}
    assert got == {"a": "c", "b": "c", "d": "d", "e": "d", "x": "d"}
    df = spark.createDataFrame([("The Béatles feat. K.C.", "Don’t Stop")], "a string, t string")
    assert df.select(text.song_key(F.col("a"), F.col("t"))).first()[0] == "beatles & kc|dont stop"
    keys = spark.createDataFrame([("a|b", "Queen", "Bohemian"), ("c|d", "Abba", "Waterloo")], "sleutel string, artiest string, titel string")
    assert [r.sleutel for r in matching.fuzzy_search(keys, "bohemain").collect()] == ["a|b"]
    assert matching.fuzzy_search(keys, "bo").count() == 0


def test_long_chains_and_cycles(spark):
    """Chains of any length end where they end; a walk that comes round ends at the smallest name on it."""
    chain = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(100)]
    ring = [("r3", "r1"), ("r1", "r7"), ("r7", "r3"), ("a", "r7"), ("self", "self")]
    got = {r.van: r.eind for r in matching.alias_closure(spark.createDataFrame(chain + ring, "van string, naar string")).collect()}
    assert {got[v] for v, _ in chain} == {"n00100"}
    assert (got["r1"], got["r3"], got["r7"], got["a"], got["self"]) == ("r1", "r1", "r1", "a", "self") and len(got) == len(chain + ring)
    assert matching.alias_closure(spark.createDataFrame([], "van string, naar string")).count() == 0


def test_last_spelling_is_the_last_in_time(spark):
    rows = [("t", 2020, 1, 1, "zebra", "z", "a|b"), ("t", 2020, 2, 3, "aap", "y", "a|b"), ("t", 2021, 1, 2, "noot", "x", "a|b")]
    e = spark.createDataFrame(rows, ENTRY_SCHEMA)
    got = {r.jaar: (r.titel, r.artiest) for r in points.year_ranking(e).collect()}
    assert got == {2020: ("aap", "y"), 2021: ("noot", "x")}
    full = rankings.full_totals(e, 2020, 2021).first()
    assert (full.titel, full.artiest, full.jaartallen) == ("noot", "x", "2020,2021")


def test_search_blanks_and_words(spark):
    keys = spark.createDataFrame([("a|b", "Queen", "Bohemian Rhapsody"), ("c|d", "Abba", "Waterloo"), ("e|f", "Émile", "Waterproof")], "sleutel string, artiest string, titel string")
    e = keys.selectExpr("'wk_x' lijst", "2020 jaar", "1 week", "1 positie", "titel", "artiest", "sleutel")
    assert [r.sleutel for r in reports.search(e, "queen|mian r").collect()] == ["a|b"]
    assert reports.search(e, " waterloo").count() == 0 and reports.search(e, "émile").count() == 0 and reports.search(e, "WATER*").count() == 2
    assert [r.sleutel for r in matching.fuzzy_search(keys, "rapsody quen").collect()] == ["a|b"]
    assert [(r.sleutel, r.score) for r in matching.fuzzy_search(keys, "Emile").collect()] == [("e|f", 1.0)]


def test_weeks_are_replaced_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "entries")
    write_entries(entries(spark, [("t", 2020, w, p, f"k{w}{p}|x") for w in (1, 2) for p in (1, 2)] + [("t", 2021, 1, 1, "o|p")]), path)
    week = entries(spark, [("t", 2020, 2, 1, "new|x")])
    for _ in range(2):
        replace_weeks(spark, path, week)
    assert sorted((r.jaar, r.week, r.sleutel) for r in read_entries(spark, path).collect()) == [(2020, 1, "k11|x"), (2020, 1, "k12|x"), (2020, 2, "new|x"), (2021, 1, "o|p")]


def test_linkage(spark):
    e = entries(spark, [("t", 2020, 1, 1, "queen|cheerio"), ("t", 2020, 3, 1, "queen|cheerio remix"), ("t", 2020, 1, 2, "abba|waterloo"), ("t", 2020, 9, 2, "abba|waterlo")])
    pairs = matching.suspicious_pairs(e)
    assert {(r.a, r.b) for r in pairs.collect()} == {("queen|cheerio", "queen|cheerio remix"), ("abba|waterlo", "abba|waterloo")}
    assert {(r.a, r.oordeel) for r in matching.pair_verdicts(e, pairs).collect()} == {("queen|cheerio", "hernoemd"), ("abba|waterlo", "los")}
    apart = spark.createDataFrame([("queen|cheerio remix", "queen|cheerio")], "sleutel_a string, sleutel_b string")
    assert matching.pair_verdicts(e, pairs, apart).count() == 1
    theirs = spark.createDataFrame([(1, 10, "Waterloo Abba"), (1, 11, "Dancing Queen Abba"), (1, 12, "Waterloo Sunset")], "g int, id long, naam string")
    ours = spark.createDataFrame([(1, 1, "Abba Waterloo"), (1, 2, "Abba Dancing Queen Live"), (1, 3, "Kinks Waterloo Sunset")], "g int, id long, naam string")
    assert {(r.hun, r.ons) for r in reconciling.link_by_words(theirs, ours, ["g"]).collect()} == {(10, 1), (11, 2), (12, 3)}


def test_sides_versions_and_clean_up(spark):
    rows = [("t", 2020, 1, 1, "Een ; Twee", "Duo", "x|y"), ("t", 2020, 1, 2, "A Song / B Song", "Abba / Queen", "q|q"), ("t", 2020, 1, 3, "C Song / D Song", "Abba / Abba Feat", "r|r"), ("t", 2020, 1, 4, "don`t stop", "Snelle x Maan", "s|s"), ("t", 2020, 2, 4, "Don’t Stop", "Snelle & Maan", "s|s")]
    e = spark.createDataFrame(rows, ENTRY_SCHEMA)
    out = cleaning.cleaned(e)
    got = sorted((r.week, r.positie, r.artiest, r.titel, r.sleutel) for r in out.collect())
    assert got == [
        (1, 1, "Duo", "Een", "duo|een"), (1, 1, "Duo", "Twee", "duo|twee"), (1, 2, "Abba", "A Song", "abba|a song"), (1, 2, "Queen", "B Song", "queen|b song"),
        (1, 3, "Abba / Abba &", "C Song / D Song", got[4][4]), (1, 4, "Snelle & Maan", "Don't Stop", "snelle & maan|dont stop"), (2, 4, "Snelle & Maan", "Don't Stop", "snelle & maan|dont stop"),
    ] or got[4][3] == "C Song / D Song"
    one = cleaning.split_sides(e)
    assert sorted(map(str, cleaning.split_sides(one).collect())) == sorted(map(str, one.collect()))


def test_partitioned_overwrite(spark, tmp_path):
    path = str(tmp_path / "entries")
    write_entries(entries(spark, [("t", 2020, 1, 1, "a|b"), ("t", 2021, 1, 1, "a|b")]), path)
    write_entries(entries(spark, [("t", 2021, 1, 1, "c|d"), ("t", 2021, 1, 2, "e|f")]), path)
    assert sorted((r.jaar, r.sleutel) for r in read_entries(spark, path).collect()) == [(2020, "a|b"), (2021, "c|d"), (2021, "e|f")]


def test_lines_are_dealt_out_by_their_number(spark):
    from podium.sources.entries import chart_entries

    sf = "/root/testdata/sf0.001"
    entries = chart_entries(spark, sf)
    few = chart_entries(spark, sf, rows=500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    plan = few._jdf.queryExecution().executedPlan().toString()
    # both charts sum their lines in as many tasks as there are lines for, and nothing is dealt out again before the sums are cut
    assert n > spark.sparkContext.defaultParallelism and plan.count("REPARTITION_BY_NUM") == 2
    assert all(f", {n})" in line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, entries.collect()))


def test_editions_go_to_few_tasks(spark):
    """Each task sends all places of an edition that it has lines of: many small editions stay in few tasks, one large edition is spread."""
    from podium.sources.entries import _dealt

    def tasks_of(editions, lines):
        sold = spark.range(lines).select(F.col("id").alias("l_partkey"), (F.col("id") % editions).alias("week"))
        dealt = _dealt(sold, ["week"], 40, 500).select("week", F.spark_partition_id().alias("task"))
        of = dealt.groupBy("week").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0]
        return of, dealt.groupBy("task").count().agg(F.max("count")).first()[0]

    many, one = tasks_of(400, 20_000), tasks_of(1, 20_000)
    assert many[0] == 1 and many[1] < 1500 and one[0] > 35 and one[1] < 1500


def test_links_of_many_copies_take_few_jobs(spark):
    """Names that all want the same rows: turns as a plain loop has them, in blocks of any size, not a round of jobs a turn."""
    names = ["aa bb", "aa cc", "bb cc", "aa dd ee"]
    theirs = [(k % 2, 100 + k, names[k % 3]) for k in range(80)]
    ours = [(k % 2, k, names[3] if k % 5 else names[k % 3]) for k in range(70)]
    want = set()
    for g in (0, 1):
        free = {i: set(n.split()) for h, i, n in ours if h == g}
        left = []
        for _, i, n in sorted(r for r in theirs if r[0] == g):
            same = [j for j in sorted(free) if free[j] == set(n.split())]
            if same:
                want.add((g, i, same[0]))
                del free[same[0]]
            else:
                left.append((i, set(n.split())))
        for i, w in left:
            found = [(-len(w & x) / len(w | x), j) for j, x in free.items() if len(w & x) / len(w | x) >= 0.25]
            if found:
                want.add((g, i, min(found)[1]))
                del free[min(found)[1]]
    of = lambda rows: spark.createDataFrame(rows, "g int, id long, naam string")
    spark.sparkContext.setJobGroup("links", "links")
    got = {(r.g, r.hun, r.ons) for r in reconciling.link_by_words(of(theirs), of(ours), ["g"], 0.25).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("links"))
    spark.sparkContext.setJobGroup("", "")
    assert got == want and len(want) > 50 and jobs < 150
    assert {(r.g, r.hun, r.ons) for r in reconciling.link_by_words(of(theirs), of(ours), ["g"], 0.25, block=15).collect()} == want
