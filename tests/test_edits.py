"""Edits by hand: the last one wins, twice is once, keys and audit follow."""

from podium.operators import edits
from podium.sources.entries import ENTRY_SCHEMA

ROWS = [("t", 2020, 1, 1, "Ella///Ella", "France", "france|ellaella"), ("t", 2021, 1, 2, "Ella///Ella", "France", "france|ellaella"), ("t", 2020, 1, 2, "Hold", "Duo", "duo|hold")]
SONG, PLACE = "nr long, sleutel string, artiest string, titel string, reden string", "nr long, lijst string, jaar int, week int, positie int, sleutel string, artiest string, titel string, reden string"


def test_songs_are_corrected_once(spark):
    e = spark.createDataFrame(ROWS, ENTRY_SCHEMA)
    log = spark.createDataFrame([(2, "france|ellaella", None, "Ella", "b"), (1, "france|ellaella", "France Gall", "Elle", "a"), (3, "no|key", "X", None, "c"), (4, None, "X", None, "d")], SONG)
    got = edits.correct_songs(e, log)
    first = sorted(map(tuple, got.entries.collect()))
    assert first == sorted([("t", 2020, 1, 1, "Ella", "France Gall", "france gall|ella"), ("t", 2021, 1, 2, "Ella", "France Gall", "france gall|ella"), ROWS[2]])
    assert sorted(map(tuple, edits.correct_songs(got.entries, log).entries.collect())) == first
    assert [tuple(r) for r in got.aliases.collect()] == [("france|ellaella", "france gall|ella", "b")]
    assert [tuple(r) for r in got.artist_names.collect()] == [("france gall", "France Gall")] and [tuple(r) for r in got.title_names.collect()] == [("france gall|ella", "Ella")]
    assert [tuple(r) for r in got.audit.collect()] == [(2, "correctie", "france|ellaella", "artiest+titel", "France - Ella///Ella", "France Gall - Ella", "b")]
    assert {tuple(r) for r in got.dirty.collect()} == {("t", 2020), ("t", 2021)}


def test_single_entries_need_a_reason(spark):
    e = spark.createDataFrame(ROWS, ENTRY_SCHEMA)
    log = spark.createDataFrame([(1, "t", 2020, 1, 2, "duo|hold", None, "Hold On", "typo"), (2, "t", 2020, 1, 1, "france|ellaella", "X", None, " "), (3, "t", 2021, 1, 1, "duo|hold", "X", None, "other place")], PLACE)
    out, audit = edits.edit_entries(e, log)
    assert ("t", 2020, 1, 2, "Hold On", "Duo", "duo|hold on") in [tuple(r) for r in out.collect()] and out.count() == 3
    assert {(r.nr, r.veld, r.oud, r.nieuw, r.reden) for r in audit.collect()} == {(1, "titel", "Hold", "Hold On", "typo"), (1, "sleutel", "duo|hold", "duo|hold on", "typo")}
    again, none = edits.edit_entries(out, log)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect())) and none.count() == 0
