"""Media libraries: XML to rows, and matching by levels against a plain loop."""

import difflib
import random
import re

from podium.operators.library import match_library
from podium.sources import libraries

SONGS = """<?xml version="1.0" encoding="UTF-8"?><VirtualDJ_Database Version="8">
<Song FilePath="C:/M/a.MP3" FileSize="1"><Tags Author=" Abba " Title="Waterloo (Live)" Genre="x"/><Infos Bitrate="320"/><Poi Pos="1"/></Song>
<Song FilePath="netsearch://tdv1"><Tags Author="Queen" Title="A &amp; B"/></Song>
<Song FilePath="http://x/a.mp3"><Tags Author="Queen" Title="B"/></Song>
<Song FilePath="C:/M/clip.mkv"><Tags Author="Queen" Title="C"/><Infos Bitrate="veel"/></Song>
<Song FilePath="C:/M/no.mp3"><Tags Author="" Title="D"/></Song><Song FilePath="C:/M/none.mp3"/>
</VirtualDJ_Database>"""
TRACKS = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION>
<TRACK Name="Waterloo" Artist="Abba" Location="file://localhost/C:/Mu%20ziek/A+B%26.mp3" BitRate="192"/>
<TRACK Name="Clip" Artist="Kinks" Location="file:///home/x/clip.MP4?x=1" BitRate=""/>
<TRACK Name="Doc" Artist="Kinks" Location="file:///home/x/a.doc"/><TRACK Name="Bad" Artist="Kinks" Location="file:///home/100%.mp3"/>
</COLLECTION><PLAYLISTS><TRACK Key="1"/></PLAYLISTS></DJ_PLAYLISTS>"""


def test_songs_and_tracks_from_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SONGS)
    got = {r.pad: r for r in libraries.read_song_library(spark, str(tmp_path / "s.xml")).collect()}
    assert {p: (r.artiest, r.titel, r.bitrate, r.streaming, r.video) for p, r in got.items()} == {
        "C:/M/a.MP3": ("Abba", "Waterloo (Live)", 320, False, False),
        "netsearch://tdv1": ("Queen", "A & B", 0, True, True),
        "C:/M/clip.mkv": ("Queen", "C", 0, False, True),
    }
    assert got["C:/M/a.MP3"].kern == "abba|waterloo" != got["C:/M/a.MP3"].sleutel
    (tmp_path / "t.xml").write_text(TRACKS)
    got = {r.pad: (r.bitrate, r.video, r.streaming) for r in libraries.read_track_library(spark, str(tmp_path / "t.xml")).collect()}
    assert got == {"C:/Mu ziek/A+B&.mp3": (192, False, False), "/home/x/clip.MP4": (0, True, False), "/home/100%.mp3": (0, False, False)}


def test_elements_that_cannot_be_read_are_kept_apart(spark, tmp_path):
    (tmp_path / "b.xml").write_text('<DB><Song FilePath="C:/a.mp3"><Tags Author="A" Title="B"/></Song><Song FilePath="C:/b.mp3"><Tags Author="A" Title=></Song></DB>')
    assert [r.pad for r in libraries.read_song_library(spark, str(tmp_path / "b.xml")).collect()] == ["C:/a.mp3"]
    assert ["C:/b.mp3" in r.element for r in libraries.rejected_songs(spark, str(tmp_path / "b.xml")).collect()] == [True]


def alike(a, b, least):
    return a == b or difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


def plainly(key, files, level):
    artist, title = key.split("|", 1)
    core = artist + "|" + re.sub(r"\s*[\(\[][^\)\]]*[\)\]]", "", title).strip()
    title = core.split("|", 1)[1]
    fa, ft = (lambda f: f[2].split("|", 1)[0]), (lambda f: f[2].split("|", 1)[1])
    sets = lambda f: (set(artist.split(" & ")), set(fa(f).split(" & ")))
    long = lambda t: {w for w in t.split(" ") if len(w) >= 3}
    steps = [(1, lambda f: f[1] == key), (2, lambda f: f[2] == core), (2, lambda f: ft(f) == title and (sets(f)[0] <= sets(f)[1] or sets(f)[1] <= sets(f)[0]))]
    steps += [(3, lambda f: ft(f) == title and (alike(fa(f), artist, 0.6) or set(fa(f).split()) & set(artist.split())))]
    steps += [(4, lambda f: long(ft(f)) & long(title) and alike(ft(f), title, 0.85) and alike(fa(f), artist, 0.5))]
    for n, fits in steps:
        some = [f for f in files if n <= level and fits(f)]
        if some:
            return min(some, key=lambda f: (f[3], -f[4], f[0]))[0], n
    return None, None


def test_matching_by_levels(spark):
    rng = random.Random(5)
    acts = ["abba", "queen", "the kinks", "meat loaf & ellen foley", "meat loaf", "abba & queen", "kinx", "quen"]
    titles = ["waterloo", "waterloo sunset", "waterlo sunset", "dancing queen", "dancing quen", "bat out of hell", "bat out of hel", "ok", "op"]
    files = []
    for i in range(90):
        a, t = rng.choice(acts), rng.choice(titles)
        files.append((f"f{i:03d}", f"{a}|{t}" + rng.choice(["", " live"]), f"{a}|{t}", rng.random() < 0.4, rng.choice([128, 320])))
    files = rng.sample(files, 40)
    keys = sorted({f"{a}|{t}" for a in [*acts, "abbo", "nobody"] for t in [*titles, "waterloo (remix)", "dancng queen"]})
    f = spark.createDataFrame(files, "pad string, sleutel string, kern string, streaming boolean, bitrate int")
    s = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "sleutel string")
    for level in (1, 2, 4):
        got = {r.sleutel: (r.pad, r.niveau) for r in match_library(s, f, level).collect()}
        want = {k: plainly(k, files, level) for k in keys}
        assert got == want
    assert {n for _, n in want.values()} == {1, 2, 3, 4, None}
