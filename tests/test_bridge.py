"""The spelling bridge: levels in order, ties, maps by hand, titles that stay songs of their own."""

from pyspark.sql import functions as F

from podium.functions import text
from podium.operators import bridge

ARCHIVE = [
    ("The Lamps", "Night Bus"), ("The Lamps", "Night Bus"), ("De Kade", "Water"), ("Het Orkest", "Mars"), ("Ann & Bo", "Two"), ("Zoë Löwe", "Één"),
    ("P.H.Q", "Papa's Pig Bag"), ("PHQ", "Other"), ("PHQ", "Other"), ("p-h-q", "Other"), ("Björk!", "Army"), ("The Be Gees", "Word Up!"), (None, "x"),
]


def _entries(spark):
    return spark.createDataFrame(ARCHIVE, "artiest string, titel string")


def test_artist_levels(spark):
    names = ["The Lamps", "Lamps", "Kade", "Orkest", "Ann feat. Bo", "zoe lowe", "phq", "BEGEES", "bjork", "Nobody", "Van Hand", None, "!!!"]
    source = spark.createDataFrame([(n,) for n in names] * 2, "artiest string")
    hand = spark.createDataFrame([("Van Hand", "De Kade"), ("Lamps", "The Lamps"), ("Elsewhere", "X"), ("zoe lowe", None)], "artiest string, naam string")
    got = {r.artiest: (r.naam, r.trap) for r in bridge.artist_bridge(source, _entries(spark), hand).collect()}
    assert got == {
        "The Lamps": ("The Lamps", 1), "Lamps": ("The Lamps", 0), "Kade": ("De Kade", 3), "Orkest": ("Het Orkest", 4), "Ann feat. Bo": ("Ann & Bo", 1), "zoe lowe": ("Zoë Löwe", 5),
        "phq": ("PHQ", 5), "BEGEES": ("The Be Gees", 6), "bjork": ("Björk!", 5), "Nobody": ("Nobody", None), "Van Hand": ("De Kade", 0), "!!!": ("!!!", None),
    }
    assert bridge.artist_bridge(source.limit(0), _entries(spark)).count() == 0
    none = bridge.artist_bridge(source, _entries(spark).limit(0))
    assert {r.trap for r in none.collect()} == {None} and none.count() == 12


def test_titles_and_rows(spark):
    rows = [("Lamps", "Nightbus", 1), ("Lamps", "Night Bus (Live)", 2), ("BEGEES", "Word Up", 3), ("Kade", "Wa-Ter", 4), ("Foo", "Water", 5), ("Kade", "Mars", 6), (None, "x", 7), ("Kade", None, 8), ("Lamps", "Nightbus", 1)]
    source = spark.createDataFrame(rows, "artiest string, titel string, positie int")
    entries = _entries(spark)
    artists = bridge.artist_bridge(source, entries)
    per_title = spark.createDataFrame([("Kade", "Mars", "Het Orkest")], "artiest string, titel string, naam string")
    hand = spark.createDataFrame([("Foo", "Water", "Aqua")], "artiest string, titel string, wordt string")
    titles = bridge.title_bridge(source, entries, artists, per_title, hand)
    assert {tuple(r) for r in titles.collect()} == {("The Lamps", "Nightbus", "Night Bus"), ("De Kade", "Wa-Ter", "Water"), ("Foo", "Water", "Aqua")}
    out = bridge.bridged(source, artists, titles, per_title)
    assert out.columns == source.columns
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [
        ("The Lamps", "Night Bus", 1), ("The Lamps", "Night Bus", 1), ("The Lamps", "Night Bus (Live)", 2), ("The Be Gees", "Word Up", 3), ("De Kade", "Water", 4),
        ("Foo", "Aqua", 5), ("Het Orkest", "Mars", 6), (None, "x", 7), ("De Kade", None, 8),
    ]


def test_lines_of_shared_places(spark):
    want = {
        "Ann / Bo - Hill / Dale": [("Ann", "Hill"), ("Bo", "Dale")],
        "Ann / Bo - Hill - Live / Dale": [("Ann", "Hill - Live"), ("Bo", "Dale")],
        "Jan - Piet / Bo - Hill / Dale ": [("Jan - Piet", "Hill"), ("Bo", "Dale")],
        "Ann - Hill": None, "Ann / Bo - Hill": None, "Ann": None, "": None, None: None, "A / B / C - x / y / z": [("A", "x"), ("B", "y"), ("C", "z")],
    }
    df = spark.createDataFrame([(k,) for k in want], "regel string").withColumn("p", text.split_line(F.col("regel")))
    assert {r.regel: r.p and [tuple(x) for x in r.p] for r in df.collect()} == want
