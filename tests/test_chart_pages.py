"""Chart pages to rows: what rank cells mean, names in full, pages that are rejected as a whole."""

from podium.sources.chart_pages import read_chart_pages, whole_names
from pyspark.sql import functions as F


def item(pos, rank, weeks="3", title="T", artist="A", label=None, classes=""):
    label = f'aria-label="{label}"' if label else ""
    return f"""<div class="top40-list__item {classes}"><div class="top40-list__item__info"><div class="number-block x"><span class="h4">{pos}</span></div>
<img src="x.png"><a {label}><h2 class="h3">{title}</h2></a><a><h3>{artist}</h3></a></div><div class="top40-list__item__controls--rank">{rank}</div>
<div class="top40-list__item__controls--weeks"><span>{weeks}</span> <span>weken</span></div></div>"""


def first(*items, title="Lijst van week 5, 2020"):
    return f"<html><title>{title}</title><h2>kop</h2><div class='list__list'>{''.join(items)}</div><div class='top40-list__item'>buiten</div></html>"


ARROW = '<span>{} <i class="fa {}"></i> {}</span>'
GOOD = first(
    item(1, ARROW.format(3, "color-green", 1), classes="hitrecord"),
    item(2, ARROW.format(1, "color-red", 2), classes="dot", title="Rock &amp; Roll", artist="De&nbsp;Band"),
    item(3, "<span>3 <span></span></span>", classes="super"),
    item(4, '<span class="h5 span-entry">NIEUW</span><span>4</span>', weeks="1"),
    item(5, '<span class="span-entry">RE-ENTRY</span><span>5</span>', weeks="12"),
    item(6, ARROW.format(9, "", 6), weeks=""),
    item("-", "<span>33</span>", classes="no-longer-listed"),
)
SECOND = """<title>x Week 5 - Jaargang 2020</title><div id="list"><div class="entry"><div class="nummer dw">1</div><div class="nummer dif"><img src="/d/up.png"/><div>+ 4</div></div>
<div class="info"><span class="titel">Cheer (io)<span><img class="ok"/></span></span><span class="artiest">Jan <span class="label">(platen (nl))</span></span><span class="history">Aantal Weken: 20 Vorige week: 5</span></div></div>
<div class="entry"><div class="nummer dw">2</div><div class="nummer dif"><img src="new.png"></div><div class="info"><span class="titel">Nieuw</span><span class="artiest">Piet</span><span class="history">Aantal Weken: 1 Vorige week: -</span></div></div>
<div class="entry"><div class="nummer dw">3</div><div class="nummer dif"><img src="new.png"></div><div class="info"><span class="titel">Terug</span><span class="artiest">Piet</span><span class="history">Aantal Weken: 8 Vorige week: -</span></div></div>
<div class="entry"><div class="nummer dw">4</div><div class="nummer dif"></div><div class="info"><span class="titel">Geen</span><span class="artiest">Piet</span><span class="history">Vorige week: 2</span></div></div></div>"""
PAGES = "page_id long, lijst string, jaar int, week int, html string"


def test_rows_of_both_layouts(spark):
    rows, rejected = read_chart_pages(spark.createDataFrame([(1, "a", 2020, 5, GOOD), (2, "b", 2020, 5, SECOND), (3, "c", 2020, 5, GOOD)], PAGES), ["b"], ["a"])
    got = {(r.lijst, r.positie): r for r in rows.collect()}
    assert rejected.count() == 0 and len(got) == 16
    of = lambda c, n: [(got[c, p].site_status, got[c, p].vorige_positie, got[c, p].weken_genoteerd) for p in range(1, n + 1)]
    assert of("a", 6) == [("stijger", 3, 3), ("daler", 1, 3), ("gelijk", 3, 3), ("nieuw", None, 1), ("terug", None, 12), ("stijger", 9, None)]
    assert (got["a", 2].titel, got["a", 2].artiest) == ("Rock & Roll", "De Band")
    assert [got["a", p].stip for p in (1, 2, 3)] == [0, 1, 2] and [got["c", p].stip for p in (1, 2, 3)] == [0, 0, 0] and got["a", 1].alarmschijf
    assert of("b", 4) == [("stijger", 5, 20), ("nieuw", None, 1), ("terug", None, 8), ("daler", 2, None)]
    assert (got["b", 1].titel, got["b", 1].artiest, got["b", 1].label, got["b", 1].kroon) == ("Cheer (io)", "Jan", "platen (nl)", True) and not got["b", 2].kroon


def test_pages_are_rejected_as_a_whole(spark):
    fine = item(1, "<span>1</span>")
    bad = {
        "andere week": first(fine, title="Lijst van week 6, 2020"),
        "leeg": first(item("-", "<span>3</span>", classes="no-longer-listed")),
        "positie": first(fine, item("x", "<span>2</span>")),
        "rang": first(fine, item(2, "<span>3</span>")),
    }
    pages = [(i, k, 2020, 5, h) for i, (k, h) in enumerate(bad.items())] + [(9, "leeg", 2020, 5, None), (10, "rang", 2020, 5, first(item(2, ARROW.format(1, "color-red", 3)))), (11, "goed", 2020, 5, first(fine, title="geen week"))]
    rows, rejected = read_chart_pages(spark.createDataFrame(pages, PAGES), ["b"], [])
    told = rejected.collect()
    assert {(r.lijst, r.fout) for r in told} == {(k, k) for k in bad} and len(told) == 6
    assert [r.page_id for r in rows.collect()] == [11]
    assert all(d.count() == 0 for d in read_chart_pages(spark.createDataFrame([], PAGES), ["b"], []))


def test_names_in_full(spark):
    cases = [
        ("Meisje", "Afro Bros x Jeffrey Hees..", "nummer Afro Bros x Jeffrey Heesen - Meisje", ("Meisje", "Afro Bros x Jeffrey Heesen")),
        ("A - Long Tit..", "Duo", "nummer Duo - A - Long Title", ("A - Long Title", "Duo")),
        ("Long Tit..", "Long - Na..", "nummer Long - Name - Long Title", ("Long Title", "Long - Name")),
        ("Tit..", "Elsewhere..", "nummer Name - Title", ("Title", "Name")),
        ("Whole", "Name", "nummer Other - Thing", ("Whole", "Name")),
        ("Tit..", "Name", None, ("Tit..", "Name")),
        ("Tit..", "Name", "song Name - Title", ("Tit..", "Name")),
        ("Tit..", "Na..", "nummer nodash", ("Tit..", "Na..")),
    ]
    t, a = whole_names(F.col("t"), F.col("a"), F.col("l"))
    got = spark.createDataFrame([c[:3] for c in cases], "t string, a string, l string").select(t.alias("x"), a.alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [c[3] for c in cases]
