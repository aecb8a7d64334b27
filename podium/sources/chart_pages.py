"""Pages of weekly charts as rows: a small reader cuts out the cells of each list item, columns tell what they mean."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Cell:
    """An element of an item: its tag and classes (any, if empty), a class that one around it has, an attribute to read instead of
    its text (`*`: that it is there), and whether text of spans within it counts."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    inside: str = ""
    attribute: str = ""
    spans: bool = True

    def fits(self, tag: str, attrs: dict[str, str], around: list[tuple[str, frozenset[str]]]) -> bool:
        own = attrs.get("class", "").split()
        near = not self.inside or any(self.inside in classes for _, classes in around)
        return (not self.tag or tag == self.tag) and all(c in own for c in self.classes) and near and (self.attribute in ("", "*") or self.attribute in attrs)


@dataclass(frozen=True)
class Layout:
    """The list's attribute and value, the tag and class of an item, and its cells by name."""

    list: tuple[str, str]
    item: tuple[str, str]
    cells: dict[str, Cell] = field(default_factory=dict)


#: How the pages of two sources are built.
FIRST = Layout(
    ("class", "list__list"),
    ("", "top40-list__item"),
    {
        "positie": Cell(classes=("number-block",)),
        "titel": Cell("h2", inside="top40-list__item__info"),
        "artiest": Cell("h3", inside="top40-list__item__info"),
        "rang": Cell(classes=("top40-list__item__controls--rank",)),
        "nieuw": Cell(classes=("span-entry",), inside="top40-list__item__controls--rank"),
        "pijl": Cell("i", inside="top40-list__item__controls--rank", attribute="class"),
        "weken": Cell(classes=("top40-list__item__controls--weeks",)),
        "voluit": Cell("a", attribute="aria-label"),
    },
)
SECOND = Layout(
    ("id", "list"),
    ("div", "entry"),
    {
        "positie": Cell("div", ("nummer", "dw")),
        "titel": Cell("span", ("titel",), inside="info", spans=False),
        "artiest": Cell("span", ("artiest",), inside="info", spans=False),
        "label": Cell("span", ("label",), inside="artiest"),
        "weken": Cell("span", ("history",), inside="info"),
        "pijl": Cell("img", inside="dif", attribute="src"),
        "kroon": Cell("img", ("ok",), attribute="*"),
    },
)
#: Beginnings, endings and patterns of cells, and of titles that tell the week.
GONE, NAMED, CUT, DASH = "no-longer-listed", "nummer ", "..", " - "
WEEKS, BEFORE = r"(?i)Aantal\s*Weken\s*:\s*(\d+)", r"(?i)Vorige\s*week\s*:\s*(\d+)"
TITLES = (r"(?i)van\s+week\s+(\d{1,2}),\s*(\d{4})", r"(?i)Week\s+(\d{1,2})\s*-\s*Jaargang\s+(\d{4})")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

NAMES = ("positie", "titel", "artiest", "rang", "nieuw", "pijl", "weken", "voluit", "label", "kroon")
CELLS = StructType([StructField("nr", IntegerType()), StructField("klassen", StringType()), *[StructField(f"c_{n}", StringType()) for n in NAMES]])


class _Reader(HTMLParser):
    """Collects the items of the first list: their classes and the first cell of each name."""

    def __init__(self, layout: Layout):
        super().__init__(convert_charrefs=True)
        self.layout, self.open, self.items = layout, [], []
        self.list_at = self.item_at = None
        self.done = False
        self.taking: dict[str, tuple[int, list[str]]] = {}

    def handle_starttag(self, tag, attributes):
        attrs = {k: v or "" for k, v in attributes}
        classes = frozenset(attrs.get("class", "").split())
        depth, layout = len(self.open), self.layout
        if self.list_at is None and not self.done:
            key, value = layout.list
            if value in (classes if key == "class" else {attrs.get(key)}):
                self.list_at = depth
        elif self.list_at is not None and self.item_at is None:
            if (not layout.item[0] or tag == layout.item[0]) and layout.item[1] in classes:
                self.item_at = depth
                self.items.append({"klassen": " ".join(attrs.get("class", "").split())})
        elif self.item_at is not None:
            for name, cell in layout.cells.items():
                if name not in self.items[-1] and cell.fits(tag, attrs, self.open[self.item_at :]):
                    if cell.attribute:
                        self.items[-1][name] = "1" if cell.attribute == "*" else " ".join(attrs[cell.attribute].split())
                    else:
                        self.items[-1][name] = ""
                        self.taking[name] = (depth, [])
        if tag not in VOID:
            self.open.append((tag, classes))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        for name, (depth, parts) in self.taking.items():
            if self.layout.cells[name].spans or not any(t == "span" for t, _ in self.open[depth + 1 :]):
                parts.append(data.strip())

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        for name in [n for n, (depth, _) in self.taking.items() if depth >= at]:
            self.items[-1][name] = " ".join(" ".join(self.taking.pop(name)[1]).split())
        if self.item_at is not None and self.item_at >= at:
            self.item_at = None
        if self.list_at is not None and self.list_at >= at:
            self.list_at, self.done = None, True


def page_cells(pages: DataFrame, layout: Layout) -> DataFrame:
    """pages(html, ...) -> one row for each item of the list, in order (nr from 1), with its classes and the text of its cells (c_...,
    null where there is none) in place of html. Pages without a list or items have no rows; a null page has none."""
    kept = [f for f in pages.schema.fields if f.name != "html"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, dict]] = []
            for at, html in enumerate(b.column("html").to_pylist()):
                reader = _Reader(layout)
                reader.feed(html or "")
                reader.close()
                rows += [(at, nr, item) for nr, item in enumerate(reader.items, 1)]
            source = b.select([f.name for f in kept]).take(pa.array([r[0] for r in rows], pa.int64()))
            own = {"nr": pa.array([r[1] for r in rows], pa.int32()), "klassen": pa.array([r[2]["klassen"] for r in rows], pa.string())}
            own |= {f"c_{n}": pa.array([r[2].get(n) for r in rows], pa.string()) for n in NAMES}
            yield pa.RecordBatch.from_arrays([*source.columns, *own.values()], names=[*source.schema.names, *own])

    return pages.select(*[f.name for f in kept], "html").mapInArrow(read, StructType([*kept, *CELLS.fields]))


def page_week(html: Column) -> tuple[Column, Column]:
    """(jaar, week) that a page's title tells; null if it tells none."""
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    of = lambda n: F.coalesce(*[F.nullif(F.regexp_extract(title, p, n), F.lit("")).cast("int") for p in TITLES])
    return of(2), of(1)


def whole_names(title: Column, artist: Column, named: Column) -> tuple[Column, Column]:
    """Title and artist as they are in full, where one ends in .. and the label "nummer artist - title" tells more. What isn't cut
    is the anchor; if both are, the first dash after the artist's known part parts them."""
    full = F.when(F.startswith(named, F.lit(NAMED)), F.substring(named, len(NAMED) + 1, 1_000_000))
    cut_t, cut_a = F.endswith(title, F.lit(CUT)), F.endswith(artist, F.lit(CUT))
    dash = len(DASH)
    by_title = ~cut_t & F.endswith(full, F.concat(F.lit(DASH), title))
    by_artist = ~cut_a & F.startswith(full, F.concat(artist, F.lit(DASH)))
    return _parted(title, artist, full, cut_t | cut_a, by_title, by_artist, dash)


def _parted(title: Column, artist: Column, full: Column, cut: Column, by_title: Column, by_artist: Column, dash: int) -> tuple[Column, Column]:
    head = F.greatest(F.lit(0), F.length(artist) - len(CUT))
    later = F.instr(F.substr(full, head + 1), F.lit(DASH))
    place = F.when(later > 0, head + later).otherwise(F.instr(full, F.lit(DASH)))  # of the dash, from 1; 0: none
    use = cut & full.isNotNull()
    t = F.when(use & by_title, title).when(use & by_artist, F.substr(full, F.length(artist) + dash + 1)).when(use & (place > 0), F.substr(full, place + dash)).otherwise(title)
    a = F.when(use & by_title, F.substr(full, F.lit(1), F.length(full) - dash - F.length(title))).when(use & by_artist, artist).when(use & (place > 0), F.substr(full, F.lit(1), place - 1)).otherwise(artist)
    return t, a


def _number(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"^\d{1,9}$")), c).cast("int")


def first_rows(cells: DataFrame, dotted: list[str]) -> DataFrame:
    """Cells of FIRST pages -> with positie, titel, artiest, weken_genoteerd, vorige_positie, site_status, alarmschijf, stip and fout.

    Songs that have left the chart go. A new label means nieuw, or terug with more than one week and a label without NIEUW; an
    arrow stands between the position before and the present one; without either the only number is the present one. stip: 2
    super, 1 dot, on charts of `dotted` only. fout tells a cell that is missing or contradicts the position.
    """
    rows = cells.where(~F.array_contains(F.split("klassen", " "), GONE)).withColumn("positie", _number(F.col("c_positie")))
    title, artist = whole_names(F.col("c_titel"), F.col("c_artiest"), F.col("c_voluit"))
    found = F.transform(F.regexp_extract_all("c_rang", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    rows = rows.withColumns({"weken_genoteerd": F.nullif(F.regexp_extract("c_weken", r"\d+", 0), F.lit("")).cast("int"), "getallen": found, "titel": title, "artiest": artist})
    entry, arrow = F.col("c_nieuw").isNotNull(), F.col("c_pijl").isNotNull()
    a, b = F.get("getallen", 0), F.get("getallen", 1)
    has = lambda name: F.array_contains(F.split("klassen", " "), name)
    colour = lambda name: F.array_contains(F.split("c_pijl", " "), name)
    status = (
        F.when(entry & (F.col("weken_genoteerd") > 1) & ~F.contains(F.upper("c_nieuw"), F.lit("NIEUW")), "terug").when(entry, "nieuw")
        .when(arrow & colour("color-green"), "stijger").when(arrow & colour("color-red"), "daler")
        .when(arrow & (a > F.col("positie")), "stijger").when(arrow & (a < F.col("positie")), "daler").otherwise("gelijk")
    )
    fault = (
        F.when(F.col("positie").isNull(), "positie").when(F.col("c_titel").isNull() | F.col("c_artiest").isNull(), "naam").when(F.col("c_rang").isNull(), "rang")
        .when(~entry & arrow & ((F.size("getallen") != 2) | (b != F.col("positie"))), "rang").when(~entry & ~arrow & ((F.size("getallen") != 1) | (a != F.col("positie"))), "rang")
    )
    dots = F.when(F.col("lijst").isin(dotted), F.when(has("super"), 2).when(has("dot"), 1).otherwise(0)).otherwise(0)
    out = rows.withColumns({"vorige_positie": F.when(~entry, F.when(arrow, a).otherwise(F.col("positie"))), "site_status": status, "alarmschijf": has("hitrecord"), "stip": dots, "fout": fault})
    return out.withColumns({"label": F.lit(None).cast("string"), "kroon": F.lit(False)})


def second_rows(cells: DataFrame) -> DataFrame:
    """Cells of SECOND pages -> the same columns: label without its brackets, weeks and the position before from the history text,
    the status from the icon, but never nieuw with a position before: that is terug, as is none with more than one week."""
    rows = cells.withColumn("positie", _number(F.col("c_positie")))
    number = lambda p: F.nullif(F.regexp_extract("c_weken", p, 1), F.lit("")).cast("int")
    icon = F.lower(F.regexp_extract("c_pijl", r"([^/]*?)(?:\.[^./]*)?$", 1))
    rows = rows.withColumns({"weken_genoteerd": number(WEEKS), "vorige_positie": number(BEFORE), "icoon": icon})
    before = F.col("vorige_positie")
    status = (
        F.when(before.isNull(), F.when(F.col("weken_genoteerd") > 1, "terug").otherwise("nieuw"))
        .when(F.col("icoon") == "up", "stijger").when(F.col("icoon") == "down", "daler").when(F.col("icoon") == "same", "gelijk").when(F.col("icoon") == "new", "terug")
        .when(before == F.col("positie"), "gelijk").when(before > F.col("positie"), "stijger").otherwise("daler")
    )
    fault = F.when(F.col("positie").isNull(), "positie").when((F.coalesce("c_titel", F.lit("")) == "") | (F.coalesce("c_artiest", F.lit("")) == ""), "naam")
    label = F.nullif(F.trim(F.regexp_replace(F.trim("c_label"), r"^\((.*)\)$", "$1")), F.lit(""))
    return rows.withColumns(
        {"titel": F.col("c_titel"), "artiest": F.col("c_artiest"), "site_status": status, "label": label, "kroon": F.col("c_kroon").isNotNull(), "alarmschijf": F.lit(False), "stip": F.lit(0), "fout": fault}
    )


ROW = ("lijst", "jaar", "week", "positie", "titel", "artiest", "label", "weken_genoteerd", "vorige_positie", "site_status", "alarmschijf", "stip", "kroon")


def read_chart_pages(pages: DataFrame, second: list[str], dotted: list[str]) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, lijst, jaar, week, html) -> (rows, rejected(page_id, lijst, jaar, week, fout)).

    Charts of `second` are read by SECOND, the others by FIRST. A page is taken as a whole or not at all: it is rejected if its
    title tells another week than asked ("andere week"), if no row is left ("leeg"), or if a row contradicts itself.
    """
    year, week = page_week(F.col("html"))
    pages = pages.select("page_id", "lijst", "jaar", "week", "html", (year.isNotNull() & ((year != F.col("jaar")) | (week != F.col("week")))).alias("anders"))
    keys = ["page_id", "lijst", "jaar", "week"]
    asked = pages.where(~F.col("anders"))
    first = first_rows(page_cells(asked.where(~F.col("lijst").isin(second)), FIRST), dotted)
    other = second_rows(page_cells(asked.where(F.col("lijst").isin(second)), SECOND))
    rows = first.select("page_id", *ROW, "nr", "fout").unionByName(other.select("page_id", *ROW, "nr", "fout"))
    told = rows.groupBy(*keys).agg(F.min_by("fout", F.when(F.col("fout").isNotNull(), F.col("nr"))).alias("rij"), F.count("*").alias("n"))
    fault = F.when(F.col("anders"), "andere week").when(F.coalesce("n", F.lit(0)) == 0, "leeg").otherwise(F.col("rij"))
    judged = pages.drop("html").join(told, keys, "left").select(*keys, fault.alias("fout"))
    rejected = judged.where("fout is not null")
    return rows.join(rejected.select(*keys), keys, "left_anti").select("page_id", *ROW), rejected
