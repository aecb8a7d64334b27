"""Files of an archive: matrices of annual charts, tables with comments, series as JSON, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.operators.ordering import ranked


def edition_label() -> Column:
    """"2021", or "2021w52" where a chart has several editions in a year."""
    several = F.count("*").over(Window.partitionBy("lijst", "jaar")) > 1
    return F.when(several, F.concat_ws("w", F.col("jaar").cast("string"), F.lpad(F.col("week").cast("string"), 2, "0"))).otherwise(F.col("jaar").cast("string"))


def write_matrix(entries: DataFrame, path: str, chart: str) -> None:
    """A chart as a semicolon file: TotaalPositie;Artiest;Titel, then a column for each edition with positions, 0 where absent,
    in the order of best position, most editions, key."""
    rows = entries.where(F.col("lijst") == chart)
    labels = rows.select("lijst", "jaar", "week").distinct().withColumn("editie", edition_label())
    names = [r[0] for r in labels.select("editie").distinct().orderBy("editie").collect()]  # a chart's editions: at most some hundred
    wide = rows.join(labels, ["lijst", "jaar", "week"]).groupBy("sleutel").pivot("editie", names).agg(F.min("positie"))
    of = rows.groupBy("sleutel").agg(F.max_by("artiest", F.struct("jaar", "week", "positie")).alias("Artiest"), F.max_by("titel", F.struct("jaar", "week", "positie")).alias("Titel"), F.min("positie").alias("b"), F.count("*").alias("n"))
    out = ranked(of.join(wide.fillna(0), "sleutel"), [F.col("b"), F.desc("n"), F.col("sleutel")], "TotaalPositie")
    out.select("TotaalPositie", "Artiest", "Titel", *[F.col(f"`{n}`") for n in names]).orderBy("TotaalPositie").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, chart: str, edition_week: int = 52, encoding: str = "utf-8") -> DataFrame:
    """A file of write_matrix -> (lijst, jaar, week, positie, titel, artiest): 0 and blanks are absences; a heading 2021w40 names
    the week, 2021 alone stands for edition_week."""
    wide = spark.read.option("sep", ";").option("header", True).option("encoding", encoding).csv(path)
    editions = [c for c in wide.columns if c[:4].isdigit()]
    long = wide.unpivot(["Artiest", "Titel"], [F.col(f"`{c}`") for c in editions], "editie", "positie")
    long = long.withColumn("positie", F.try_to_number(F.trim("positie"), F.lit("99999")).cast("int")).where("positie > 0")
    week = F.coalesce(F.nullif(F.regexp_extract("editie", r"w(\d+)$", 1), F.lit("")).cast("int"), F.lit(edition_week))
    return long.select(F.lit(chart).alias("lijst"), F.substring("editie", 1, 4).cast("int").alias("jaar"), week.alias("week"), "positie", F.col("Titel").alias("titel"), F.col("Artiest").alias("artiest"))


def parse_commented(lines: DataFrame, separator: str = ";") -> DataFrame:
    """lines(nr, regel) -> (van, naar, opmerking): pairs, each with the block of # lines above it; a blank line ends a block.

    Blocks are told by running counts over nr within a file, so files of any number are read side by side by `bestand` if that
    column is there.
    """
    file = [c for c in ("bestand",) if c in lines.columns]
    order = Window.partitionBy(*file, *([] if file else [F.lit(1)])).orderBy("nr")
    rows = lines.withColumn("r", F.trim("regel")).withColumn("soort", F.when(F.col("r") == "", 0).when(F.col("r").startswith("#"), 1).otherwise(2))
    start = (F.col("soort") == 0) | ((F.col("soort") == 1) & (F.coalesce(F.lag("soort").over(order), F.lit(0)) != 1))
    rows = rows.withColumn("blok", F.sum(start.cast("int")).over(order))
    note = rows.where("soort = 1").groupBy(*file, "blok").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", F.trim(F.regexp_replace("r", "^#+", "")).alias("x")))), lambda s: s["x"]), " ").alias("opmerking"))
    parts = F.split("r", F.lit(separator))
    return rows.where((F.col("soort") == 2) & (F.size(parts) > 1)).select(*file, "nr", "blok", F.trim(F.get(parts, 0)).alias("van"), F.trim(F.get(parts, 1)).alias("naar")).join(note, [*file, "blok"], "left").select(*file, "nr", "van", "naar", F.coalesce("opmerking", F.lit("")).alias("opmerking"))


def series_json(series: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A JSON array for each key: its rows in order, as objects of the values (nulls left out)."""
    item = F.struct(*order, F.to_json(F.struct(*values)).alias("j"))
    return series.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["j"]), ","), F.lit("]")).alias("json"))


def append_log(changes: DataFrame, path: str, reason: str) -> None:
    """Adds rows of changes with the reason and the time to a log that is never rewritten."""
    changes.withColumn("reden", F.lit(reason)).withColumn("tijdstip", F.localtimestamp()).write.mode("append").parquet(path)


def playlist(rows: DataFrame) -> DataFrame:
    """rows(plek, artiest, titel, pad) -> (plek, regel): the lines of a playlist, two for each song that has a file."""
    head = F.concat(F.lit("#EXTINF:-1,"), "artiest", F.lit(" - "), "titel")
    return rows.where("pad is not null").select("plek", F.posexplode(F.array(head, F.col("pad"))).alias("nr", "regel")).select((F.col("plek") * 2 + F.col("nr") - 1).alias("nr"), "regel")


def page_week(pages: DataFrame) -> DataFrame:
    """pages(page_id, titel) -> with jaar and week read from the title ("week 12, 2021" or "2021 week 12"), null if neither."""
    week = F.nullif(F.regexp_extract("titel", r"(?i)\bweek\s+(\d{1,2})\b", 1), F.lit("")).cast("int")
    year = F.nullif(F.regexp_extract("titel", r"\b((?:19|20)\d\d)\b", 1), F.lit("")).cast("int")
    return pages.withColumn("jaar", year).withColumn("week", week)
