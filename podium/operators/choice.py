"""Choices whose order counts: each in turn takes its first option whose pieces are still free."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.ordering import ranked
from podium.sources.storage import discard, written


def choose_in_turn(options: DataFrame, group: list[str], order: str = "rang", weak: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """options(group..., wie long, rang, stukken array<long>[, wacht array<long>], ...) -> (the options chosen, who of `weak` let go).

    Within a group the choosers (wie) take turns by falling seniority, the smallest first. Each takes its first option by `rang`
    whose pieces nobody before it has taken; without one it takes none. `weak`(group..., wie) are choosers that hold a piece
    and let go of it at their turn if they take no option; an option that needs such pieces names their holders in `wacht` and
    counts only if all of them have let go before.

    Turns don't run one after the other: in each round all choosers move at once whose first option nobody senior may still
    want, and those without an option left. The smallest one of a group always moves, groups go side by side, and what is
    carried is one table of open options; nothing of a group meets in one task but for the aggregates over its pieces.
    """
    first = options if "wacht" in options.columns else options.withColumn("wacht", F.array().cast("array<long>"))
    open_ = written(first, "opties")
    who = [*group, "wie"]
    chosen: list[DataFrame] = []
    waiting = written((weak if weak is not None else first.where("false")).select(*who).distinct(), "zwak")
    gone = written(waiting.where("false"), "losgelaten")
    while True:
        # holders without an option left let go
        now = waiting.join(open_.select(*who).distinct(), who, "left_anti")
        gone, old = written(gone.unionByName(now), "losgelaten"), gone
        waiting, older = written(waiting.join(gone, who, "left_anti"), "zwak"), waiting
        discard(old, older)
        if open_.isEmpty():
            break
        let_go = gone.select(*group, F.col("wie").alias("houder"), F.lit(True).alias("los"))
        needs = open_.select(*who, order, F.explode("wacht").alias("houder")).join(let_go, [*group, "houder"], "left")
        pending = needs.groupBy(*who, order).agg(F.min(F.coalesce("los", F.lit(False))).alias("klaar"))
        marked = open_.join(pending, [*who, order], "left").withColumn("klaar", F.coalesce("klaar", F.lit(True)))
        best = marked.groupBy(*who).agg(F.min(F.struct(order, "stukken", "klaar")).alias("b")).where("b.klaar")
        best = best.select(*who, F.col(f"b.{order}").alias(order), F.col("b.stukken").alias("stukken"))
        senior = open_.select(*who, F.explode("stukken").alias("stuk")).groupBy(*group, "stuk").agg(F.min("wie").alias("eerste"))
        free = best.withColumn("stuk", F.explode("stukken")).join(senior, [*group, "stuk"]).groupBy(*who, order).agg(F.max((F.col("eerste") < F.col("wie")).cast("int")).alias("bezet"))
        taken = written(open_.join(free.where("bezet = 0").select(*who, order), [*who, order], "left_semi"), "gekozen")
        chosen.append(taken)
        pieces = taken.select(*group, F.explode("stukken").alias("stuk")).distinct()
        dead = open_.select(*who, order, F.explode("stukken").alias("stuk")).join(pieces, [*group, "stuk"], "left_semi")
        kept = taken.select(*group, F.col("wie").alias("houder"))
        never = open_.select(*who, order, F.explode("wacht").alias("houder")).join(kept, [*group, "houder"], "left_semi")
        lost = dead.select(*who, order).unionByName(never.select(*who, order)).distinct()
        rest = open_.join(taken.select(*who).distinct(), who, "left_anti").join(lost, [*who, order], "left_anti")
        waiting, older = written(waiting.join(taken.select(*who).distinct(), who, "left_anti"), "zwak"), waiting
        open_, old = written(rest, "opties"), open_
        discard(old, older)
    out = open_
    for c in chosen:
        out = out.unionByName(c)
    return (out if "wacht" in options.columns else out.drop("wacht")), (gone if weak is not None else None)


def take_in_turn(turns: DataFrame, wishes: DataFrame, stock: DataFrame, group: list[str], block: int = 500_000) -> DataFrame:
    """turns(group..., hun, wie), wishes(group..., wie, soort, score), stock(group..., ons, soort) -> (group..., hun, ons, score).

    Within a group, those of `hun` take turns by id. Each takes the smallest id left of the kinds that its own kind (wie) wishes for
    most; without any left it takes none.

    Kinds stand for all their rows, so what is carried grows with rows and with pairs of kinds, not with pairs of rows. Who takes
    what depends on all turns before, and where many want the same few rows, hardly two turns of a group can be settled side by
    side. So a group's turns go in blocks of about `block` wishes, one block after the other and groups side by side: a task
    holds one block, the wishes of its kinds, and of each kind wished for the next rows, as many as the block can take at most.
    """
    several = wishes.groupBy(*group, "wie").agg(F.count("*").alias("n"))
    placed = ranked(turns.join(several, [*group, "wie"]), [*group, "hun"], "beurt")
    # wishes before a turn, summed by ranges of turns first, so that no task sorts a whole group
    reach = placed.withColumn("vak", F.floor(F.col("beurt") / 10_000))
    vak = reach.groupBy(*group, "vak").agg(F.sum("n").alias("som")).withColumn("voor", F.sum("som").over(Window.partitionBy(*group).orderBy("vak")) - F.col("som")).drop("som")
    own = F.sum("n").over(Window.partitionBy(*group, "vak").orderBy("hun").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    queue = written(reach.withColumn("eigen", own).join(vak, [*group, "vak"]).select(*group, "hun", "wie", F.floor((F.col("voor") + F.col("eigen")) / F.lit(block)).alias("blok")), "beurten")
    stock = written(stock.withColumn("nr", F.row_number().over(Window.partitionBy(*group, "soort").orderBy("ons"))), "voorraad")
    wishes = written(wishes, "wensen")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in turns.select(*group).schema], "hun long, ons long, soort long, score double"])
    blocks = [r[0] for r in queue.select("blok").distinct().orderBy("blok").collect()]
    none = queue.where("false").select(*group, "hun").withColumns({"ons": F.lit(None).cast("long"), "soort": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
    chosen, used = [none], none.groupBy(*group, "soort").agg(F.count("*").alias("op"))
    for b in blocks:
        now = queue.where(F.col("blok") == b)
        asks = now.groupBy(*group, "wie").agg(F.count("*").alias("vragers")).join(wishes, [*group, "wie"])
        most = asks.groupBy(*group, "soort").agg(F.sum("vragers").alias("hoogstens")).join(used, [*group, "soort"], "left").withColumn("op", F.coalesce("op", F.lit(0)))
        ready = stock.join(most, [*group, "soort"]).where((F.col("nr") > F.col("op")) & (F.col("nr") <= F.col("op") + F.col("hoogstens")))
        row = lambda d, a, c, x: d.select(*group, F.col(a).alias("__a"), F.col(c).alias("__b"), x.cast("double").alias("__x"))
        rows = row(asks, "wie", "soort", F.col("score")).unionByName(row(now, "hun", "wie", F.lit(-1))).unionByName(row(ready, "ons", "soort", F.lit(-2)))
        taken = written(rows.groupBy(*group).applyInPandas(lambda key, x: _block(key, x, group), schema), "gekozen")
        chosen.append(taken)
        used = written(used.unionByName(taken.groupBy(*group, "soort").agg(F.count("*").alias("op"))).groupBy(*group, "soort").agg(F.sum("op").alias("op")), "op")
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out.select(*group, "hun", "ons", "score")


def _block(key: tuple, rows: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """One block's turns: rows (__a, __b, __x) are wishes (wie, soort, score), turns (hun, wie, -1) and stock (ons, soort, -2)."""
    a, b, x = (rows[c].to_numpy() for c in ("__a", "__b", "__x"))
    levels: dict = defaultdict(lambda: defaultdict(list))  # of each kind, what it wishes for, by score
    for wie, soort, score in zip(a[x >= 0].tolist(), b[x >= 0].tolist(), x[x >= 0].tolist()):
        levels[wie][score].append(soort)
    wants = {wie: sorted(kinds.items(), reverse=True) for wie, kinds in levels.items()}
    left: dict = defaultdict(list)  # of each kind wished for, the ids, the smallest last
    for ons, soort in sorted(zip(a[x == -2].tolist(), b[x == -2].tolist()), reverse=True):
        left[soort].append(ons)
    out = []
    for hun, wie in sorted(zip(a[x == -1].tolist(), b[x == -1].tolist())):
        for score, kinds in wants[wie]:
            kinds[:] = [k for k in kinds if left.get(k)]
            if kinds:
                first = min(kinds, key=lambda k: left[k][-1])
                out.append((hun, left[first].pop(), first, score))
                break
    found = pd.DataFrame(out, columns=["hun", "ons", "soort", "score"])
    for name, value in zip(reversed(group), reversed(key)):
        found.insert(0, name, value)
    return found
