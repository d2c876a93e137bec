"""Outage intervals: derive them from status polls, overlap them with game windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import WATCH_AFTER, WATCH_BEFORE
from .ordered import ROWS_PER_SEGMENT, Cuts, find_cuts, neighbour

#: Overlap tests are equi joins on dyadic nodes: node n of level k spans 2 ** k base units of 2 ** BASE_BITS
#: seconds (68 minutes). An interval is covered by two nodes a level at most, a point lies in one node of each.
BASE_BITS, TOP_LEVEL = 12, 50


def transitions(polls: DataFrame, keys: list[str], order: list[str], active: str,
                cuts: Cuts | None = None) -> DataFrame:
    """Polls at which the state changes; failed (NULL) polls change nothing.

    Before its first poll a key counts as active. ``cuts`` split the keys with many polls.
    """
    known = polls.filter(F.col(active).isNotNull()).select(*keys, *order, active)
    seen = neighbour(known, keys, order, active, "__was", cuts=cuts)
    return (seen.filter(F.col(active) != F.coalesce(F.col("__was"), F.lit(True)))
            .drop("__was"))


def halts_from_status(polls: DataFrame, keys: list[str], order: list[str], active: str,
                      start: str = "start_ts", end: str = "end_ts",
                      rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Halt intervals: opened by an inactive poll, closed by the next active one.

    A halt without a closing poll keeps a NULL end. ``order`` is an integer time and,
    where times repeat within a key, a sequence.
    """
    # Changes are some of the polls, so the bounds of the polls keep their ranges small too.
    cuts = find_cuts(polls.filter(F.col(active).isNotNull()), keys, order, rows_per_segment)
    changes = transitions(polls, keys, order, active, cuts)
    paired = neighbour(changes, keys, order, order[0], end, "next", cuts)
    return paired.filter(~F.col(active)).select(*keys, F.col(order[0]).alias(start), end)


def ongoing_start(outages: DataFrame, keys: list[str], start: str = "start_ts",
                  end: str = "end_ts") -> DataFrame:
    """Latest start of a still open outage per key."""
    return (outages.filter(F.col(end).isNull())
            .groupBy(*keys).agg(F.max(start).alias(start)))


def recent_outages(outages: DataFrame, order: list[str | Column], n: int = 10) -> DataFrame:
    """The ``n`` latest outages; ``order`` ends with a unique column."""
    return outages.orderBy(*order).limit(n)


def dyadic_cover(lo: Column, hi: Column) -> Column:
    """Disjoint (level, node) that cover the seconds [lo, hi]; empty where hi is below lo.

    Nodes inside are covered whole; those of level 0 at the ends maybe in part.
    """
    ends = F.struct(F.shiftright(lo.cast("bigint"), BASE_BITS).alias("a"), (F.shiftright(hi.cast("bigint"), BASE_BITS) + 1).alias("b"), (lo <= hi).alias("some"))

    def at_level(e: Column, level: Column) -> Column:
        # Rounded inward to nodes of the level; what sticks out beyond a pair of them is a node of the cover.
        a = -F.call_function("shiftright", -e["a"], level)
        b = F.call_function("shiftright", e["b"], level)
        inside = e["some"] & (a < b)
        left = F.when(inside & (F.pmod(a, F.lit(2)) == 1), a)
        right = F.when(inside & (F.pmod(b, F.lit(2)) == 1), b - 1)
        return F.array(*[F.when(n.isNotNull(), F.struct(level.alias("level"), n.alias("node"))) for n in (left, right)])

    levels = F.sequence(F.lit(0), F.lit(TOP_LEVEL))
    nodes = F.transform(F.array(ends), lambda e: F.flatten(F.transform(levels, lambda level: at_level(e, level))))
    return F.filter(F.flatten(nodes), lambda n: n.isNotNull())


def dyadic_node(at: Column, level: Column) -> Column:
    """The node of a level in which a point lies."""
    return F.call_function("shiftright", F.shiftright(at.cast("bigint"), BASE_BITS), level)


def _covered(outages: DataFrame, now: Column | int, before: int, after: int, start: str, end: str) -> DataFrame:
    """Outages widened by the game window, one row for each node of their cover.

    An anchor g has an overlapping outage exactly when g lies in [start - after, end + before],
    so games are points. An outage of ten years has less than forty rows.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    wide = outages.withColumn("__lo", F.col(start) - after).withColumn("__hi", F.coalesce(F.col(end), now) + before)
    return wide.withColumn("__n", F.explode(dyadic_cover(F.col("__lo"), F.col("__hi")))).select(
        *wide.columns, F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node"))


def _points(games: DataFrame, anchor: str, covered: DataFrame) -> DataFrame:
    """Games with an anchor, one row for each level that the covers use."""
    used = covered.agg(F.collect_set("__level")).scalar()
    return (games.filter(F.col(anchor).isNotNull()).withColumn("__levels", used)
            .withColumn("__level", F.explode("__levels")).drop("__levels")
            .withColumn("__node", dyadic_node(F.col(anchor), F.col("__level"))))


def interval_overlap(games: DataFrame, outages: DataFrame, on: list[str], anchor: str,
                     now: Column | int, *, before: int = WATCH_BEFORE, after: int = WATCH_AFTER,
                     start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Every (game, outage) pair where the outage overlaps [anchor - before, anchor + after].

    An open outage lasts until ``now``, which is an argument so that results repeat.
    """
    wide = _covered(outages, now, before, after, start, end)
    return (_points(games, anchor, wide).join(wide, [*on, "__level", "__node"])
            .filter((F.col(anchor) >= F.col("__lo")) & (F.col(anchor) <= F.col("__hi")))
            .drop("__level", "__node", "__lo", "__hi"))


def overlapping_games(games: DataFrame, outages: DataFrame, on: list[str], anchor: str,
                      now: Column | int, *, before: int = WATCH_BEFORE, after: int = WATCH_AFTER,
                      start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Games whose window overlaps at least one outage.

    Equal rows come out once. Per key and node all outages that cover it whole are one row, and those beginning at the same
    second shrink to the longest, so a node of level 0 has at most 2 ** BASE_BITS rows.
    """
    wide = _covered(outages, now, before, after, start, end)
    low = F.call_function("shiftleft", F.col("__node"), F.col("__level") + BASE_BITS)
    high = F.call_function("shiftleft", F.col("__node") + 1, F.col("__level") + BASE_BITS) - 1
    merged = (wide.select(*on, "__level", "__node", F.greatest("__lo", low).alias("__lo"), F.least("__hi", high).alias("__hi"))
              .groupBy(*on, "__level", "__node", "__lo").agg(F.max("__hi").alias("__hi")))
    g, m = _points(games, anchor, wide).alias("g"), merged.alias("o")
    cond = F.lit(True)
    for k in [*on, "__level", "__node"]:
        cond = cond & (F.col(f"g.{k}") == F.col(f"o.{k}"))
    cond = cond & (F.col(f"g.{anchor}") >= F.col("o.__lo")) & (F.col(f"g.{anchor}") <= F.col("o.__hi"))
    # A game may be found on several levels.
    return g.join(m, cond, "left_semi").drop("__level", "__node").distinct()


def flag_outages(markets: DataFrame, outages: DataFrame, now: Column | int, *,
                 on: list[str] | None = None, key: list[str] | None = None,
                 anchor: str = "game_start_ts", flag: str = "outage_affected",
                 before: int = WATCH_BEFORE, after: int = WATCH_AFTER) -> DataFrame:
    """Set the flag of markets whose window overlaps an outage; a set flag stays set."""
    on = on or ["platform"]
    key = key or ["platform", "market_id"]
    hit = (overlapping_games(markets.select(*dict.fromkeys([*key, *on, anchor])), outages, on,
                             anchor, now, before=before, after=after)
           .select(*key).withColumn("__hit", F.lit(True)))
    kind = markets.schema[flag].dataType if flag in markets.columns else "smallint"
    old = F.col(flag) if flag in markets.columns else F.lit(0)
    return (markets.join(hit, key, "left")
            .withColumn(flag, F.when(F.col("__hit"), F.lit(1)).otherwise(F.coalesce(old, F.lit(0)))
                        .cast(kind))
            .drop("__hit"))
