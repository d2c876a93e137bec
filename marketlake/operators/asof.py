"""As-of joins: the last tick at or before, the first at or after, the nearest in time.

Ticks and probes are unioned and sorted once per key, so the work is linear in their number
and no pairs are formed. Large tables are cut into ranges of (key, time), with the last tick of
a range carried forward (see :mod:`.ordered`); repeated probes of one instant, and ticks of one
instant under numeric ties, may lie in several ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.times import micros
from .ordered import ROWS_PER_SEGMENT, SEGMENT, Cuts, find_cuts, key_struct

_T, _TICK, _TIE, _PROBE, _SALT, _IS_PROBE, _RANK = "__t", "__tick", "__tie", "__probe", "__salt", "__is_probe", "__rank"
#: Ranges over which probes without a key are spread.
_KEYLESS = 4096


@dataclass(frozen=True)
class _Side:
    """Both inputs reduced to key, time and payload."""

    keys: list[str]
    ticks: DataFrame
    probes: DataFrame


def _as_long(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType.typeName()
    return micros(F.col(col)) if kind.startswith("timestamp") else F.col(col).cast("bigint")


def _not_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _prepare(probes, ticks, on, probe_time, tick_time, values, tie, ahead: bool) -> _Side:
    tie_col = F.col(tie) if tie else F.lit(None).cast("int")
    payload = F.struct(F.col(tick_time).alias("at"), *[F.col(v) for v in values])
    t = ticks.filter(_not_null([*on, tick_time])).select(*on, _as_long(ticks, tick_time).alias(_T), tie_col.alias(_TIE), payload.alias(_TICK))
    if not ahead and (tie is None or isinstance(t.schema[_TIE].dataType, NumericType)):
        # Ticks of one instant in the order in which the last one is wanted.
        t = t.withColumn(_RANK, (-F.col(_TIE)).cast("double")).withColumn(_SALT, F.xxhash64(_TICK))
    else:
        best = F.struct(F.col(_TIE).isNull().alias("none"), F.col(_TIE).alias("tie"))
        t = (t.groupBy(*on, _T).agg(F.min_by(F.struct(_TIE, _TICK), best).alias("__b"))
             .select(*on, _T, F.col(f"__b.{_TIE}").alias(_TIE), F.col(f"__b.{_TICK}").alias(_TICK),
                     F.lit(None).cast("double").alias(_RANK), F.lit(0).cast("bigint").alias(_SALT)))
    p = probes.select(*on, _as_long(probes, probe_time).alias(_T), F.lit(None).cast("double").alias(_RANK),
                      F.xxhash64(*probes.columns).alias(_SALT), F.struct(*probes.columns).alias(_PROBE))
    return _Side(on, t.drop(_TIE), p)


def _union(ticks: DataFrame, probes: DataFrame) -> DataFrame:
    return (ticks.withColumn(_IS_PROBE, F.lit(False))
            .unionByName(probes.withColumn(_IS_PROBE, F.lit(True)), allowMissingColumns=True))


#: Ticks of one instant come before its probes, the smallest tie value last.
_ORDER = [_T, _IS_PROBE, _RANK, _SALT]


def _scan(u: DataFrame, keys: list[str], found: str, direction: str, cuts: Cuts | None, ticks: DataFrame) -> DataFrame:
    """Add the last tick so far as ``found``; ``direction`` forward reads time backward."""
    back = direction == "backward"
    t = F.col(_T).asc() if back else F.col(_T).desc()
    w = (Window.partitionBy(SEGMENT, *keys).orderBy(t, *_ORDER[1:])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn(found, F.last(_TICK, ignorenulls=True).over(w))
    if cuts is None:
        return u
    edge = F.max_by if back else F.min_by
    rows = cuts.split(ticks.withColumn(_IS_PROBE, F.lit(False)))
    edges = rows.groupBy(SEGMENT).agg(
        edge(F.struct(key_struct(keys).alias("k"), F.col(_TICK).alias("v")), F.struct(*keys, *_ORDER)).alias("__edge"))
    # Ranges without ticks have no row among the edges, but a carry all the same.
    every = edges.unionByName(cuts.numbers(), allowMissingColumns=True).groupBy(SEGMENT).agg(F.first("__edge", ignorenulls=True).alias("__edge"))
    carry = cuts.carried(every, F.col("__edge"), back=back)
    same = key_struct(keys) == F.col("__carry.k")
    return (u.join(carry, SEGMENT, "left")
            .withColumn(found, F.coalesce(found, F.when(same, F.col("__carry.v")))).drop("__carry"))


def _lookup(side: _Side, directions: dict[str, str], rows_per_segment: int | None) -> DataFrame:
    """Probe rows (``__probe``) with one tick struct per requested direction."""
    keys = side.keys
    columns = [*keys, *_ORDER]
    every = _union(side.ticks.select(*keys, _T, _RANK, _SALT), side.probes.filter(_not_null(keys)).select(*keys, _T, _RANK, _SALT))
    cuts = find_cuts(every.select(*columns), keys, _ORDER, rows_per_segment)
    # Ticks of the probed keys only; the planner picks the join by the real size of the keys.
    names = side.probes.filter(_not_null(keys)).select(*keys).distinct()
    u = _union(side.ticks.join(names, keys, "left_semi"), side.probes)
    u = cuts.assign(u) if cuts is not None else u.withColumn(SEGMENT, F.lit(0))
    # Probes without a key find nothing; they are spread instead of meeting in one task.
    u = u.withColumn(SEGMENT, F.when(_not_null(keys), F.col(SEGMENT)).otherwise(F.pmod(_SALT, F.lit(_KEYLESS)).cast("int")))
    for name, direction in directions.items():
        u = _scan(u, keys, name, direction, cuts, side.ticks)
    return u.filter(_IS_PROBE).select(_PROBE, *directions)


def asof_backward(probes: DataFrame, ticks: DataFrame, on: list[str], probe_time: str,
                  tick_time: str, values: list[str], *, tie: str | None = None,
                  earliest: Column | None = None, at: str | None = None,
                  rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Each probe with the tick values last known at its time.

    The tick is chosen first; a NULL value in it stays NULL, and a tick older
    than ``earliest`` (an expression over probe columns, in the tick time's unit)
    gives NULL. ``tie`` picks the smallest value among ticks of one instant.
    ``at`` adds the chosen tick's time. Both times must be of one kind
    (timestamps, or integers in the same unit).
    """
    side = _prepare(probes, ticks, on, probe_time, tick_time, values, tie, False)
    res = _lookup(side, {"__found": "backward"}, rows_per_segment)
    res = res.select(f"{_PROBE}.*", F.col("__found"))
    ok = F.col("__found").isNotNull()
    if earliest is not None:
        ok = ok & (F.col("__found.at") >= earliest)
    picked = [F.when(ok, F.col(f"__found.{v}")).alias(v) for v in values]
    if at:
        picked.append(F.when(ok, F.col("__found.at")).alias(at))
    return res.select(*probes.columns, *picked)


def asof_cutoff(ticks: DataFrame, cutoffs: DataFrame, on: list[str], cutoff: str,
                tick_time: str, values: list[str], *, tie: str | None = None,
                at: str | None = None) -> DataFrame:
    """Per key with one cutoff: the values of its last tick at or before the cutoff.

    Keys without such a tick are left out. ``cutoffs`` has one row per key; it is
    broadcast when small enough, and then only partial maxima are shuffled.
    """
    when = F.struct(F.col(tick_time), -F.col(tie)) if tie else F.col(tick_time)
    picked = [F.max_by(F.col(v), when).alias(v) for v in values]
    if at:
        picked.append(F.max(tick_time).alias(at))
    needed = list(dict.fromkeys([*on, tick_time, *values, *([tie] if tie else [])]))
    return (ticks.select(*needed)
            .join(cutoffs.select(*on, F.col(cutoff).alias("__cutoff")), on)
            .filter(F.col(tick_time) <= F.col("__cutoff"))
            .groupBy(*on).agg(*picked))


def nearest(probes: DataFrame, targets: DataFrame, on: list[str], probe_time: str,
            target_time: str, values: list[str], *, tie: str, tolerance: int,
            distance: str = "distance",
            rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Each probe with its nearest target in time within ``tolerance`` (inclusive).

    Equal distances go to the smallest ``tie``. Probes without a target are left
    out. Times are integers in the tolerance's unit.
    """
    cols = list(dict.fromkeys([tie, *values]))
    side = _prepare(probes, targets, on, probe_time, target_time, cols, tie, True)
    res = _lookup(side, {"__b": "backward", "__f": "forward"}, rows_per_segment)
    res = res.select(f"{_PROBE}.*", "__b", "__f")
    t = F.col(probe_time)
    back, ahead = t - F.col("__b.at"), F.col("__f.at") - t
    use_back = (F.col("__f").isNull() | (back < ahead)
                | ((back == ahead) & (F.col(f"__b.{tie}") <= F.col(f"__f.{tie}"))))
    use_back = F.col("__b").isNotNull() & F.coalesce(use_back, F.lit(False))
    best = F.when(use_back, F.col("__b")).otherwise(F.col("__f"))
    dist = F.when(use_back, back).otherwise(ahead)
    return (res.select(*probes.columns, best.alias("__best"), dist.alias(distance))
            .filter(F.col(distance) <= tolerance)
            .select(*probes.columns, distance, *[F.col(f"__best.{v}").alias(v) for v in values]))
