"""Write rules as table operators.

Parquet has no update in place: logs are append-only and the current table is
derived with one of these rules and written to a new path. Each is one shuffle
on the key with map-side combining, so copies of one key meet already reduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_merge(log: DataFrame, keys: list[str], seq: list[str], columns: list[str],
                   seen: str | None = None, first_seen: str = "first_seen_ts",
                   last_seen: str = "last_seen_ts", raw: str | None = None) -> DataFrame:
    """Per key the most recent non-NULL value of each column.

    ``seq`` is the ingest order (unique within a key). ``seen`` is the sighting
    time: its first value by order becomes ``first_seen``, its last ``last_seen``.
    An empty ``raw`` document counts as NULL.
    """
    order = F.struct(*seq) if len(seq) > 1 else F.col(seq[0])

    def latest(c):
        value = F.col(c)
        if c == raw:
            value = F.when(~F.trim(value).isin("", "{}", "null"), value)
        return F.max_by(value, F.when(value.isNotNull(), order)).alias(c)

    aggs = [latest(c) for c in columns]
    if seen:
        aggs += [F.min_by(seen, order).alias(first_seen), F.max_by(seen, order).alias(last_seen)]
    return log.groupBy(*keys).agg(*aggs)


def _one_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    # row_number() = 1 is reduced per map task before the shuffle (WindowGroupLimit).
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def new_rows(incoming: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(target.select(*keys), keys, "left_anti").select(*incoming.columns)


def insert_if_absent(incoming: DataFrame, keys: list[str], seq: list[str],
                     target: DataFrame | None = None) -> DataFrame:
    """Rows to append: the first per key by ``seq``, minus keys already in ``target``."""
    first = _one_per_key(incoming, keys, seq)
    return first if target is None else new_rows(first, target, keys)


def last_write_wins(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The latest row per key by ``seq``."""
    return _one_per_key(log, keys, [F.col(s).desc() for s in seq])


def partial_upsert(target: DataFrame, incoming: DataFrame, keys: list[str],
                   update: list[str]) -> DataFrame:
    """Insert new keys whole; for stored keys replace only the ``update`` columns.

    Both sides have one row per key.
    """
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest).alias("__old"))
    new = incoming.select(*keys, F.struct(*rest).alias("__new"))
    stored, given = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def pick(c):
        take_new = given if c in update else (given & ~stored)
        return F.when(take_new, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)

    return (old.join(new, keys, "full_outer")
            .select(*[F.col(k) if k in keys else pick(k) for k in target.columns]))


def set_fields(target: DataFrame, patch: DataFrame, keys: list[str], fields: list[str],
               greatest: list[str] = ()) -> DataFrame:
    """Overwrite ``fields`` of the keys named in ``patch`` (one row per key).

    A NULL in the patch keeps the old value; ``greatest`` columns never step back.
    """
    new = patch.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = target.join(new, keys, "left")

    def pick(c):
        if c not in fields:
            return F.col(c)
        pair = (F.col(f"__{c}"), F.col(c))
        return (F.greatest(*pair) if c in greatest else F.coalesce(*pair)).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def close_open_intervals(outages: DataFrame, closings: DataFrame, keys: list[str],
                         end: str = "end_ts") -> DataFrame:
    """Set the end of every open interval of the keys in ``closings`` (one row per key)."""
    at = closings.select(*keys, F.col(end).alias("__at"))
    return (outages.join(at, keys, "left")
            .withColumn(end, F.coalesce(end, "__at"))
            .select(*outages.columns))


def current_outages(openings: DataFrame, closings: DataFrame, keys: list[str],
                    start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Outage table from a log of openings and a log of dated ends for the same start.

    Openings are equal per (key, start) up to their note; the latest known end is set.
    """
    whole = [*keys, start]
    known = closings.groupBy(*whole).agg(F.max(end).alias("__end"))
    base = openings.groupBy(*whole).agg(
        *[F.min(c).alias(c) for c in openings.columns if c not in whole])
    return (base.join(known, whole, "left")
            .withColumn(end, F.coalesce("__end", end)).select(*openings.columns))

