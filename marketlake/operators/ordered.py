"""Ordered scans per key that stay balanced when one key holds much of the data.

A window partitioned by key alone sends every row of a key to one task. Here all rows are
cut into ranges of (key, time, sequence): the window runs per (range, key), and one boundary
row for each range is carried forward to the ranges after it. The bounds come from a sample of
the key and order columns inside the query itself, so building a plan starts no job, no key is
counted, and any key can be cut: a NULL key, many equal ones, or one whose rows share an instant.
Tables of up to ``rows_per_segment`` rows have no bounds and are one range.

The order columns must not repeat within a key, which the table keys guarantee.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows one task sorts comfortably.
ROWS_PER_SEGMENT = 4_000_000
#: Most ranges of a table, and sampled rows for each range.
MOST_SEGMENTS, SAMPLED = 1 << 16, 16

SEGMENT = "__segment"
_CUTS = "__cuts"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join on keys of which NULL equals NULL; the keys come from the left."""
    names = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, name in names.items():
        cond = cond & left[k].eqNullSafe(right[name])
    return left.join(right, cond, how).drop(*names.values())


@dataclass(frozen=True)
class Cuts:
    """Bounds between ranges of (keys, order): one row with a sorted array of structs, maybe empty."""

    keys: list[str]
    order: list[str]
    bounds: DataFrame

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the number of the row's range: how many bounds are at or below the row."""
        place = F.struct(*[F.col(c) for c in (*self.keys, *self.order)])
        return (df.withColumn(_CUTS, self.bounds.scalar())
                .withColumn(SEGMENT, cut_index(F.col(_CUTS), place, MOST_SEGMENTS)).drop(_CUTS))

    def split(self, df: DataFrame) -> DataFrame:
        """The same where there are bounds; of an uncut table, which carries nothing, no rows."""
        place = F.struct(*[F.col(c) for c in (*self.keys, *self.order)])
        return (df.withColumn(_CUTS, self.bounds.scalar()).filter(F.size(_CUTS) > 0)
                .withColumn(SEGMENT, cut_index(F.col(_CUTS), place, MOST_SEGMENTS)).drop(_CUTS))

    def numbers(self) -> DataFrame:
        """(range): the numbers of all ranges of a cut table, a few rows."""
        return self.bounds.filter(F.size(_CUTS) > 0).select(F.explode(F.sequence(F.lit(0), F.size(_CUTS))).alias(SEGMENT))

    def carried(self, edges: DataFrame, value: Column, *, back: bool = True) -> DataFrame:
        """(range, ``__carry``): ``value`` over the ranges before (or after) each range.

        ``edges`` has one row for each range, so this table has few rows whatever the input and
        is sent to every task.
        """
        order = F.col(SEGMENT).asc() if back else F.col(SEGMENT).desc()
        before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.broadcast(edges.select(SEGMENT, F.last(value, ignorenulls=True).over(before).alias("__carry")))


def key_struct(keys: list[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def cut_index(cuts: Column, x: Column, most: int = 4096) -> Column:
    """Number of sorted ``cuts`` (at most ``most``) not above ``x``, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length(), -1, -1)])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= x, at + step).otherwise(at))
    return F.when(F.coalesce(F.size(cuts), F.lit(0)) <= 0, F.lit(0)).otherwise(found)


def find_cuts(df: DataFrame, keys: list[str], order: list[str],
              rows_per_segment: int | None = ROWS_PER_SEGMENT) -> Cuts | None:
    """Bounds that cut a table into ranges of about ``rows_per_segment`` rows; None cuts nothing.

    No job runs here. The query that uses the bounds counts the rows, keeps those whose hash is
    below a limit (about ``SAMPLED`` for each range, the same ones in every run) and takes every
    ``SAMPLED``-th of them in order; both read the key and order columns only.
    """
    if rows_per_segment is None:
        return None
    rows = df.select(*dict.fromkeys([*keys, *order]))
    # Hashes below this share of 2 ** 62 are kept; a table of one range keeps none.
    n = F.count(F.lit(1)).cast("double")
    pieces = F.least(F.ceil(n / rows_per_segment), F.lit(MOST_SEGMENTS))
    limit = rows.agg(F.when(n > rows_per_segment, F.least(F.lit(1.0), pieces * SAMPLED / n) * float(1 << 62)).otherwise(0.0).cast("bigint"))
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in (*keys, *order)]), 2)
    place = F.struct(*[F.col(c) for c in (*keys, *order)])
    sample = (rows.withColumn("__limit", limit.scalar()).filter(hashed < F.col("__limit"))
              .agg(F.array_sort(F.array_distinct(F.collect_list(place))).alias("__sample")))
    every = F.transform(F.sequence(F.lit(1), F.floor(F.size("__sample") / SAMPLED).cast("int") - 1),
                        lambda i: F.get("__sample", i * SAMPLED))
    bounds = sample.select(F.when(F.size("__sample") >= 2 * SAMPLED, every).otherwise(F.slice("__sample", 1, 0)).alias(_CUTS))
    return Cuts(keys, order, bounds)


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
              direction: str = "previous", cuts: Cuts | None = None,
              found: str | None = None) -> DataFrame:
    """Add the value of the previous (or next) row of the key as ``out``.

    ``found`` optionally names a BOOLEAN column telling a missing neighbour from a NULL value.
    """
    step = F.lag if direction == "previous" else F.lead
    boxed = F.struct(F.col(value).alias("v"))
    if cuts is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        res = df.withColumn("__box", step(boxed).over(w))
    else:
        w = Window.partitionBy(SEGMENT, *keys).orderBy(*order)
        edge = F.max_by if direction == "previous" else F.min_by
        edges = (cuts.split(df.select(*dict.fromkeys([*keys, *order, value]))).groupBy(SEGMENT)
                 .agg(edge(F.struct(key_struct(keys).alias("k"), boxed.alias("b")), F.struct(*keys, *order)).alias("__edge")))
        carry = cuts.carried(edges, F.col("__edge"), back=direction == "previous")
        # The nearest range's edge row counts where it is of the same key; nothing of that key lies beyond another.
        same = key_struct(keys).eqNullSafe(F.col("__carry.k"))
        res = (cuts.assign(df).withColumn("__box", step(boxed).over(w)).join(carry, SEGMENT, "left")
               .withColumn("__box", F.coalesce("__box", F.when(same, F.col("__carry.b"))))
               .drop("__carry", SEGMENT))
    res = res.withColumn(out, F.col("__box.v"))
    if found:
        res = res.withColumn(found, F.col("__box").isNotNull())
    return res.drop("__box")


def running(df: DataFrame, keys: list[str], order: list[str], out: str, fold, merge,
            cuts: Cuts | None = None, part=None) -> DataFrame:
    """Add a running aggregate over each key's rows up to and including the current one.

    ``fold()`` is the aggregate over rows and ``part()`` the same over a range
    (default ``fold``); ``merge.over(col, window)`` aggregates the ranges' results, and the
    carried and local values are combined with ``merge.join(carried, local)``.
    """
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    if cuts is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*up_to_here)
        return df.withColumn(out, fold().over(w))
    w = Window.partitionBy(SEGMENT, *keys).orderBy(*order).rowsBetween(*up_to_here)
    # Only a range's last key can go on in the next one.
    edges = (cuts.split(df).groupBy(SEGMENT, *keys).agg((part or fold)().alias("__part"))
             .groupBy(SEGMENT).agg(F.max_by(F.struct(key_struct(keys).alias("k"), F.col("__part").alias("p")), F.struct(*keys)).alias("__edge")))
    so_far = Window.partitionBy("__edge.k").orderBy(SEGMENT).rowsBetween(*up_to_here)
    edges = edges.withColumn("__sum", F.struct(F.col("__edge.k").alias("k"), merge.over(F.col("__edge.p"), so_far).alias("v")))
    carry = cuts.carried(edges, F.col("__sum"))
    same = key_struct(keys).eqNullSafe(F.col("__carry.k"))
    return (cuts.assign(df).withColumn(out, fold().over(w)).join(carry, SEGMENT, "left")
            .withColumn(out, merge.join(F.when(same, F.col("__carry.v")), F.col(out)))
            .drop("__carry", SEGMENT))


class Sum:
    """Merge rule of running sums and counts."""

    @staticmethod
    def over(part: Column, window) -> Column:
        return F.sum(part).over(window)

    @staticmethod
    def join(carried: Column, local: Column) -> Column:
        return F.coalesce(carried, F.lit(0)) + local


class SetUnion:
    """Merge rule of running sets; their size is bounded by the distinct values."""

    @staticmethod
    def over(part: Column, window) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(part).over(window)))

    @staticmethod
    def join(carried: Column, local: Column) -> Column:
        return F.when(carried.isNull(), local).otherwise(F.array_union(carried, local))
