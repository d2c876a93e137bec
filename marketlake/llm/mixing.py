"""Mixing sources to target weights by fractional repetition; built-in functions only.

Words are added up for each source. Weights share a budget of words among the sources, no
source beyond ``most`` times its size, and a document of a source with repetition rate r is
emitted floor(r) times plus once more with probability r - floor(r), decided by a seeded hash
of its id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the source table up to which it is sent to every task.
SMALL_BYTES = 8_000_000


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code-point order, NULL last; the sources share
    ``percent`` of all words, none more than ``most`` times its own."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most: int = 2
    seed: int = 20240301


def words(text: str) -> str:
    """SQL: number of words of a text, 0 without text."""
    return f"cast(coalesce(regexp_count(`{text}`, r'{WORD}'), 0) as long)"


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """Rows with their place (from 0) in an order, by ranges: no task holds all rows.

    Each range counts its own rows and one number for each range carries the places on.
    """
    dealt = rows.repartitionByRange(*order).withColumn("range_of", F.spark_partition_id())
    local = Window.partitionBy("range_of").orderBy(*order)
    placed = materialize(dealt.withColumn("place", F.row_number().over(local) - 1), "numbered")
    counts = placed.groupBy("range_of").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "range_of").withColumn(name, F.col("start") + F.col("place")).drop("range_of", "place", "start")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, source_size), one row a source.

    Each round adds the sources whose share is above their cap to the capped ones and shares the
    rest anew by weight; three sums of a round reach the driver. A share is kept as the two whole
    numbers of a fraction, so rounding caps nobody.
    """
    spread = ", ".join(map(str, mix.weights))
    rows = numbered(sizes, [F.col("source").asc_nulls_last()]).withColumn(
        "weight", F.expr(f"cast(array({spread})[cast(number % {len(mix.weights)} as int)] as decimal(20, 0))"))
    size = F.col("source_size").cast("decimal(20, 0)")
    rows = materialize(rows.select("source", "source_size", "weight", size.alias("s")), "sources")
    # In hundredths of a word: source i has the share weight * above / below unless 100 * most * s is less.
    cap = 100 * mix.most * F.col("s")
    whole = int(rows.agg(F.sum("s")).first()[0] or 0) * mix.percent
    above, below, capped = whole, int(rows.agg(F.sum("weight")).first()[0] or 0), -1
    while below:
        over = cap * F.lit(below) < F.col("weight") * F.lit(above)
        n, caps, weight = rows.where(over).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == capped:
            break
        total = int(rows.agg(F.sum("weight")).first()[0])
        capped, above, below = n, whole - int(caps or 0), total - int(weight or 0)
    share = F.col("weight").cast("double") * F.lit(float(above)) / F.lit(100.0 * max(below, 1))
    full = (cap * F.lit(below) < F.col("weight") * F.lit(above)) if below else F.lit(True)
    return rows.select("source", "source_size", F.col("weight").cast("int").alias("weight"),
                       F.when(full, (mix.most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the seed and the id; equal ids draw alike."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _plan(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """Targets of all sources, and whether the table is small enough to be sent to every task."""
    table = materialize(targets(sizes, mix), "targets")
    held = table.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    table = table.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_size"), F.col("target").alias("mix_target"))
    return table, held <= SMALL_BYTES


def _copies(rows: DataFrame, plan: tuple[DataFrame, bool], mix: Mix, doc_id: str, source: str) -> tuple[DataFrame, DataFrame, Column]:
    """Rows met with their source's target, that table, and the expression of a row's copies.

    A small table goes to every task; else Spark joins by source and splits a hot one.
    """
    table, small = plan
    met = rows.join(F.broadcast(table) if small else table, rows[source].eqNullSafe(table["mix_source"]))
    rate = F.when(table["mix_size"] > 0, table["mix_target"] / table["mix_size"]).otherwise(0.0)
    more = F.when(draw(rows[doc_id], mix.seed) < rate - F.floor(rate), 1).otherwise(0)
    return met, table, (F.floor(rate) + more).cast("long")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("text"))
    return materialize(rows.selectExpr("doc_id", "source", f"{words('text')} as size"), "sized")


def repetitions(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row.

    NULL and empty texts have no words and are repeated like others of their source; a source
    without words has the target 0 and no copies. NULL is a source of its own. Repeated rows and
    equal ids draw alike; a NULL id draws like an empty one. Other columns are not read. Texts
    are read once: what is left of a row (id, source, size) is written for the second look.
    """
    sized = _sized(docs, doc_id, text, source)
    plan = _plan(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    met, table, copies = _copies(sized, plan, mix, "doc_id", "source")
    return met.select("doc_id", "source", "size", table["mix_size"].alias("source_size"), table["mix_target"].alias("target"), copies.alias("copies"))


def emit(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is repeated, numbered from 1 in ``copy``.

    All columns travel; an existing column ``copy`` is replaced.
    """
    plan = _plan(_sized(docs, doc_id, text, source).groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    met, _, copies = _copies(docs, plan, mix, doc_id, source)
    columns = [docs[c] for c in docs.columns if c != "copy"]
    return met.where(copies > 0).select(*columns, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB text equal to ``digest(repetitions(documents))``. Sources are few enough here to list each one's cut.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s FROM d GROUP BY source),
w AS (SELECT source, s, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS HUGEINT) AS w FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY s / w, source) AS k FROM w),
c AS (SELECT *, 150 * (SELECT sum(s) FROM t) - coalesce(200 * sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
      sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM o),
f AS (SELECT min(k) AS k FROM c WHERE 200 * s * below >= w * above),
g AS (SELECT c.source, c.s, CASE WHEN f.k IS NULL OR c.k < f.k THEN CAST(2 * c.s AS DOUBLE)
      ELSE CAST(c.w AS DOUBLE) * CAST(x.above AS DOUBLE) / (100.0::DOUBLE * CAST(x.below AS DOUBLE)) END AS target
      FROM c CROSS JOIN f LEFT JOIN c x ON x.k = f.k),
r AS (SELECT doc_id, size, CAST(g.s AS BIGINT) AS source_size, target, CASE WHEN g.s > 0 THEN target / CAST(g.s AS DOUBLE) ELSE 0 END AS rate,
      CAST(CAST('0x' || substr(md5('20240301:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""
