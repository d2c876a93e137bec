"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trade_hash(*fields: Column) -> Column:
    """SHA-1 of the ``|``-joined fields; a missing field is written ``None``."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("None")) for f in fields]))


def book_hash(bids: Column, asks: Column) -> Column:
    """SHA-1 of both sides of a book as JSON."""
    return F.sha1(F.to_json(F.struct(bids.alias("b"), asks.alias("a"))))
