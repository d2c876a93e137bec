"""Number and price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import P_CLAMP

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(text: Column) -> Column:
    """Plain decimal text to DOUBLE; anything else (``1.5d``, ``NaN``) is NULL."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def json_member(doc: Column, path: str) -> Column:
    """A member of a VARIANT document: NULL when absent, a variant null when JSON null."""
    return F.try_variant_get(doc, path, "variant")


def json_plain(member: Column) -> Column:
    """A count or volume, quoted or bare, never scaled."""
    return to_double(F.try_variant_get(member, "$", "string"))


def json_price(member: Column) -> Column:
    """A price: text is dollars, an integer cents, a decimal dollars."""
    value = json_plain(member)
    return F.when(F.schema_of_variant(member) == "BIGINT", value / 100).otherwise(value)


def json_given(member: Column) -> Column:
    """Neither absent nor null."""
    return member.isNotNull() & ~F.is_variant_null(member)


def sql_round(col: Column, digits: int) -> Column:
    """Half-away-from-zero rounding that first drops binary noise past 12 digits."""
    return F.round(F.round(col, 12), digits)


def quote_midpoint(raw: Column, close: Column) -> Column:
    """Middle of the quoted YES bid and ask of a candle, else its close."""
    bid = to_double(F.get_json_object(raw, "$.yes_bid.close_dollars"))
    ask = to_double(F.get_json_object(raw, "$.yes_ask.close_dollars"))
    return F.coalesce((bid + ask) / 2, close)


def logit(p: Column, clamp: float = P_CLAMP) -> Column:
    q = F.least(F.lit(1 - clamp), F.greatest(F.lit(clamp), p))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def best_mid(bids: Column, asks: Column) -> Column:
    """Mean of best bid and best ask, NULL when either side is empty."""
    return sql_round((F.get(bids, F.lit(0))["price"] + F.get(asks, F.lit(0))["price"]) / 2, 4)
