"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TEAM_SUFFIXES


def norm_team(name: Column) -> Column:
    """Comparable team name: lower case, punctuation to blanks, common suffixes dropped."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    core = F.trim(F.regexp_replace(words, " +(?:" + "|".join(TEAM_SUFFIXES) + ")(?= )", ""))
    return F.regexp_replace(F.when(core != "", core).otherwise(F.trim(words)), " +", " ")


def patch_key(patch: Column) -> Column:
    """Sortable form of a dotted patch name: numeric parts, non-numbers as 0."""
    return F.transform(
        F.split(patch, r"\."),
        lambda part: F.when(part.rlike(r"^\d+$"), part.try_cast("int")).otherwise(F.lit(0)))


def like_literal(text: str) -> str:
    """Escape LIKE wildcards so that search text matches itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(col: Column, text: str, literal: bool = True) -> Column:
    """Case-insensitive substring test; ``literal=False`` lets ``%`` and ``_`` act as wildcards."""
    return col.ilike("%" + (like_literal(text) if literal else text) + "%")


def safe_name(col: Column) -> Column:
    """Directory-safe name."""
    return F.regexp_replace(col, "[^A-Za-z0-9_.-]", "_")
