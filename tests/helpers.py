"""Small helpers for fixtures."""

import datetime as dt
import math

UTC = dt.timezone.utc


def ts(seconds):
    return dt.datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)


def rows(df, *cols):
    """Rows as sorted tuples."""
    got = [tuple(r) for r in df.select(*(cols or df.columns)).collect()]
    return sorted(got, key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


def logit(p):
    p = min(0.98, max(0.02, p))
    return math.log(p / (1 - p))
