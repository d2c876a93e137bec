"""Personal data: patterns propose spans, check digits confirm them, context adjusts the score.

Only built-in functions. The matches of a pattern and the text between them
(``regexp_extract_all`` and ``split``) give the positions of all matches in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that always stay, in order; then kinds the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Possessive and anchored forms of the plain patterns: the same matches in linear time.
PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
#: A cheap test that a text can hold the kind at all.
_GATE = {"email": "instr(t, '@') > 0", "ip": r"t rlike r'[0-9]\.[0-9]'", "card": r"t rlike r'[0-9][\x20-]?[0-9]'",
         "phone": "instr(t, '+') > 0", "iban": "t rlike r'[A-Z]{2}[0-9]{2}'", "ssn": "t rlike r'[0-9]-[0-9]{2}-[0-9]'"}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = ("aggregate(transform(sequence(1, length(d)), i -> cast(substr(d, i, 1) as int) * (1 + (length(d) - i) % 2)), 0, "
         "(s, v) -> s + v - IF(v > 9, 9, 0)) % 10 = 0")
_IBAN = ("aggregate(transform(split(concat(substr(b, 5), substr(b, 1, 4)), ''), c -> IF(c = '', -1, IF(c between '0' and '9', "
         "ascii(c) - 48, ascii(c) - 55))), 0, (s, v) -> IF(v < 0, s, IF(v > 9, s * 100 + v, s * 10 + v) % 97)) = 1")


def _valid(kind: str) -> str:
    """SQL over ``m``, the matched text."""
    if kind == "ip":
        return rf"m rlike r'^(?:{_BYTE}\.){{3}}{_BYTE}$'"
    if kind == "card":
        return f"exists(array({_DIGITS}), d -> length(d) between 13 and 19 and {_LUHN})"
    if kind == "phone":
        return f"length({_DIGITS}) between 9 and 15"
    if kind == "iban":
        return f"exists(array(replace(m, ' ', '')), b -> length(b) between 15 and 34 and {_IBAN})"
    if kind == "ssn":
        return "substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and substr(m, 8, 4) <> '0000'"
    return "true"


#: Score of a confirmed span, and words near it that raise or lower the score.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
NEAR = {
    "email": "mail|contact|write to|address", "ip": r"\bip\b|host|server|address", "card": "card|visa|master|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|konto", "ssn": r"ssn|social security|tax id",
}
AGAINST = r"version|release|isbn|order no|part no|serial"
CONTEXT_CHARS = 40
RAISE, LOWER, LEAST = 0.2, 0.2, 0.5


def _spans(kind: str) -> Column:
    """Confirmed matches of a kind: array of (kind, start, end, score), positions in code points."""
    n = f"size(m_{kind})"
    folded = (f"aggregate(sequence(0, {n} - 1), named_struct('at', 0L, 'out', cast(array() as array<struct<kind:string,start:bigint,`end`:bigint>>)), "
              f"(a, i) -> named_struct('at', a.at + length(p_{kind}[i]) + length(m_{kind}[i]), 'out', "
              f"IF(ok_{kind}[i], array_append(a.out, named_struct('kind', '{kind}', 'start', a.at + length(p_{kind}[i]), "
              f"'end', a.at + length(p_{kind}[i]) + length(m_{kind}[i]))), a.out)), a -> a.out)")
    return F.expr(f"IF(exists(ok_{kind}, x -> x), {folded}, cast(array() as array<struct<kind:string,start:bigint,`end`:bigint>>))")


def _scored(kind: str) -> Column:
    near = f"substring(t, cast(greatest(s.start - {CONTEXT_CHARS}, 0) + 1 as int), cast(s.`end` - greatest(s.start - {CONTEXT_CHARS}, 0) + {CONTEXT_CHARS} as int))"
    return F.expr(
        f"transform(s_{kind}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.`end`, 'score', "
        f"least(1.0D, greatest(0.0D, {SCORE[kind]}D + IF({near} rlike r'(?i){NEAR[kind]}', {RAISE}D, 0.0D) - IF({near} rlike r'(?i){AGAINST}', {LOWER}D, 0.0D)))))")


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``), the text and ``spans``: array of
    (kind, start, end, score) over the whole text, by kind and start.

    Base kinds stay whatever their score; an added kind needs a score of ``LEAST``. NULL and
    empty texts have no spans; repeated rows give the same spans; the row is never shuffled.
    Matches that fail their check are dropped without a second try inside them.
    """
    keep = ["doc_id"] if keep is None else keep
    kinds = (*BASE, *ADDED)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)], F.coalesce(docs[text], F.lit("")).alias("t"))
    none = "cast(array() as array<string>)"
    rows = rows.select("*", *[F.expr(f"IF({_GATE[k]}, regexp_extract_all(t, r'{PATTERN[k]}', 0), {none})").alias(f"m_{k}") for k in kinds])
    rows = rows.select("*", *[F.expr(f"transform(m_{k}, m -> {_valid(k)})").alias(f"ok_{k}") for k in kinds])
    rows = rows.select("*", *[F.expr(f"IF(exists(ok_{k}, x -> x), split(t, r'{PATTERN[k]}', -1), {none})").alias(f"p_{k}") for k in kinds])
    rows = rows.select(*names, "t", *[_spans(k).alias(f"s_{k}") for k in kinds])
    rows = rows.select(*names, "t", *[_scored(k).alias(f"z_{k}") for k in kinds])
    added = [f"filter(z_{k}, s -> s.score >= {LEAST}D)" for k in ADDED]
    rows = rows.select(*names, "t", F.expr(f"concat({', '.join([*[f'z_{k}' for k in BASE], *added])})").alias("spans"))
    return rows.select(*[rows[k].alias(c) for k, c in zip(names, keep)], F.col("t").alias(text), "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and spelling of the spans of ``find``."""
    spell = "concat(s.kind, ':', s.start, ':', s.`end`)"
    base = ", ".join(f"'{k}'" for k in BASE)
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(f"array_join(transform(filter(spans, s -> s.kind in ({base})), s -> {spell}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(spans, s -> {spell}), ',')").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    columns = docs.columns
    names = {c: f"c{i}" for i, c in enumerate(columns) if c != text}
    inner = docs.select(*[docs[c].alias(n) for c, n in names.items()], docs[text].alias("text"))
    found = find(inner, "text", list(names.values()))
    text, original = "text", text
    cleaned = F.expr(f"""
        IF(size(spans) = 0, `{text}`, aggregate(
          array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.`end`, 'kind', s.kind))),
          named_struct('at', 0L, 'out', cast(array() as array<string>)),
          (a, s) -> IF(s.start >= a.at,
             named_struct('at', s.`end`, 'out', concat(a.out, array(substring(`{text}`, cast(a.at + 1 as int), cast(s.start - a.at as int)),
                                                                  concat('[', upper(s.kind), ']')))),
             named_struct('at', greatest(a.at, s.`end`), 'out', a.out)),
          a -> concat(array_join(a.out, ''), substring(`{text}`, cast(a.at + 1 as int)))))""")
    found = found.withColumn(text, cleaned)
    return found.select(*[found[names[c]].alias(c) if c in names else found["text"].alias(original) for c in columns])


def _duck(kind: str, plain: str) -> str:
    """DuckDB rows (rid, kind, start, end, match, t) of a plain pattern."""
    return f"""SELECT rid, '{kind}' AS kind, t, m[i] AS m,
       CAST(list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT rid, t, m, p, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT rid, t, regexp_extract_all(t, '{plain}') AS m, regexp_split_to_array(t, '{plain}') AS p FROM d) WHERE len(m) > 0)"""


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DUCK_SCORE = " ".join(
    f"WHEN '{k}' THEN {SCORE[k]} + CASE WHEN regexp_matches(lower(near), '{NEAR[k]}') THEN {RAISE} ELSE 0 END" for k in ADDED)
_DUCK_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: DuckDB text equal to ``digest(find(documents))``.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(_duck(k, _PLAIN[k]) for k in (*BASE, *ADDED))}),
v AS (SELECT rid, kind, t, s, s + length(m) AS e FROM (SELECT *, {_DUCK_DIGITS} AS g, replace(m, ' ', '') AS b FROM a) WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 4) AS INT) > 255)) = 0
  WHEN 'card' THEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i:
       CAST(g[i] AS INT) * (1 + (length(g) - i) % 2) - CASE WHEN CAST(g[i] AS INT) * (1 + (length(g) - i) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
  WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
  WHEN 'iban' THEN length(b) BETWEEN 15 AND 34 AND list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(b[5:] || b[1:4], ''), lambda x:
       CAST(CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END AS BIGINT))), lambda x, y: (CASE WHEN y > 9 THEN x * 100 + y ELSE x * 10 + y END) % 97) = 1
  ELSE substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000' END),
k AS (SELECT rid, kind, s, e FROM (SELECT *, substring(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, e - greatest(s - {CONTEXT_CHARS}, 0) + {CONTEXT_CHARS}) AS near FROM v)
      WHERE kind IN ({', '.join(f"'{x}'" for x in BASE)})
         OR CASE kind {_DUCK_SCORE} END - CASE WHEN regexp_matches(lower(near), '{AGAINST}') THEN {LOWER} ELSE 0 END >= {LEAST}),
o AS (SELECT *, list_position([{', '.join(f"'{x}'" for x in (*BASE, *ADDED))}], kind) AS r, kind || ':' || s || ':' || e AS w FROM k),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS n_{x}" for x in BASE)},
             string_agg(w, ',' ORDER BY r, s) FILTER (WHERE r <= {len(BASE)}) AS base, string_agg(w, ',' ORDER BY r, s) AS spans FROM o GROUP BY rid)
SELECT doc_id, {', '.join(f"CAST(coalesce(n_{x}, 0) AS BIGINT) AS n_{x}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
