"""Benchmark decontamination: a Wu-Manber multi-pattern search over words.

Every 10-word window of a benchmark item is a pattern. A table of shifts by word pairs says
how far a search may jump, pairs with shift 0 select patterns by hashes of their last and
first words, and the words themselves are compared to confirm. All texts of a slice are
searched side by side: many cursors move by their own shifts in each numpy step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import flat
from marketlake.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Word positions one cursor walks over.
LANE = 96


def patterns(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (window, item) pairs; an item of fewer words is one window, of none has none."""
    found = items.select(items[item_id].cast("string").alias("item"), F.expr(
        f"regexp_extract_all(translate(`{text}`, '{UPPER}', '{LOWER}'), r'{WORD}', 0)").alias("w")).where("size(w) > 0")
    spread = found.select("item", F.explode(F.expr(
        f"transform(sequence(1, greatest(size(w) - {width - 1}, 1)), i -> array_join(slice(w, i, {width}), ' '))")).alias("window"))
    return spread.distinct()


class Length:
    """Shift and hash tables of the patterns of one length (in words)."""

    def __init__(self, texts: list[bytes], bits: int):
        self.texts, self.m = texts, texts[0].count(b" ") + 1
        self.block = min(2, self.m)
        joined = np.frombuffer(b"\n".join(texts), np.uint8)
        seg = flat.words(joined, np.array([0, len(joined)]), flat.ALNUM)
        self.hashes = flat.Hasher(joined)(seg.start, seg.end).reshape(len(texts), self.m)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.m - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, self.m):
            slot = (self.pair(self.hashes[:, end - 1] if self.block == 2 else None, self.hashes[:, end]) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, self.m - 1 - end)
        key = self.bucket(self.hashes, np.full(len(texts), self.m - 1), np.arange(len(texts)))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def pair(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return flat.mix(last if before is None else last + before * np.uint64(0xD6E8FEB86659FD93))

    def bucket(self, hashes: np.ndarray, last: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """Hash of the last and the first words of a window that ends at ``last``."""
        at = (lambda k: hashes[row, k]) if row is not None else (lambda k: hashes[k])
        tail = self.pair(at(last - 1) if self.block == 2 else None, at(last))
        first = last - (self.m - 1)
        head = self.pair(at(first), at(first + 1)) if self.block == 2 else tail
        return flat.mix(tail + head * np.uint64(0xA0761D6478BD642F))

    def search(self, hashes: np.ndarray, seg: flat.Segments) -> tuple[np.ndarray, np.ndarray]:
        """Last word of each occurrence and its pattern, by word hashes."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        begin, stop = seg.first[:-1] + self.m - 1, seg.first[1:]
        long_enough = begin < stop
        begin, stop = begin[long_enough], stop[long_enough]
        lanes = (stop - begin + LANE - 1) // LANE
        if not len(lanes):
            return none
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begin, lanes) + number * LANE
        stop = np.minimum(at + LANE, np.repeat(stop, lanes))
        found = []
        while len(at):
            jump = self.shift[(self.pair(hashes[at - 1] if self.block == 2 else None, hashes[at]) & self.mask).astype(np.int64)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        last = np.concatenate(found)
        if not len(last):
            return none
        key = self.bucket(hashes, last)
        low = np.searchsorted(self.keys, key, "left")
        n = np.searchsorted(self.keys, key, "right") - low
        last = np.repeat(last, n)
        which = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        for k in range(self.m):
            same = hashes[last - (self.m - 1) + k] == self.hashes[which, k]
            last, which = last[same], which[same]
        return last, which


class Searcher:
    """Tables for one block of patterns."""

    def __init__(self, pairs: list[tuple[str, str]], bits: int = 18):
        grouped: dict[bytes, list[str]] = {}
        for window, item in pairs:
            grouped.setdefault(window.encode(), []).append(item)
        by_length: dict[int, list[bytes]] = {}
        for window in sorted(grouped):
            by_length.setdefault(window.count(b" "), []).append(window)
        self.lengths = [Length(texts, bits) for _, texts in sorted(by_length.items())]
        self.items = grouped

    def search(self, data: np.ndarray, seg: flat.Segments, hashes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Each confirmed occurrence: first word, end (exclusive) and pattern."""
        for length in self.lengths:
            last, which = length.search(hashes, seg)
            for end, p in zip(last.tolist(), which.tolist()):
                first, text = end - length.m + 1, length.texts[p]
                spelled = b" ".join(data[a:b].tobytes() for a, b in zip(seg.start[first:end + 1].tolist(), seg.end[first:end + 1].tolist()))
                if spelled == text:
                    yield first, end + 1, text


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, block_patterns: int = 200_000,
                  doc_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Words of each document inside an occurrence of a benchmark window.

    Result: the columns ``keep`` (default ``doc_id``), ``n_words``, ``hits`` (word ranges,
    end exclusive, merged) and ``items`` (sorted item ids). Documents are never shuffled.
    Patterns go to the tasks in blocks of at most about ``block_patterns``; a larger
    benchmark takes one pass for each block, whose hits travel with the row. NULL and empty
    texts have no words and no hits; repeated documents are judged alike; items without
    words, or an empty benchmark, hit nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    found = patterns(items, width)
    total = found.count()
    n_blocks = max(1, -(-total // block_patterns))
    names = [f"k{i}" for i in range(len(keep))]
    at_text = names[keep.index(doc_text)] if doc_text in keep else "dtext"
    carried = names if doc_text in keep else [*names, "dtext"]
    out = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)], *([] if doc_text in keep else [docs[doc_text].alias("dtext")]),
                      F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("cover"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    for block in range(n_blocks):
        # A window of very many items is searched in several blocks, each with some of them.
        part = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == block) if n_blocks > 1 else found
        tables = spark.sparkContext.broadcast(Searcher([(r["window"], r["item"]) for r in part.collect()]) if total else None)
        if block:
            out = materialize(out, "decontam")

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            searcher = tables.value
            for batch in batches:
                for piece in flat.slices(batch, at_text):
                    yield _scan(piece, searcher, carried, at_text)

        out = out.mapInArrow(scan, schema)
    ranges = F.expr("transform(filter(sequence(0, size(cover)), i -> i % 2 = 0 and i + 1 < size(cover)), "
                    "i -> named_struct('start', cover[i], 'end', cover[i + 1]))")
    return out.select(*[out[k].alias(c) for k, c in zip(names, keep)], "n_words", ranges.alias("hits"), "items")


def _scan(piece: pa.RecordBatch, searcher: Searcher | None, carried: list[str], at_text: str) -> pa.RecordBatch:
    data, at = flat.texts(piece.column(at_text))
    data = flat.LOWER[data]
    seg = flat.words(data, at, flat.ALNUM)
    covers, items = piece.column("cover").to_pylist(), [set(x) for x in piece.column("items").to_pylist()]
    spans: dict[int, list[tuple[int, int]]] = {}
    if searcher is not None:
        for first, end, text in searcher.search(data, seg, flat.Hasher(data)(seg.start, seg.end)):
            doc = int(seg.doc[first])
            base = int(seg.first[doc])
            spans.setdefault(doc, []).append((first - base, end - base))
            items[doc].update(searcher.items[text])
    for doc, new in spans.items():
        old = covers[doc]
        merged: list[int] = []
        for a, b in sorted([*zip(old[::2], old[1::2]), *new]):
            if merged and a <= merged[-1]:
                merged[-1] = max(merged[-1], b)
            else:
                merged += [a, b]
        covers[doc] = merged
    return pa.RecordBatch.from_arrays(
        [piece.column(k) for k in carried] + [pa.array(seg.counts(), pa.int64()), pa.array(covers, pa.list_(pa.int64())),
                                              pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        [*carried, "n_words", "cover", "items"])


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the result of ``decontaminate``."""
    return found.select(
        "doc_id", "n_words", F.expr("aggregate(hits, 0L, (n, h) -> n + h.end - h.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


#: DuckDB text equal to ``digest(decontaminate(documents, benchmark))``.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT rid, i, dw.m, item FROM dw JOIN p ON dw.win = p.win AND dw.m = p.m),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""
