"""Phrase collocations by counting in tries of word ids.

A task numbers its words and counts phrases in a shallow trie: nodes are words (in the second
pass word pairs), and below a node lies a container of packed continuations with their counts.
A container that outgrows ``BURST`` keys bursts into smaller ones. When a task holds too many
keys, whole subtrees, those that repeat least, are spilled as sorted runs of spelled phrases;
Spark merges the runs of all tasks for each prefix (the first two words). Containers are kept as
sorted arrays, so that a slice of text is added to all of them in one merge.

Words and pairs are counted first. A phrase can only be frequent if its pairs are, so the second
pass counts three and four words where a bitmap of frequent pairs allows it. False hits of the
bitmap cost rows, not correctness: every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm import flat
from marketlake.session import materialize

#: Keys that a task holds in its containers before it spills subtrees.
HELD_KEYS = 2_000_000
#: Distinct words of a language that a task numbers before it spills everything and starts anew.
HELD_WORDS = 600_000
#: Keys of a container before it bursts, and the parts it bursts into.
BURST, FAN = 4_096, 64
#: Bits of the bitmap for each frequent pair, and the most bits it has (32 MB).
BITS_A_PAIR, MOST_BITS = 16, 1 << 28
RUN_ROWS = 100_000

BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_RUN = "lang string, prefix string, rest string, n long"
_LOW = np.int64(0xFFFFFFFF)


@dataclass(frozen=True)
class Mining:
    """Phrases of two to four words with ``least`` occurrences; the first ``top`` of each language by
    ``scale * a / (l + r)``; a phrase goes if a longer one around it has ``cover`` percent of its count."""

    least: int = 30
    cover: int = 80
    top: int = 2_000
    scale: int = 2_000_000


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[head], np.add.reduceat(count, head) if len(head) else count


class Containers:
    """Counts of (node, continuation), packed as node << 32 | continuation."""

    def __init__(self):
        self.key, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, node: np.ndarray, continuation: np.ndarray) -> None:
        key, count = np.unique((node << 32) | continuation, return_counts=True)
        self.new.append((key, count))
        self.waiting += len(key)
        if self.waiting > max(HELD_KEYS // 4, len(self.key) // 2):
            self.merge()

    def merge(self) -> None:
        self.key, self.count = added([self.key, *(k for k, _ in self.new)], [self.count, *(c for _, c in self.new)])
        self.new, self.waiting = [], 0

    def spill(self, everything: bool) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, those with the fewest occurrences a key first, until half the keys are left."""
        self.merge()
        if everything or not len(self.key):
            out = self.key, self.count
            self.__init__()
            return out
        node = self.key >> 32
        head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[head, len(node)])
        unit = np.repeat(np.arange(len(head)) * FAN, size) + np.where(np.repeat(size > BURST, size), self.key % FAN, 0)
        names, unit, keys = np.unique(unit, return_inverse=True, return_counts=True)
        order = np.argsort(np.bincount(unit, weights=self.count) / keys, kind="stable")
        leaves = np.zeros(len(names), dtype=bool)
        leaves[order[: 1 + np.searchsorted(np.cumsum(keys[order]), len(self.key) // 2)]] = True
        leaves = leaves[unit]
        out = self.key[leaves], self.count[leaves]
        self.key, self.count = self.key[~leaves], self.count[~leaves]
        return out


class Numbers:
    """Numbers of distinct keys in the order of their coming."""

    def __init__(self):
        self.key, self.number = np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found, inverse = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.key, found)
        known = np.zeros(len(found), dtype=bool)
        if len(self.key):
            known = self.key[np.minimum(at, len(self.key) - 1)] == found
        fresh = np.flatnonzero(~known)
        numbers = np.empty(len(found), np.int64)
        numbers[known] = self.number[at[known]]
        numbers[fresh] = len(self.key) + np.arange(len(fresh))
        self.key, self.number = np.insert(self.key, at[fresh], found[fresh]), np.insert(self.number, at[fresh], numbers[fresh])
        return numbers[inverse]

    def keys(self) -> np.ndarray:
        """The key of each number."""
        out = np.empty(len(self.key), np.int64)
        out[self.number] = self.key
        return out


def spelled(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts, their texts, and whether each continues the piece of the word before."""
    data, at = flat.texts(column)
    seg = flat.words(data, at, _WORD)
    offsets = np.concatenate([[0], np.cumsum(seg.end - seg.start)])
    words = pa.LargeStringArray.from_buffers(len(seg.start), pa.py_buffer(offsets), pa.py_buffer(flat.LOWER[data][_WORD[data]]))
    piece = np.cumsum(_BREAK[data])[seg.start] if len(seg.start) else np.empty(0, np.int64)
    follows = np.zeros(len(seg.start), dtype=bool)
    follows[1:] = (piece[1:] == piece[:-1]) & (seg.doc[1:] == seg.doc[:-1])
    return words, seg.doc, follows


def hashes(words: pa.Array) -> np.ndarray:
    data, at = flat.texts(words)
    return flat.Hasher(data)(at[:-1], at[1:])


def pair_slots(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Slot of the bitmap of word pairs, by hashes of language and words."""
    return (flat.mix(lang + flat.mix(first) + second * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(bits - 1)).astype(np.int64)


class Trie:
    """Phrase counts of one language in one task: words and pairs, or, given a bitmap of frequent pairs, three and four words."""

    def __init__(self, lang: str, bitmap: np.ndarray | None):
        self.lang, self.bitmap = lang, bitmap
        self.lang_hash = hashes(pa.array([lang]))[0]
        self.start()

    def start(self) -> None:
        self.code: dict[str, int] = {}
        self.hash = np.empty(0, np.uint64)
        self.single = np.empty(0, np.int64)
        self.pairs, self.below, self.further = Numbers(), Containers(), Containers()
        self.total = 0

    def add(self, column: pa.Array) -> None:
        words, _, follows = spelled(column)
        if not len(words):
            return
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = len(self.code)
        numbers = np.array([self.code.setdefault(w, len(self.code)) for w in names], np.int64)
        fresh = np.flatnonzero(numbers >= known)
        self.hash = np.concatenate([self.hash, hashes(coded.dictionary.take(pa.array(fresh)))])
        word = numbers[np.asarray(coded.indices)]
        if self.bitmap is None:
            self.total += len(word)
            counts = np.bincount(word, minlength=len(self.code))
            counts[: len(self.single)] += self.single
            self.single = counts
            at = np.flatnonzero(follows)
            self.below.add(word[at - 1], word[at])
            return
        # Place i stands for the pair of the words i - 1 and i.
        at = np.flatnonzero(follows)
        slot = pair_slots(self.lang_hash, self.hash[word[at - 1]], self.hash[word[at]], 8 * len(self.bitmap))
        frequent = np.zeros(len(word) + 2, dtype=bool)
        frequent[at] = (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        three = np.flatnonzero(frequent[:-1] & frequent[1:])
        if not len(three):
            return
        # Pairs that begin three words, and those two places on that end four.
        four = three[frequent[three + 2]]
        used = np.unique(np.concatenate([three, four + 2]))
        node = np.full(len(word) + 2, -1, np.int64)
        node[used] = self.pairs((word[used - 1] << 32) | word[used])
        self.below.add(node[three], word[three + 1])
        self.further.add(node[four], node[four + 2])

    def full(self) -> bool:
        return len(self.below.key) + len(self.further.key) > HELD_KEYS or len(self.code) > HELD_WORDS

    def run(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as sorted runs (lang, prefix, rest, n)."""
        everything = everything or len(self.code) > HELD_WORDS or len(self.pairs.key) > HELD_KEYS
        names = pa.array(list(self.code), pa.large_string())
        rank = np.empty(len(names), np.int64)
        rank[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
        if self.bitmap is None:
            if everything:
                yield from self._rows(names, pa.nulls(len(names), pa.large_string()), self.single)
                yield from self._rows(pa.array([""], pa.large_string()), pa.nulls(1, pa.large_string()), np.array([self.total]))
            key, n = self.below.spill(everything)
            order = np.argsort((rank[key >> 32] << 32) | rank[key & _LOW])
            key, n = key[order], n[order]
            yield from self._rows((names, key >> 32, key & _LOW), None, n)
        else:
            pair = self.pairs.keys()
            place = np.empty(len(pair), np.int64)
            place[np.argsort((rank[pair >> 32] << 32) | rank[pair & _LOW])] = np.arange(len(pair))
            for held, two in ((self.below, False), (self.further, True)):
                key, n = held.spill(everything)
                tail = place if two else rank
                order = np.argsort((place[key >> 32] << 32) | tail[key & _LOW])
                key, n = key[order], n[order]
                first, last = pair[key >> 32], (pair[key & _LOW] if two else key & _LOW)
                yield from self._rows((names, first >> 32, first & _LOW), (names, last >> 32, last & _LOW) if two else (names, last, None), n)
        if everything:
            self.start()

    def _rows(self, prefix, rest, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        def spell(what, low: int, high: int) -> pa.Array:
            if what is None:
                return pa.nulls(high - low, pa.string())
            if isinstance(what, pa.Array):
                return what.slice(low, high - low).cast(pa.string())
            names, first, second = what
            out = names.take(pa.array(first[low:high]))
            return (out if second is None else pc.binary_join_element_wise(out, names.take(pa.array(second[low:high])), pa.scalar(" ", pa.large_string()))).cast(pa.string())

        for low in range(0, len(n), RUN_ROWS):
            high = min(len(n), low + RUN_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * (high - low), pa.string()), spell(prefix, low, high), spell(rest, low, high),
                                              pa.array(n[low:high], pa.int64())], ["lang", "prefix", "rest", "n"])


def runs(docs: DataFrame, bitmap=None) -> DataFrame:
    """(lang, prefix, rest, n): sorted runs of all tasks. With no rest the prefix is a word or a pair, or '' for the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bitmap.value if bitmap is not None else None
        tries: dict[str, Trie] = {}
        for batch in batches:
            for part in flat.slices(batch):
                langs = part.column("lang").dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    trie = tries.setdefault(lang, Trie(lang, table))
                    trie.add(part.column("text").filter(pc.equal(langs.indices, k)))
                    if trie.full():
                        yield from trie.run(False)
                held = sum(len(t.below.key) + len(t.further.key) + len(t.code) for t in tries.values())
                if held > 2 * HELD_KEYS:
                    for t in tries.values():
                        yield from t.run(True)
                    tries.clear()
        for t in tries.values():
            yield from t.run(True)

    return docs.mapInArrow(count, _RUN)


def merged(rows: DataFrame, least: int) -> DataFrame:
    """Runs merged for each prefix; '' (the number of words) stays whatever its count."""
    return rows.repartition("lang", "prefix").groupBy("lang", "prefix", "rest").agg(F.sum("n").alias("f")).where(f"f >= {least} or prefix = ''")


def frequent_pairs(counts: DataFrame) -> np.ndarray:
    """Bitmap of the pairs in a table of counts; what reaches the driver is bounded by its size."""
    pairs = counts.where("rest is null and instr(prefix, ' ') > 0").select("lang", "prefix")
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_A_PAIR * pairs.count()):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column("prefix"), " ").flatten()
                h = hashes(words)
                slot = np.unique(pair_slots(hashes(batch.column("lang")), h[0::2], h[1::2], bits))
                byte, first = np.unique(slot >> 3, return_index=True)
                value = np.bitwise_or.reduceat(np.int64(1) << (slot & 7), first)
                yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(value)], ["byte", "value"])

    found = pairs.mapInArrow(mark, "byte long, value long").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[np.asarray(found["byte"])] = np.asarray(found["value"])
    return out


def phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact (lang, phrase, size, f) of all phrases of one to four words with ``least`` occurrences, and (lang, n) of all words."""
    rows = docs.select(docs[text].alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    short = materialize(merged(runs(rows), least), "pairs")
    bitmap = rows.sparkSession.sparkContext.broadcast(frequent_pairs(short))
    long = materialize(merged(runs(rows, bitmap), least), "phrases")
    bitmap.unpersist()
    spelled_out = short.union(long).where("prefix <> ''").select("lang", F.concat_ws(" ", "prefix", "rest").alias("phrase"), "f")
    return (spelled_out.withColumn("size", F.size(F.split("phrase", " "))),
            short.where("prefix = ''").select("lang", F.col("f").alias("n")))


def collocations(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    NULL and empty texts have no words, a NULL language is ``und``; repeated rows count each.
    Equal scores go by count, then by phrase in byte order. Other columns are not read.
    """
    counts, totals = phrases(docs, mining.least, text, lang)
    found = counts.where("size >= 2")
    part = [counts.select(F.col("lang").alias(f"{s}_lang"), F.col("phrase").alias(f"{s}_phrase"), F.col("f").alias(s)) for s in "lr"]
    cuts = found.select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size), ' ')").alias("tail"))
    cuts = cuts.join(part[0], F.expr("lang = l_lang and head = l_phrase")).join(part[1], F.expr("lang = r_lang and tail = r_phrase"))
    score = F.expr(f"(cast(a as decimal(20, 0)) * {mining.scale}) div (cast(l as decimal(20, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The largest count of a longer phrase around each phrase.
    inner = found.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {mining.cover}")
    flat_rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = flat_rows.withColumn("rank", F.row_number().over(best)).where(f"rank <= {mining.top}")
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB text equal to ``collocations(documents)``.
SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(range(1, 5)) AS size, w FROM w WHERE len(w) > 0),
o AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM g WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY lang, size, phrase),
t AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * k.a // (l.f + r.f) AS score FROM k
      JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1 : k.k], ' ')
      JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1 : k.size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, size, a, w, unnest(range(2, size)) AS n FROM c WHERE size > 2),
j AS (SELECT lang, a, unnest(list_transform(range(1, size - n + 2), lambda x: array_to_string(w[x : x + n - 1], ' '))) AS phrase FROM i),
m AS (SELECT lang, phrase, max(a) AS longer FROM j GROUP BY lang, phrase),
x AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE m.longer IS NULL OR 100 * m.longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM x JOIN t USING (lang) QUALIFY rank <= 2000
"""
