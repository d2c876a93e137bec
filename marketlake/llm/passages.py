"""Substring near-duplicates by compact windows.

Tokens are word shingles. The Cartesian tree of a text's token hashes gives compact windows:
around a token, the widest stretch in which it is the minimum, so it is the min-hash of every
passage inside that holds it. Two passages that agree to ``percent`` at one alignment have one
changed word inside at most, so one of their equal stretches has ``run`` tokens; the minimum of
each such stretch together with the words on one side of it is a key, and texts that share a
key are linked. Then every stretch of ``common`` tokens whose keys occur in several texts is
grouped by all its words, so that a text that holds only a part of a passage hides no other
two. Texts are aligned on their links, and every stretch of at least ``least_words`` words
whose shingles agree to ``percent`` is confirmed on the words themselves. Keys that further
texts hold where two agree without a passage stay open: around them the stretches with one
word left out are grouped by all their other words, so that no text hides two others that
agree up to that word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import flat
from marketlake.session import materialize, small_batches

#: Bytes of rows sent to Python at a time, and of text worked on at a time; hashes take many times as much.
BATCH_BYTES, SLICE_BYTES = 4_000_000, 500_000
#: Bits that mark keys of several texts, and how many of them one row of the table holds. They
#: only spare rows: where two keys share a bit, stretches are grouped that need not be.
MARKS, MARKS_ROW = 1 << 27, 1 << 15
#: Rows of a chunk that are combined at a time.
CHUNK_ROWS = 4_000_000
#: Ranges of keys (2 to this power) that are grouped one by one, and links that one row holds. A range
#: has 1 in 8,192 of all keys, and of a frequent key a row for each chunk.
PART_BITS, LINKS_ROW = 13, 256
LINK, LINK_TYPES = ["key", "doc", "at", "other", "other_at"], [np.int64, np.int64, np.int32, np.int64, np.int32]
PACKED = "part int, key array<long>, doc array<long>, at array<int>, other array<long>, other_at array<int>"


@dataclass(frozen=True)
class Passages:
    """Parameters: words of a passage and of a shingle, equal shingles in percent, text combined at a time."""

    least_words: int = 50
    shingle: int = 5
    percent: int = 80
    chunk_bytes: int = 16_000_000

    @property
    def tokens(self) -> int:
        return self.least_words - self.shingle + 1

    @property
    def common(self) -> int:
        """Equal shingles that two windows of ``tokens`` shingles need."""
        return -(-2 * self.percent * self.tokens // (100 + self.percent))

    @property
    def run(self) -> int:
        """Equal shingles in a row that remain of ``common`` when one changed word parts them."""
        return -(-self.common // 2)

    @property
    def half_words(self) -> int:
        """Words of such a run."""
        return self.run + self.shingle - 1

    @property
    def gapped_words(self) -> int:
        """Words beside the changed one of a passage that has no shingle to spare."""
        return self.common + 2 * (self.shingle - 1)

    @property
    def side_words(self) -> int:
        """Words that a run has at least on one side of any of its tokens."""
        return (self.run - 1) // 2


def lit(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are marked."""
    slot = (key & np.uint64(MARKS - 1)).astype(np.int64)
    return (marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def minima(values: np.ndarray, seg_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``width`` tokens of one text: first token and least token (leftmost of ties).

    Minima of a sliding window, found with running minima of blocks in both directions. Values
    count by their lower 32 bits.
    """
    n = len(values)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A unique order: the value's lower half first, then position.
    half = np.uint64(32)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values << half | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    start = np.arange(n - width + 1)
    start = start[seg_doc[start] == seg_doc[start + width - 1]]
    return start, np.minimum(behind[start], ahead[start + width - 1]).astype(np.uint32).astype(np.int64)


def anchors(values: np.ndarray, seg_doc: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Positions whose compact window holds at least ``width`` tokens of one text: the roots of
    Cartesian trees of all stretches of that width."""
    return np.unique(minima(values, seg_doc, width)[1])


class Tokens:
    """Shingles of the texts of a batch, and hashes of any stretches of their words."""

    def __init__(self, column: pa.Array, p: Passages, every: bool = False):
        self.p = p
        data, at = flat.texts(column)
        self.seg = flat.words(data, at, flat.SPACED)
        self.words = words = flat.Hasher(data, lower=True)(self.seg.start, self.seg.end)
        self.tokens, self.first = flat.windows(words, self.seg, p.shingle)
        if not every:
            long = self.seg.counts()[self.seg.doc[self.first]] >= p.least_words
            self.tokens, self.first = self.tokens[long], self.first[long]
        self.doc = self.seg.doc[self.first]
        self.sums = np.zeros(len(words) + 1, np.uint64)
        up, self.down = flat._powers(len(words))
        np.cumsum(words * up[: len(words)], out=self.sums[1:])
        self.salt = np.random.default_rng(41).integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
        self.start, self.least = minima(flat.mix(self.tokens * self.salt[0]), self.doc, p.run)

    def stretch(self, begin: np.ndarray, words: int, salt: int) -> np.ndarray:
        return flat.mix((self.sums[begin + words] - self.sums[begin]) * self.down[begin] + self.salt[salt])

    def gaps(self, opened: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
        """Words that have an open key in the run beside them: whether the run is before them, and the words."""
        p = self.p
        begin, least = self.first[self.start], self.first[self.least]
        after = (least + p.shingle + p.side_words <= begin + p.half_words)
        ok = np.zeros(len(begin), bool)
        for k, of in ((0, after), (1, ~after)):
            # The side that lies inside the run, so that equal runs have equal keys.
            which = np.flatnonzero(of)
            fits, key = self.side(self.least[which], k)
            ok[which[fits]] = lit(opened, key)
        begin = begin[ok]
        for before in (True, False):
            word = begin + p.half_words if before else begin - 1
            text = self.seg.doc[begin]
            yield before, word[(word >= self.seg.first[text]) & (word < self.seg.first[text + 1])]

    def gapped(self, word: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words with so many others on both sides in their text: those, and hashes of the others."""
        text = self.seg.doc[word]
        word = word[(word - left >= self.seg.first[text]) & (word + right < self.seg.first[text + 1])]
        sides = self.stretch(word - left, left, 0), self.stretch(word + 1, right, 1)
        return word, flat.mix(sides[0] + flat.mix(sides[1] + np.uint64(left)))

    def cores(self, before: bool, word: np.ndarray) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        """Lengths of the longer part, words that have what these share, and its keys.

        The longer part has a run, the shorter one a shingle at least; with less, the longer
        part is one of ``stretches``.
        """
        p = self.p
        end = p.gapped_words - p.shingle + 1
        for low in range(p.half_words, end, p.shingle):
            lengths = range(low, min(low + p.shingle, end))
            less = p.gapped_words - lengths[-1]
            yield lengths, *self.gapped(word, *((low, less) if before else (less, low)))

    def changing(self, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of what surrounds each word with an open key beside it, and the word."""
        found = [(key, self.words[at]) for before, word in self.gaps(opened) for _, at, key in self.cores(before, word)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def gapped_stretches(self, opened: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and place of every stretch with one word left out that differs between texts."""
        found = []
        for before, word in self.gaps(opened):
            for lengths, at, key in self.cores(before, word):
                at = at[lit(changed, key)]
                for more in lengths:
                    less = self.p.gapped_words - more
                    fit, key = self.gapped(at, *((more, less) if before else (less, more)))
                    found.append((key, self.seg.doc[fit], fit - self.seg.first[self.seg.doc[fit]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text, and word of the text, of tokens."""
        return self.doc[at], self.first[at] - self.seg.first[self.doc[at]]

    def side(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have enough words on side k (0 after, 1 before) in their text, and the keys of these."""
        begin = self.first[at] - k * self.p.side_words
        words = self.p.shingle + self.p.side_words
        ok = (begin >= self.seg.first[self.doc[at]]) & (begin + words <= self.seg.first[self.doc[at] + 1])
        return ok, self.stretch(begin[ok], words, 1 + k)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, text and place of every anchor."""
        top, parts = np.unique(self.least), []
        for k in (0, 1):
            ok, key = self.side(top, k)
            parts.append((key, *self.place(top[ok])))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def stretches(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and place of every stretch of ``common`` tokens whose keys are marked.

        The least token of the run in its middle has both its sides inside the stretch, so
        equal stretches have equal keys.
        """
        p = self.p
        begin = self.start - (p.common - p.run) // 2
        ok = (begin >= 0) & (begin + p.common <= len(self.tokens))
        begin, least = begin[ok], self.least[ok]
        ok = (self.doc[begin] == self.doc[begin + p.common - 1]) & (self.doc[begin] == self.doc[least])
        begin, least = begin[ok], least[ok]
        for k in (0, 1):
            _, key = self.side(least, k)
            ok = lit(marks, key)
            begin, least = begin[ok], least[ok]
        return (self.stretch(self.first[begin], p.common + p.shingle - 1, 0), *self.place(begin))


def star(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows ordered by key, document and place: the row each links to.

    Rows of other documents link to the first row, further places in the first document to the
    first row of another document. Where there is none, and for the first row, the link is -1.
    """
    n = len(key)
    if not n:
        return np.zeros(0, np.int64)
    head = np.r_[True, key[1:] != key[:-1]]
    start, group = np.flatnonzero(head), np.cumsum(head) - 1
    lead = start[group]
    own = doc == doc[lead]
    partner = np.minimum.reduceat(np.where(own, n, np.arange(n)), start)[group]
    to = np.where(own, np.where(partner < n, partner, -1), lead)
    to[start] = -1
    return to


def by_key(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order by key, document and place. Most keys occur once, so only the others are sorted by all three."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    spot = np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(order) else order
    tied = order[spot]
    order[spot] = tied[np.lexsort((place[tied], doc[tied], key[tied]))]
    return order


def packed(starts: np.ndarray, part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of ``PACKED``: runs of the columns (key, doc, at, other, other_at), cut at ``starts``."""
    ends = pa.array(np.r_[starts, len(columns[0])].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(t))) for c, t in zip(columns, LINK_TYPES)]
    none = [pa.nulls(len(starts), pa.list_(pa.from_numpy_dtype(t))) for t in LINK_TYPES[len(lists):]]
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *lists, *none], ["part", *LINK])


def keyed(docs: DataFrame, p: Passages, hashed: Callable[[Tokens], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """A chunk's first text with each key (key, doc, at), one row for each range of keys (part), and
    links from all other places of the key in the chunk (part below 0).

    Combining inside chunks bounds the rows of a frequent passage by the number of chunks, and
    by the places in the text that is first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, place = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = by_key(key, doc, place)
            key, doc, place = key[order], doc[order], place[order]
            del order
            to = star(key, doc)
            none = to < 0
            part = (key[none] >> np.uint64(64 - PART_BITS)).astype(np.int64)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            yield packed(starts, part[starts], key[none].view(np.int64), doc[none], place[none])
            to, key, doc, place, ends = to[~none], key[~none], doc[~none], place[~none], (doc, place)
            starts = np.arange(0, len(key), LINKS_ROW)
            yield packed(starts, -1 - (key[starts] >> np.uint64(64 - PART_BITS)).astype(np.int64), key.view(np.int64), doc, place, *[e[to] for e in ends])

        for batch in batches:
            for part in flat.slices(batch, most=SLICE_BYTES):
                key, row, place = hashed(Tokens(part.column("text"), p))
                held.append((key, np.asarray(part.column("doc"))[row], place))
                size += part.column("text").nbytes
                rows += len(key)
                if size >= p.chunk_bytes or rows >= CHUNK_ROWS:
                    yield from flush()
                    held, size, rows = [], 0, 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, PACKED)


def linked(rows: DataFrame) -> DataFrame:
    """Links (key, doc, at, other, other_at): those of chunks, and those between the chunks' first texts.

    ``rows`` are read once. Of each range of keys the chunks' first texts meet in one task; links of chunks pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = -1

        def met() -> pa.RecordBatch:
            key, doc, at = (np.concatenate(c) for c in zip(*held))
            order = by_key(key, doc, at)
            key, doc, at = key[order], doc[order], at[order]
            to = star(key, doc)
            keep = to >= 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (key[keep], doc[keep], at[keep], doc[to[keep]], at[to[keep]])], LINK)

        for batch in batches:
            part = np.asarray(batch.column("part"))
            # Parts are ascending.
            done = int(np.searchsorted(part, 0))
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(0, done).flatten() for c in LINK], LINK)
            cuts = done + np.flatnonzero(np.diff(part[done:], prepend=-1))
            for start, end in zip(cuts, np.r_[cuts[1:], len(part)]):
                if held and part[start] != now:
                    yield met()
                    held = []
                now = part[start]
                held.append([np.asarray(batch.column(c).slice(start, end - start).flatten()) for c in LINK[:3]])
        if held:
            yield met()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, doc long, at int, other long, other_at int")


def differing(docs: DataFrame, p: Passages, opened: Callable[[], np.ndarray]) -> DataFrame:
    """Keys (key) around which the word left out differs between places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, most=SLICE_BYTES):
                key, word = Tokens(part.column("text"), p).changing(opened())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(word.astype(np.uint32).view(np.int32))], ["key", "word"])

    words = docs.select("text").mapInArrow(run, "key long, word int")
    return words.groupBy("key").agg(F.min("word").alias("one"), F.max("word").alias("other")).where("one <> other").select("key")


def marked(links: DataFrame) -> np.ndarray:
    """Bits of the keys that occur in several texts."""
    slots = links.select((F.col("key").bitwiseAND(MARKS - 1)).alias("slot")).distinct()
    rows = (slots.select(F.floor(F.col("slot") / MARKS_ROW).alias("row"), (F.col("slot") % MARKS_ROW).alias("bit"))
            .repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["row"] * (MARKS_ROW // 8):][: MARKS_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def confirm(pairs: DataFrame, p: Passages) -> DataFrame:
    """Passages of pairs (a, b, shifts, ta, tb): one row for each side and stretch.

    ``shifts`` are differences of word positions at which the texts were seen to agree. Rows
    with ``key`` only are keys of the first text where both agree outside their passages.
    """
    key_tokens = p.side_words + 1

    def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges of all windows with enough equal shingles, merged, from their first to their last equal one."""
        if len(equal) < p.tokens:
            return []
        total = np.concatenate([[0], np.cumsum(equal)])
        good = np.flatnonzero(total[p.tokens:] - total[:-p.tokens] >= p.common)
        if not len(good):
            return []
        cut = np.flatnonzero(np.diff(good) > p.least_words)
        start, end = good[np.r_[0, cut + 1]], good[np.r_[cut, len(good) - 1]] + p.tokens
        hits = np.flatnonzero(equal)
        start, end = hits[np.searchsorted(hits, start)], hits[np.searchsorted(hits, end) - 1] + p.shingle
        return list(zip(start.tolist(), end.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, "ta", SLICE_BYTES):
                tokens = []
                for text in ("ta", "tb"):
                    data, at = flat.texts(part.column(text))
                    seg = flat.words(data, at, flat.SPACED)
                    found, first = flat.windows(flat.Hasher(data, lower=True)(seg.start, seg.end), seg, p.shingle)
                    tokens.append((found, np.searchsorted(seg.doc[first], np.arange(part.num_rows + 1))))
                out: list[tuple] = []
                bare: list[tuple[int, np.ndarray]] = []
                for i, (a, b, shifts) in enumerate(zip(*[part.column(c).to_pylist() for c in ("a", "b", "shifts")])):
                    x, y = (t[s[i]: s[i + 1]] for t, s in tokens)
                    equal_x, equal_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
                    for shift in shifts:
                        low, high = max(0, shift), min(len(x), len(y) + shift)
                        if low < high:
                            same = x[low:high] == y[low - shift: high - shift]
                            equal_x[low:high] |= same
                            equal_y[low - shift: high - shift] |= same
                            if equal_x.all() and equal_y.all():
                                break
                    sides = stretches(equal_x), stretches(equal_y)
                    if all(sides):
                        out += [(a, b, s, e) for s, e in sides[0]] + [(b, a, s, e) for s, e in sides[1]]
                    if not equal_x.all() or not all(sides):
                        runs = np.flatnonzero(np.diff(equal_x, prepend=False, append=False)).reshape(-1, 2)
                        runs = runs[runs[:, 1] - runs[:, 0] >= key_tokens]
                        whole = np.array(sides[0] if all(sides) else [], np.int64).reshape(-1, 2)
                        # Stretches are ascending and apart.
                        spot = np.searchsorted(whole[:, 0], runs[:, 0], "right") - 1
                        inside = (spot >= 0) & (runs[:, 1] + p.shingle - 1 <= np.r_[whole[:, 1], 0][spot])
                        if not inside.all():
                            bare.append((i, runs[~inside]))
                keys = open_keys(part.column("ta"), bare) if bare else np.zeros(0, np.int64)
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*columns[k], *[None] * len(keys)], pa.int64()) for k in range(4)] + [pa.concat_arrays([pa.nulls(len(out), pa.int64()), pa.array(keys)])],
                    ["doc_id", "partner_id", "start_word", "end_word", "key"])

    def open_keys(column: pa.Array, bare: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Keys inside of runs [begin, end) of shingles of the rows named."""
        texts = Tokens(column.take(pa.array([i for i, _ in bare])), p, every=True)
        first = np.searchsorted(texts.doc, np.arange(len(bare)))
        runs = np.concatenate([at + of for at, (_, of) in zip(first, bare)])
        begin, end = runs[:, 0], runs[:, 1]
        top, found = np.unique(texts.least), []
        for k in (0, 1):
            ok, key = texts.side(top, k)
            low = top[ok] - k * p.side_words
            spot = np.searchsorted(begin, low, "right") - 1
            found.append(key[(spot >= 0) & (low + key_tokens <= end[spot])])
        return np.unique(np.concatenate(found)).view(np.int64)

    return pairs.mapInArrow(run, "doc_id long, partner_id long, start_word long, end_word long, key long")


def passages(docs: DataFrame, p: Passages = Passages(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, partner_id, start_word, end_word (exclusive): passages that occur in another document too.

    Every document that shares a passage has a row, with a document that holds it as partner:
    copies are linked to one representative, not to each other. Words are split at white space,
    A-Z in lower case. NULL and empty texts, NULL ids and texts shorter than a passage have no
    rows; rows with one id are one document; other columns are not read. The texts are
    compared pair by pair, so a key's group is never gathered.
    """
    # Everything that Python works on is written inside.
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _passages(docs, p, doc_id, text)


def _passages(docs: DataFrame, p: Passages, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].alias("text")).where("doc is not null and text is not null")
    context = docs.sparkSession.sparkContext
    links = materialize(linked(keyed(docs, p, Tokens.keys)), "links")
    marks = context.broadcast(marked(links))
    stretches = keyed(docs, p, lambda t: t.stretches(marks.value))

    def aligned(rows: DataFrame) -> DataFrame:
        ordered = rows.select(
            F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b"),
            F.when(F.col("doc") > F.col("other"), F.col("at") - F.col("other_at")).otherwise(F.col("other_at") - F.col("at")).alias("shift"))
        return ordered.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ta, tb = docs.select(F.col("doc").alias("a"), F.col("text").alias("ta")), docs.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
        return confirm(pairs.join(ta, "a").join(tb, "b").select("a", "b", "shifts", "ta", "tb"), p)

    pairs = materialize(aligned(links.union(linked(stretches))), "passage-pairs")
    found = materialize(confirmed(pairs), "confirmed")
    rows = found.where("key is null").drop("key").distinct()
    if p.tokens - p.common < p.shingle:
        return rows  # no passage has a changed word inside
    # A key of two texts hides nobody: they were compared.
    several = links.groupBy("key").agg(F.min("doc").alias("one"), F.max("doc").alias("two")).where("one <> two")
    left = materialize(found.where("key is not null").select("key").distinct().join(several.select("key"), "key", "left_semi"), "open-keys")
    if not left.limit(1).count():
        return rows
    opened = context.broadcast(marked(left))
    changed = context.broadcast(marked(differing(docs, p, lambda: opened.value)))
    gapped = keyed(docs, p, lambda t: t.gapped_stretches(opened.value, changed.value))
    # Pairs that were not aligned so are confirmed on all their shifts.
    known = pairs.withColumnRenamed("shifts", "known")
    more = aligned(linked(gapped)).join(known, ["a", "b"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))
    more = materialize(more.where("size(array_except(shifts, known)) > 0").select("a", "b", F.array_union("shifts", "known").alias("shifts")), "gapped-pairs")
    again = more.select("a", "b")
    rows = rows.join(again, (F.greatest("doc_id", "partner_id") == again["a"]) & (F.least("doc_id", "partner_id") == again["b"]), "left_anti")
    return rows.union(materialize(confirmed(more).where("key is null").drop("key").distinct(), "gapped-confirmed"))
