"""Alignment of two tokenizers over one text: where their tokens end together.

Token lists of a slice of documents lie flat with their parents, byte ends are cumulative sums
within each document, and a hash join on (document, end) finds the ends both share. They
cut a text into groups of tokens and link the two tokens that end there. Linked id pairs are
counted for each bucket of text; Spark adds the buckets' counts up, finds for each id of the
second vocabulary its most frequent partners, and hands every bucket the totals of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm import flat, pieces
from marketlake.llm.pool import WordPool, spread
from marketlake.session import materialize

#: Bytes of text whose pairs are counted together.
BUCKET_BYTES = 4_000_000
#: Distinct words kept encoded by a worker.
POOL_WORDS = 300_000
_MARK = np.uint16(0xFFFF)
#: Both tokenizers end a token before a space with a character after it; elsewhere a text is cut for the first one only.
_ODD = re.compile(r" \s|▁")
_CUT = re.compile(r"(?= \S)")


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Spelling:
    """Bytes of every id of a vocabulary, and its number as text."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.names = pa.array([str(i) for i in range(len(spelled))])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.start[ids], self.size[ids])]


class Coder:
    """Ids of whole texts by both vocabularies; each distinct word is encoded once."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # Spark's tasks use the cores; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(first)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_letters()
        by_id = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())
        special = {x["content"] for x in json.loads(self.tokenizer.to_str())["added_tokens"]}
        names: list[bytes] = [b""] * (by_id[-1][0] + 1)
        for i, t in by_id:
            names[i] = t.encode() if t in special else bytes(letters[c] for c in t)
        self.a = Spelling(names)
        sp = SentencePieceProcessor(model_file=second)
        piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b = Spelling([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(pieces.SPACE, " ").encode() for i, p in enumerate(piece)])
        self.library, self.whole = sp, pieces.encoder(second)
        # How many ids a word has by the first vocabulary, these, and then those by the second.
        self.words = WordPool(self._both, POOL_WORDS, recurring=True)

    def _both(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A word stands for itself after a space; one that starts with a space is literal, and only for the first vocabulary."""
        plain = np.array([w[0] != " " for w in words])
        ids, size = self._first([w for w, p in zip(words, plain.tolist()) if p])
        literal = [e.ids for e in self.tokenizer.encode_batch_fast([w for w in words if w[0] == " "], add_special_tokens=False)]
        found = self.library.encode([w for w in words if w[0] != " "], num_threads=1)
        n_a, n_b = np.empty(len(words), np.int64), np.zeros(len(words), np.int64)
        n_a[plain], n_a[~plain], n_b[plain] = size, [len(x) for x in literal], [len(x) for x in found]
        total = 1 + n_a + n_b
        both, start = np.empty(int(total.sum()), np.int32), np.cumsum(total) - total
        both[start] = n_a
        start += 1
        both[spread(start[plain], n_a[plain])] = ids
        both[spread(start[~plain], n_a[~plain])] = [i for x in literal for i in x]
        both[spread(start + n_a, n_b)] = np.fromiter(chain.from_iterable(found), np.int32, int(n_b.sum()))
        return both, total

    def _first(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded side by side in texts, since a token always ends before each, and cut by their bytes."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        texts = [" " + " ".join(words[i: i + 500]) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.a.size[ids])
        own = np.cumsum([len(w.encode()) + 1 for w in words])
        last = np.searchsorted(ends, own)
        if not np.array_equal(ends[last], own):
            raise ValueError("the first vocabulary does not cut before each word")
        return ids, np.diff(np.concatenate([[-1], last]))

    def texts(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For both vocabularies all ids end to end and the number of ids of each text, none of them empty."""
        plain = np.array([not _ODD.search(t) and not t[0].isspace() and t[-1] != " " for t in texts])
        words: list[str] = []
        ends = [0]
        for t, simple in zip(texts, plain.tolist()):
            words += t.split(" ") if simple else [w[1:] if w[1:2].strip() else w for w in _CUT.split(f" {t}") if w]
            ends.append(len(words))
        at = np.array(ends)
        code = self.words.codes(words)
        start = self.words.start[code]
        n_a = self.words.ids[start].astype(np.int64)
        start, n_b = start + 1, self.words.size[code] - 1 - n_a
        per_text = [np.diff(np.concatenate([[0], np.cumsum(n)])[at]) for n in (n_a, n_b)]
        ids_a = self.words.ids[spread(start, n_a)]
        simple = np.repeat(plain, np.diff(at))
        own = self.words.ids[spread((start + n_a)[simple], n_b[simple])]
        if plain.all():
            return (ids_a, per_text[0]), (own, per_text[1])
        rest, n_rest = self.whole.texts([t for t, s in zip(texts, plain.tolist()) if not s])
        size = per_text[1]
        size[~plain] = n_rest
        ids_b, begin = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        ids_b[spread(begin[plain], size[plain])], ids_b[spread(begin[~plain], n_rest)] = own, rest
        return (ids_a, per_text[0]), (ids_b, size)


@lru_cache(maxsize=1)
def coder(first: str, second: str) -> Coder:
    """One coder and its pools of words for all tasks of a worker."""
    return Coder(first, second)


def spelled_as(spelling: Spelling, ids: np.ndarray, size: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents' tokens spell out exactly their bytes."""
    n_bytes = spelling.size[ids]
    ends = np.concatenate([[0], np.cumsum(n_bytes)])[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
    good = np.diff(ends) == np.diff(at)
    if good.all():
        wrong = np.flatnonzero(spelling.bytes_of(ids) != data)
        good[np.searchsorted(at, wrong, "right") - 1] = False
        return good
    part = np.repeat(good, size)
    inside = np.repeat(good, np.diff(at))
    kept_at = np.concatenate([[0], np.cumsum(np.diff(at)[good])])
    wrong = np.flatnonzero(spelling.bytes_of(ids[part]) != data[inside])
    good[np.flatnonzero(good)[np.searchsorted(kept_at, wrong, "right") - 1]] = False
    return good


def ends_of(ids: np.ndarray, size: np.ndarray, spelling: Spelling, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its document and the byte where it ends there, as one key: the place among the bytes of all documents."""
    doc = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(spelling.size[ids])
    # Segmented: what the documents before it hold is subtracted, and where its own begins is added.
    total = np.concatenate([[0], end])[np.cumsum(size) - size]
    return doc, end + (at[:-1] - total)[doc]


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], spell_a: Spelling, spell_b: Spelling,
           at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in A and place in B of all tokens (ids, how many a document) that end together, in order.

    A hash join on (document, end): keys are places among the bytes ``at``, so the table of B's ends needs one slot for each byte and
    no two keys share one.
    """
    (doc, key), (_, other) = ends_of(*a, spell_a, at), ends_of(*b, spell_b, at)
    slot = np.full(int(at[-1]) + 1, -1, np.int32)
    slot[other] = np.arange(len(other), dtype=np.int32)
    second = slot[key]
    first = np.flatnonzero(second >= 0)
    return doc[first], first, second[first].astype(np.int64)


class Bucket:
    """Aligned documents of about ``BUCKET_BYTES``, and how often each id pair is linked in them."""

    def __init__(self, coder: Coder):
        self.coder, self.parts, self.size = coder, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        column = pc.fill_null(rows.column("text"), "")
        full = np.flatnonzero(np.asarray(pc.binary_length(column)) > 0)
        n = np.zeros((4, rows.num_rows), np.int64)
        digest = np.full(rows.num_rows, "", dtype=object)
        pairs = np.empty(0, np.int64)
        if len(full):
            texts = column.take(pa.array(full))
            data, at = flat.texts(texts)
            self.size += len(data)
            data, at = np.insert(data, at[:-1], 0x20), at + np.arange(len(at))
            (ids_a, n_a), (ids_b, n_b) = self.coder.texts(texts.to_pylist())
            good = spelled_as(self.coder.a, ids_a, n_a, data, at) & spelled_as(self.coder.b, ids_b, n_b, data, at)
            if not good.all():
                ids_a, ids_b, n_a, n_b, full = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], n_a[good], n_b[good], full[good]
                at = np.concatenate([[0], np.cumsum(np.diff(at)[good])])
            doc, first, second = linked((ids_a, n_a), (ids_b, n_b), self.coder.a, self.coder.b, at)
            pairs = ids_a[first].astype(np.int64) * len(self.coder.b.size) + ids_b[second]
            n[0, full], n[1, full] = n_a, n_b
            n[2, full] = n[3, full] = np.bincount(doc, minlength=len(full))
            digest[full] = self._digests(ids_a, ids_b, first, second, n[2, full])
        self.parts.append((rows.column("doc_id"), n, digest, pairs))

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, first: np.ndarray, second: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """A group ends with each link; it is spelled as the ids of either side."""
        sides = []
        for spelling, ids, last in ((self.coder.a, ids_a, first), (self.coder.b, ids_b, second)):
            offsets = pa.array(np.concatenate([[0], last + 1]), pa.int32())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, spelling.names.take(pa.array(ids))), ","))
        groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), pc.binary_join_element_wise(*sides, "|"))
        data, at = flat.texts(pc.binary_join(groups, ";"))
        data = data.tobytes()
        return [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """Documents with their links as ranks among the bucket's pairs, and one row of the pairs and their counts."""
        every = np.concatenate([p[3] for p in self.parts])
        counted = pa.table({"pair": every}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        pair, count = (np.asarray(counted[c].combine_chunks()) for c in ("pair", "count_all"))
        by_count = np.lexsort((pair, -count))
        pair, count = pair[by_count], count[by_count]
        ascending = np.argsort(pair)
        rank = ascending[np.searchsorted(pair[ascending], every)] if len(pair) else every
        done = 0
        for doc_id, n, digest, pairs in self.parts:
            own = rank[done: done + len(pairs)]
            done += len(pairs)
            ends = np.concatenate([[0], np.cumsum(n[3])])
            rare = own >= int(_MARK)
            rare_ends = np.concatenate([[0], np.cumsum(rare)])[ends]
            m = len(digest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), doc_id, *map(pa.array, n), pa.array(digest, pa.string()),
                 _binary(np.where(rare, _MARK, own).astype("<u2"), ends), _binary(own[rare].astype("<u4"), rare_ends),
                 pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))], _NAMES)
        if len(pair):
            one = pa.array([0, len(pair)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.nulls(1, self.parts[0][0].type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(one, pa.array(pair)),
                 pa.ListArray.from_arrays(one, pa.array(count))], _NAMES)


_NAMES = ["bucket", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "rare", "pairs", "counts"]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def aligned(docs: DataFrame, first: str, second: str, doc_id: str, text: str) -> DataFrame:
    """Rows of all buckets. A bucket's number names the task that made it, so a repeated task makes the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = coder(first, second), TaskContext.get().partitionId() << 32
        bucket = Bucket(own)
        for batch in batches:
            for part in flat.slices(batch):
                bucket.add(part)
                if bucket.size >= BUCKET_BYTES:
                    yield from bucket.rows(number)
                    bucket, number = Bucket(own), number + 1
        if bucket.parts:
            yield from bucket.rows(number)

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"bucket long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "links binary, rare binary, pairs array<long>, counts array<long>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(bucket, place, a, b, n, total): each bucket's pairs with their count there and everywhere.

    A pair has one row for each bucket that holds it, so no pair is a hot key.
    """
    each = rows.where("pairs is not null").select("bucket", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    each = each.select("bucket", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    each = each.withColumn("total", F.sum("n").over(Window.partitionBy("pair")))
    return each.select("bucket", "place", F.expr(f"cast(pair div {n_b} as int)").alias("a"), F.expr(f"cast(pair % {n_b} as int)").alias("b"), "n", "total")


def alignment(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (a, b, n, best).

    NULL and empty texts, and texts that either vocabulary does not spell out again, have no
    tokens and an empty digest; repeated rows count each. Other columns are not read.
    """
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=second).get_piece_size()
    rows = materialize(aligned(docs, first, second, doc_id, text), "aligned")
    counted = materialize(pair_counts(rows, n_b), "pair-counts")
    # One row for each id of the second vocabulary at most: its size bounds what is broadcast.
    highest = counted.groupBy("b").agg(F.max("total").alias("highest"))
    marked = counted.join(F.broadcast(highest), "b")
    known = marked.select("bucket", "place", "total", (F.col("total") == F.col("highest")).alias("best"))
    texts = rows.where("pairs is null").drop("pairs", "counts")

    def figures(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = np.asarray(right["place"].combine_chunks())
        total[place], best[place] = np.asarray(right["total"].combine_chunks()), np.asarray(right["best"].combine_chunks().cast(pa.int8()))
        n = np.asarray(left["n_links"].combine_chunks())
        own = np.frombuffer(b"".join(left["links"].to_pylist()), "<u2").astype(np.int64)
        own[own == int(_MARK)] = np.frombuffer(b"".join(left["rare"].to_pylist()), "<u4")
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[own])])[ends]) for x in (best, total)]
        return pa.table([*[left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(sums[0]), pa.array(sums[1]), left["groups_sha256"]],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = texts.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        figures, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    pairs = marked.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max(F.col("total") == F.col("highest")).alias("best"))
    return out, pairs
