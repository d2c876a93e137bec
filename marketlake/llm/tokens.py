"""Token ids in binary files: patched frame-of-reference blocks with an index.

A file holds the ids of consecutive documents. Ids are cut into blocks; each block stores its
minimum, a bit width that holds a chosen percentile of the differences, the packed low bits,
and a list of exceptions (position and whole difference) for the rest. The header lists where
each block starts and how many ids each document has.

File layout, little-endian: magic ``PFOR``, u32 block size, u32 partition, u32 sequence,
u64 ids before this file in its partition, u64 ids, u64 documents, u64 blocks, 32 bytes file
name; then u64 block starts, i64 document ids, u8 whether the id is present, u64 ids of each
document; then blocks: u32 minimum, u8 width, u8 bytes of an exception, u32 exceptions, packed
bits, u16 positions, differences of 2 or 4 bytes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm import flat
from marketlake.llm.pool import WordPool, spread
from marketlake.session import materialize

_HEAD = struct.Struct("<4sIIIQQQQ32s")
_BLOCK = struct.Struct("<IBBI")
_SPLIT = re.compile(r"[ \n\t]+")
#: Words of ASCII and Latin-1 letters, whose parts in the vocabulary's own splitting are known: contractions,
#: runs of letters, single digits, runs of other signs. Each part ends with an id of a word end.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+", re.I)
_END = "</w>"
#: Whole texts of such words, and their parts once folded to lower case.
_PLAIN_TEXT = re.compile("[\n\t -~À-ÖØ-öø-ÿ]*")
_FOLDED_PARTS = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9ß-öø-ÿ \n\t]+")


def bit_width(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value (0 for 0)."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, block: int = 256, percentile: int = 90) -> list[bytes]:
    """The blocks of an id array; full blocks of one width are packed together."""
    if not 0 < block <= 1 << 16:
        raise ValueError("a block has 1 to 65,536 ids")
    if not len(ids):
        return []
    ids = ids.astype(np.int64)
    n_full = len(ids) // block
    out: list[bytes] = []
    for rows in [ids[: n_full * block].reshape(n_full, block), ids[n_full * block:].reshape(1, -1)]:
        if not rows.size:
            continue
        least = rows.min(1)
        delta = rows - least[:, None]
        k = min(rows.shape[1] - 1, -(-rows.shape[1] * percentile // 100) - 1)
        width = bit_width(np.partition(delta, k, axis=1)[:, k])
        over = delta >= (np.int64(1) << width)[:, None]
        made: list[bytes] = [b""] * len(rows)
        for w in np.unique(width).tolist():
            of_width = np.flatnonzero(width == w)
            for which in np.array_split(of_width, -(-len(of_width) // 128)):
                bits = ((delta[which].astype(np.uint32)[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
                packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
                for i, r in enumerate(which.tolist()):
                    at = np.flatnonzero(over[r])
                    wide = 4 if len(at) and delta[r, at].max() > 0xFFFF else 2
                    made[r] = b"".join([_BLOCK.pack(int(least[r]), w, wide, len(at)), packed[i].tobytes(), at.astype("<u2").tobytes(),
                                        delta[r, at].astype(f"<u{wide}").tobytes()])
        out += made
    return out


def unpack(data: bytes, start: int, n: int) -> np.ndarray:
    """The n ids of the block at a byte position."""
    least, w, wide, n_over = _BLOCK.unpack_from(data, start)
    start += _BLOCK.size
    size = -(-n * w // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, start), bitorder="little", count=n * w).reshape(n, w)
    ids = bits.astype(np.int64) @ (np.int64(1) << np.arange(w, dtype=np.int64)) if w else np.zeros(n, np.int64)
    start += size
    at = np.frombuffer(data, "<u2", n_over, start)
    ids[at] = np.frombuffer(data, f"<u{wide}", n_over, start + 2 * n_over)
    return ids + least


def file_bytes(name: str, part: int, sequence: int, before: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray,
               block: int, percentile: int) -> bytes:
    blocks = pack(ids, block, percentile)
    head = _HEAD.size + 8 * len(blocks) + (8 + 1 + 8) * len(doc_ids)
    starts = head + np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0)
    return b"".join([
        _HEAD.pack(b"PFOR", block, part, sequence, before, len(ids), len(doc_ids), len(blocks), name.encode()),
        np.asarray(starts).astype("<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), sizes.astype("<u8").tobytes(), *blocks])


def parse(data: bytes) -> tuple[dict, list[int | None], np.ndarray, np.ndarray]:
    """Header, document ids, ids per document and all ids of a file."""
    magic, block, part, sequence, before, n_ids, n_docs, n_blocks, name = _HEAD.unpack_from(data)
    if magic != b"PFOR":
        raise ValueError("not a token file")
    at = _HEAD.size
    starts = np.frombuffer(data, "<u8", n_blocks, at)
    at += 8 * n_blocks
    docs = np.frombuffer(data, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    there = np.frombuffer(data, np.uint8, n_docs, at).tolist()
    at += n_docs
    sizes = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    ids = [unpack(data, s, min(block, n_ids - i * block)) for i, s in enumerate(starts.tolist())]
    head = {"name": name.decode(), "part": part, "before": before, "sequence": sequence}
    return head, [d if t else None for d, t in zip(docs, there)], sizes, np.concatenate(ids) if ids else np.empty(0, np.int64)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts; the vocabulary drops white space, so a text's ids are its words' ids."""

    def __init__(self, path: str, end_id: int | None):
        self.tokenizer, self.end_id = _tokenizer(path), end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(_END)]] = True
        # Signs stick to words, so distinct words are many more than the parts they are made of.
        self.parts, self.words = WordPool(self._encode_parts, 600_000), WordPool(self._encode, 100_000)
        letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and _PLAIN.fullmatch(chr(c))]
        upper, lower = (self.tokenizer.encode_batch_fast([f(c) for c in letters], add_special_tokens=False) for f in (str, str.lower))
        self.folds = all(x.ids == y.ids for x, y in zip(upper, lower))

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts are encoded side by side in texts and cut at word ends."""
        texts = [" ".join(parts[i: i + 500]) for i in range(0, len(parts), 500)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) != len(parts):
            raise ValueError("the vocabulary splits words in another way")
        return ids, np.diff(np.concatenate([[-1], ends]))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words are encoded as one text and cut at word ends, others one by one."""
        plain = [i for i, w in enumerate(words) if _PLAIN.fullmatch(w) and "<|" not in w]
        rest = sorted(set(range(len(words))) - set(plain))
        parts = np.array([len(_PARTS.findall(words[i])) for i in plain], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words[i] for i in plain)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) != parts.sum():
            raise ValueError("the vocabulary splits words in another way")
        size = np.zeros(len(words), np.int64)
        size[plain] = np.diff(np.concatenate([[0], ends[np.cumsum(parts) - 1] + 1])) if len(plain) else 0
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        size[rest] = [len(x) for x in lists]
        out = np.empty(size.sum(), np.int32)
        start = np.cumsum(size) - size
        out[spread(start[plain], size[plain])] = ids
        out[spread(start[rest], size[rest])] = [i for x in lists for i in x]
        return out, size

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self.folds and (not t or (_PLAIN_TEXT.fullmatch(t) is not None and "<|" not in t)) for t in texts]
        found = [_FOLDED_PARTS.findall(t.lower()) if t else [] for t, p in zip(texts, plain) if p]
        ids, size = self._gathered(self.parts, found)
        if not all(plain):
            rest, n_rest = self._gathered(self.words, [_SPLIT.split(t) if t else [] for t, p in zip(texts, plain) if not p])
            is_plain, both = np.array(plain, dtype=bool), np.empty(len(texts), np.int64)
            both[is_plain], both[~is_plain] = size, n_rest
            out, start = np.empty(int(both.sum()), np.int32), np.cumsum(both) - both
            out[spread(start[is_plain], size)], out[spread(start[~is_plain], n_rest)] = ids, rest
            ids, size = out, both
        if self.end_id is None:
            return ids, size
        return np.insert(ids, np.cumsum(size), self.end_id), size + 1

    @staticmethod
    def _gathered(pool: WordPool, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units of texts, and the number of ids of each text."""
        ids, size = pool.gather(pool.codes(list(chain.from_iterable(found))))
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[at])


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder and its pool of words for all tasks of a worker."""
    return Encoder(path, end_id)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
          file_ids: int = 4_000_000, block: int = 1_024, percentile: int = 95) -> DataFrame:
    """Encode all documents in ascending order of id into files below ``path``; returns the manifest.

    The texts are dealt by ranges of (id, hash of the text), so repeated ids may spread, and
    each task writes files of about ``file_ids`` ids. A file's name is unique, and only files
    in the manifest (written once) count, so a repeated task does no harm. NULL and empty
    texts give the end id alone; NULL ids come first. Other columns are not read.
    Manifest: name, part, sequence, n_docs, n_ids, start (ids in all files before).
    """
    context = docs.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(folder)  # there even without documents
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        # pyarrow knows the object store of s3a: and s3n: as s3:.
        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        store.create_dir(root, recursive=True)
        coder, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        sequence = before = 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, before, held
            name = uuid.uuid4().hex
            doc_ids = [d for x in held for d in x[0]]
            sizes, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            with store.open_output_stream(f"{root}/{name}.pfor") as f:
                f.write(file_bytes(name, part, sequence, before, doc_ids, sizes, ids, block, percentile))
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "sequence": [sequence], "before": [before],
                                              "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})
            sequence, before, held = sequence + 1, before + len(ids), []
            return row

        for batch in batches:
            for piece in flat.slices(batch):
                ids, sizes = coder.texts(piece.column("text").to_pylist())
                held.append((piece.column("doc_id").to_pylist(), sizes, ids))
                if sum(len(x[2]) for x in held) >= file_ids:
                    yield flush()
        if held:
            yield flush()

    files = materialize(dealt.mapInArrow(save, "name string, part long, sequence long, before long, n_docs long, n_ids long"), "token-files")
    # One row for each writing task: the tasks' offsets are few, files stay spread.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    return files.join(offsets, "part").select("name", "part", "sequence", "n_docs", "n_ids", (F.col("offset") + F.col("before")).alias("start"))


def read(manifest: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files in the manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    spark = manifest.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path).select("content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                head, docs, sizes, ids = parse(value.as_py())
                ends = np.cumsum(sizes)
                step = max(1, int(len(docs) * 1_000_000 // max(1, len(ids))))
                for i in range(0, len(docs), step):
                    j = min(len(docs), i + step)
                    first = int(ends[i] - sizes[i])
                    part = ids[first: int(ends[j - 1])].astype("<u4")
                    at = np.concatenate([[0], np.cumsum(sizes[i:j])])
                    crc = [zlib.crc32(part[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([head["name"]] * (j - i)), pa.array(docs[i:j], pa.int64()), pa.array(ends[i:j] - sizes[i:j], pa.int64()),
                         pa.array(sizes[i:j], pa.int64()), pa.array(crc, pa.int64()),
                         *([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(part.astype(np.int32), pa.int32()))] if with_ids else [])],
                        ["name", "doc_id", "at", "n_tokens", "ids_crc32", *made])

    made = ["ids"] if with_ids else []
    rows = found.mapInArrow(load, "name string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return rows.join(manifest.select("name", "start"), "name").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *made)
