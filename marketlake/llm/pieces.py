"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All new words of a slice are merged together: flat arrays of symbols, the best-ranked pair
of every word by a segmented minimum, all its leftmost occurrences merged at once, finished
words compacted away, until no pair remains. The vocabulary file is read with the
sentencepiece library; encoding and decoding are done here.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from marketlake.llm import flat
from marketlake.llm.pool import WordPool, spread

SPACE = "▁"
#: A word with its space, spaces before another space, spaces alone, line breaks.
_WORD = re.compile(f"{SPACE}?[^{SPACE}\n]+|{SPACE}+(?={SPACE}[^{SPACE}\n])|{SPACE}+|\n+")
_NO_RANK = np.iinfo(np.int64).max
codecs.register_error("marketlake_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Tables of one vocabulary file (BPE with byte fallback, spaces only at word starts)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = sorted(set(range(n)) - set(special))
        byte_of = {i: int(text[i][3:5], 16) for i in special if sp.is_byte(i)}
        if len(byte_of) != 256 or any("\n" in text[i] or (SPACE in text[i][1:] and text[i].strip(SPACE)) for i in normal):
            raise ValueError("the vocabulary needs byte fallback, and words that start at spaces and end at line breaks")
        self.byte_id = np.zeros(256, np.int32)
        for i, b in byte_of.items():
            self.byte_id[b] = i
        self.char_id = np.full(0x110000, -1, np.int32)
        ids = {text[i]: i for i in normal}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        self.space_id = ids.get(SPACE, -1)
        score = np.array([sp.get_score(i) for i in range(n)])
        levels = np.unique(-score[normal])
        self.rank = np.searchsorted(levels, -score).astype(np.int64)
        # A piece is merged one occurrence at a time where a longer piece around it ranks as high.
        self.alone = np.zeros(n, dtype=bool)
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
                for part in (left, right):
                    if part is not None and self.rank[i] <= self.rank[part]:
                        self.alone[part] = True
        self.n = n
        self.pair_key = np.array(sorted(pairs), dtype=np.int64)
        self.pair_id = np.array([pairs[k] for k in self.pair_key.tolist()], dtype=np.int32)
        spelled = [bytes([byte_of[i]]) if i in byte_of else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i)
                   else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_size = np.array([len(x) for x in spelled], np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.spaced = np.zeros(n, dtype=bool)
        self.spaced[[i for i in normal if text[i].startswith(SPACE)]] = True

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, or -1."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_id[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol = self.char_id[points]
        alive = np.ones(len(symbol), dtype=bool)
        active = np.arange(len(symbol))
        while len(active) > 1:
            of = word[active]
            made = self.merged(symbol[active[:-1]], symbol[active[1:]])
            made[of[:-1] != of[1:]] = -1
            pair = np.flatnonzero(made >= 0)
            if not len(pair):
                break
            rank, pair_word = self.rank[made[pair]], of[pair]
            head = np.flatnonzero(np.r_[True, pair_word[1:] != pair_word[:-1]])
            group = np.cumsum(np.r_[False, pair_word[1:] != pair_word[:-1]])
            best = rank == np.minimum.reduceat(rank, head)[group]
            pair, group = pair[best], group[best]
            first = np.r_[True, group[1:] != group[:-1]]
            touching = np.r_[False, (pair[1:] == pair[:-1] + 1) & ~first[1:]]
            place = np.arange(len(pair))
            run = place - np.maximum.accumulate(np.where(touching, 0, place))
            careful = np.zeros(head.size, dtype=bool)
            careful[group[self.alone[made[pair]]]] = True
            pair = pair[np.where(careful[group], first, run % 2 == 0)]
            symbol[active[pair]] = made[pair]
            alive[active[pair + 1]] = False
            busy = np.zeros(len(words), dtype=bool)
            busy[pair_word] = True
            active = active[alive[active] & busy[of]]
        kept = np.flatnonzero(alive)
        out, n_bytes = symbol[kept], np.ones(len(kept), np.int64)
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            spelled = [np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8) for p in points[kept[unknown]].tolist()]
            n_bytes[unknown] = [len(x) for x in spelled]
            wide = np.repeat(out, n_bytes)
            wide[spread((np.cumsum(n_bytes) - n_bytes)[unknown], n_bytes[unknown])] = self.byte_id[np.concatenate(spelled)]
            out = wide
        return out, np.bincount(word[kept], weights=n_bytes, minlength=len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids. A leading space belongs to the model, not the text."""
        n_bytes = self.spell_size[ids]
        data = self.spell[spread(self.spell_start[ids], n_bytes)]
        ends = np.concatenate([[0], np.cumsum(n_bytes)])
        at, texts = np.concatenate([[0], np.cumsum(size)]), []
        marks = np.flatnonzero(self.control[ids])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            first = a
            while first < b and self.control[ids[first]]:
                first += 1
            skip = int(first < b and self.spaced[ids[first]])
            # Bytes on both sides of a control id do not make one character.
            cuts = [first, *marks[np.searchsorted(marks, first): np.searchsorted(marks, b)].tolist(), b]
            spelled = [data[ends[i]: ends[j]].tobytes().decode("utf-8", "marketlake_each_byte") for i, j in zip(cuts[:-1], cuts[1:])]
            texts.append("".join(spelled)[skip:])
        return texts


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes whole texts over a pool of words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pool = WordPool(self._encode, 150_000)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Long runs of spaces are cut: their ids repeat with the longest run in the vocabulary."""
        if not any(map(_is_long_run, words)):
            return self.pieces.encode(words)
        parts = [list(_cut_run(w)) if _is_long_run(w) else [w] for w in words]
        ids, size = self.pieces.encode([p for x in parts for p in x])
        owner = np.repeat(np.arange(len(words)), [len(x) for x in parts])
        return ids, np.bincount(owner, weights=size, minlength=len(words)).astype(np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        words, n_words = [], []
        for t in texts:
            found = _WORD.findall(SPACE + t.replace(" ", SPACE)) if t else []
            if t and "  " in t.replace(SPACE, " ") or t and t[0] in (" ", SPACE):
                found = self._join_spaces(found)
            words += found
            n_words.append(len(found))
        ids, size = self.pool.gather(self.pool.codes(words))
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)]
        return ids, np.diff(ends)

    def _join_spaces(self, found: list[str]) -> list[str]:
        """A space that its word leaves alone joins the spaces before it."""
        codes, out = self.pool.codes(found), []
        for i, w in enumerate(found):
            if out and out[-1].strip(SPACE) == "" and w[0] == SPACE and len(w) > 1 and w[1] != SPACE:
                start = self.pool.start[codes[i]]
                if self.pool.ids[start] == self.pieces.space_id:
                    out[-1] += SPACE
                    w = w[1:]
            out.append(w)
        return out


_LONG = 64


def _is_long_run(word: str) -> bool:
    return len(word) > _LONG and word[0] == SPACE and word[-1] == SPACE


def _cut_run(word: str) -> Iterator[str]:
    n = len(word)
    while n > _LONG:
        yield SPACE * 16
        n -= 16
    yield SPACE * n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder and its pool of words for all tasks of a worker."""
    return Encoder(load(path))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None,
           slice_bytes: int = flat.SLICE_BYTES) -> DataFrame:
    """Add the ids of every whole text, as the library encodes it without begin or end ids.

    NULL and empty texts have no ids. Rows are encoded where they lie, in slices of bounded
    size; repeated rows give repeated results; an existing column ``out`` is replaced. With
    ``decoded`` the text of the ids is added too, by the same Python worker.
    """
    keep = [c for c in docs.columns if c not in (out, decoded)]
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)])
    at_text = names[keep.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in flat.slices(batch, at_text, slice_bytes):
                ids, size = coder.texts(part.column(at_text).to_pylist())
                made = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    made.append(pa.array(coder.pieces.decode(ids.astype(np.int64), size), pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], *made], [*names, "ids", "decoded"][: len(names) + len(made)])

    rows = inner.mapInArrow(run, _ddl(docs, keep) + ", ids array<int>" + (", decoded string" if decoded else ""))
    return _renamed(rows, keep, {"ids": out} | ({"decoded": decoded} if decoded else {}))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of every list of ids; NULL gives an empty text, an unknown id an error."""
    keep = [c for c in docs.columns if c != out]
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)])
    at_ids = names[keep.index(ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            step = 512
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                column = part.column(at_ids)
                size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                texts = pieces.decode(np.asarray(column.flatten()).astype(np.int64), size)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return _renamed(inner.mapInArrow(run, _ddl(docs, keep) + ", decoded string"), keep, {"decoded": out})


def _ddl(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))


def _renamed(df: DataFrame, keep: list[str], made: dict[str, str]) -> DataFrame:
    return df.select(*[df[f"k{i}"].alias(c) for i, c in enumerate(keep)], *[df[m].alias(out) for m, out in made.items()])
