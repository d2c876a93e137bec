"""Quality rules: repeated words and compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from marketlake.llm import flat

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Compression limits. A ratio is text bytes over zstandard bytes.

    ``whole`` lists (bytes from which it holds, lowest, highest ratio) ascending: longer
    texts compress better, so the band moves up with the length. The lowest ratios lie between
    random characters and prose of that length. ``chunk`` is the band of every full chunk of
    ``chunk_bytes`` and of as many last bytes; a text fails when more than ``bad_chunks`` of
    its chunks (as a share) lie outside.
    """

    min_words: int = 50
    repeat_percent: int = 50
    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0), (256, 1.14, 3.0), (384, 1.2, 3.0), (512, 1.27, 3.0), (1_024, 1.35, 3.5), (2_048, 1.4, 3.5), (4_096, 1.4, 4.0), (16_384, 1.4, 5.0), (65_536, 1.4, 6.0))
    chunk_bytes: int = 2_048
    chunk: tuple[float, float] = (1.4, 4.0)
    bad_chunks: float = 0.5


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()),
          ("bad_chunk_share", pa.float64())]
DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
       "kept boolean, ratio double, bad_chunk_share double")


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counted signals of every text."""
    w = flat.words(data, at, flat.SPACED)
    h = flat.Hasher(data)
    hashed = h(w.start, w.end)
    triples, first = flat.windows(hashed, w, 3)
    repeated = np.zeros(len(hashed), dtype=bool)
    if len(triples):
        _, group, size = np.unique(flat.fold(w.doc[first], triples), return_inverse=True, return_counts=True)
        hit = first[size[group] > 1]
        for k in range(3):
            repeated[hit + k] = True
    rows = flat.lines(data, at)
    has_word = np.searchsorted(w.start, rows.end) > np.searchsorted(w.end, rows.start, "right")
    start, end, doc = rows.start[has_word], rows.end[has_word], rows.doc[has_word]
    _, head = np.unique(flat.fold(doc, h(start, end)), return_index=True)
    again = np.ones(len(doc), dtype=np.int64)
    again[head] = 0
    n_docs = len(at) - 1
    return {
        "n_words": w.counts(),
        "word_chars": flat.per_doc(flat.SPACED[data] & ~flat.CONTINUATION[data], at),
        "n_symbols": flat.per_doc(_SYMBOLS[data], at),
        "n_dup_lines": np.bincount(doc, weights=again, minlength=n_docs).astype(np.int64)[:n_docs],
        "n_repeat_words": flat.per_doc(repeated, w.first),
    }


def in_band(size: int, ratio: float, bands: Bands) -> bool:
    """Whether a whole text's ratio fits its length; an empty text does."""
    low, high = next(((lo, hi) for floor, lo, hi in reversed(bands.whole) if size >= floor))
    return size == 0 or low <= ratio <= high


def ratios(data: memoryview, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text and the share of chunks outside the chunk band."""
    if not len(data):
        return 0.0, 0.0
    whole = len(data) / len(packer.compress(data))
    step = bands.chunk_bytes
    begins = list(range(0, len(data) - step + 1, step))
    if begins and len(data) % step:
        begins.append(len(data) - step)
    low, high = bands.chunk
    bad = sum(not low <= step / len(packer.compress(data[i:i + step])) <= high for i in begins)
    return whole, bad / len(begins) if begins else 0.0


def quality(docs: DataFrame, bands: Bands = Bands(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Signals and verdict of every text; one pass, no shuffle.

    ``keep`` names the columns carried along (default ``doc_id``). ``kept`` is false when the
    base rule fails (under ``min_words`` words, or more than ``repeat_percent`` percent of
    them inside repeated 3-word windows) or a compression ratio leaves its band. A NULL or
    empty text has no words, hence fails. Repeated rows are judged alike; an empty table
    gives an empty result. Columns of ``docs`` other than ``keep`` are not read, so clashing
    names do no harm.
    """
    keep = ["doc_id"] if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    inner = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [docs[text].alias("qtext")]))
    at_text = f"k{keep.index(text)}" if text in keep else "qtext"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in flat.slices(batch, at_text):
                data, at = flat.texts(part.column(at_text))
                out = counts(data, at)
                view = memoryview(np.ascontiguousarray(data))
                pairs = [ratios(view[a:b], bands, packer) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                out["ratio"] = np.array([p[0] for p in pairs])
                out["bad_chunk_share"] = np.array([p[1] for p in pairs])
                n, r = out["n_words"], out["n_repeat_words"]
                out["base_failed"] = (n < bands.min_words) | (100 * r > bands.repeat_percent * n)
                fits = [in_band(int(b - a), p[0], bands) and p[1] <= bands.bad_chunks
                        for a, b, p in zip(at[:-1], at[1:], pairs)]
                out["kept"] = ~out["base_failed"] & np.array(fits, dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f"k{i}") for i in range(len(keep))] + [pa.array(out[f], t) for f, t in FIELDS],
                    [f"k{i}" for i in range(len(keep))] + [f for f, _ in FIELDS])

    ddl = ", ".join([f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + [DDL])
    out = inner.mapInArrow(judge, ddl)
    return out.select(*[out[f"k{i}"].alias(c) for i, c in enumerate(keep)], *[out[f] for f, _ in FIELDS])
