"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier is built from
the n-gram counts of the languages on either side; the margins of all bits are compared with
every codeword under a weighted logistic loss and the nearest codeword wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import flat

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII other than letters becomes one space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128][~_ASCII_LETTER[:128]] = 0x20


def held_out(column) -> object:
    """Whether a document is kept out of learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = flat.texts(pc.utf8_lower(column))
    return _FOLD[data], at


def grams(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the byte n-gram that ends at each byte; ``BUCKETS`` where its text has not so many bytes yet."""
    code = data.astype(np.uint64)
    for back in range(1, order):
        code[back:] = code[back:] | (data[:-back].astype(np.uint64) << np.uint64(8 * back))
    slot = (((code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)
    for k in range(order - 1):
        slot[(at[:-1] + k)[at[:-1] + k < at[1:]]] = BUCKETS
    return slot


def n_grams(size: np.ndarray) -> np.ndarray:
    """How many n-grams of all orders texts of so many bytes have."""
    return sum(np.maximum(size - order + 1, 0) for order in ORDERS)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all texts, added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in flat.slices(batch):
                data, at = _lowered(part.column("text"))
                langs = part.column("lang").to_pylist()
                slots = [grams(data, at, order) for order in ORDERS]
                for name in set(langs):
                    of = np.repeat(np.array([x == name for x in langs]), np.diff(at))
                    sums = total.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                    for slot in slots:
                        sums += np.bincount(slot[of], minlength=BUCKETS + 1)[:BUCKETS]
        for name, sums in total.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())],
                                             ["lang", "bucket", "n"])

    chosen = docs.select(docs[text].alias("text"), docs[lang].alias("lang")).where("text is not null and lang is not null")
    return chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1. Up to five classes: every split; beyond: the best of fixed random draws."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 5:
        return np.array([[1 if (s >> i) & 1 else -1 for s in range(1, 1 << (k - 1))] for i in range(k)]) if k > 1 else np.ones((k, 0))
    bits, rng = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7)
    best, widest = None, -1
    for _ in range(100):
        code = rng.choice([-1, 1], size=(k, bits))
        least = int(((bits - code @ code.T) / 2 + bits * np.eye(k)).min())
        if least > widest and (np.abs(code.sum(0)) < k).all():
            best, widest = code, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray        # languages x bits
    weights: np.ndarray     # buckets x bits
    bit_weight: np.ndarray  # bits


def fit(counts: dict[str, np.ndarray], smooth: float = 0.5) -> Model:
    """Binary classifiers of all bits from the n-gram counts of each language."""
    langs = sorted(counts)
    code = codewords(len(langs))
    share = np.array([(counts[x] + smooth) / (counts[x].sum() + smooth * BUCKETS) for x in langs]).reshape(len(langs), BUCKETS)
    weights, power = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(yes / no)
        power[b] = ((yes - no) * weights[:, b]).sum()
    return Model(langs, code, weights, power / power.sum() if len(power) else power)


def decode(model: Model, margin: np.ndarray) -> np.ndarray:
    """Share of each language: softmax of minus the weighted loss against its codeword."""
    if not model.code.shape[1]:
        return np.ones((len(margin), len(model.langs)))
    scale = 10.0 * margin[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -scale) * model.bit_weight).sum(2)
    share = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
    return share / share.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, clear: float = 0.2) -> DataFrame:
    """``lang_pred``, ``score``, the second language and ``ambiguous`` for every whole text.

    NULL texts and texts without a letter are ``und`` with score 0. ``ambiguous`` says that
    the best two codewords are closer than ``clear``. Without any learned language all texts
    are ``und``. Ties go to the language first in order. Other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)], docs[text].alias("ltext"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.langs, "und"], dtype=object)
        weights = [np.append(w, np.float32(0)) for w in m.weights.T]
        for batch in batches:
            for part in flat.slices(batch, "ltext"):
                column = part.column("ltext")
                raw, raw_at = flat.texts(column)
                lettered = flat.per_doc(_ASCII_LETTER[raw], raw_at) > 0
                for i in np.flatnonzero(~lettered & (np.diff(raw_at) > 0)):
                    lettered[i] = bool(_LETTER.search(column[int(i)].as_py()))
                data, at = _lowered(column)
                size, n_bits = np.diff(at), m.code.shape[1]
                full = np.flatnonzero(size > 0)
                margin = np.zeros((len(size), n_bits))
                if len(full) and n_bits:
                    for order in ORDERS:
                        slot = grams(data, at, order)
                        for b in range(n_bits):
                            margin[full, b] += np.add.reduceat(weights[b][slot], at[full], dtype=np.float64)
                    margin[full] /= n_grams(size[full])[:, None]
                if len(m.langs):
                    share = decode(m, margin)
                    order = np.argsort(-share, axis=1, kind="stable")
                    top = share[np.arange(len(share)), order[:, 0]]
                    if len(m.langs) > 1:
                        second, next_best = share[np.arange(len(share)), order[:, 1]], order[:, 1]
                    else:
                        second, next_best = np.zeros(len(share)), np.full(len(share), len(m.langs))
                    best = np.where(lettered, order[:, 0], len(m.langs))
                else:
                    top = second = np.zeros(len(size))
                    best = next_best = np.zeros(len(size), dtype=np.int64)
                known = lettered & (best < len(m.langs))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in names] + [
                        pa.array(labels[best], pa.string()), pa.array(np.where(known, top, 0.0), pa.float64()),
                        pa.array(np.where(known, labels[next_best], "und"), pa.string()),
                        pa.array(known & (top - second < clear), pa.bool_())],
                    [*names, "lang_pred", "score", "second", "ambiguous"])

    ddl = ", ".join([*[f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)],
                     "lang_pred string, score double, second string, ambiguous boolean"])
    out = inner.mapInArrow(score, ddl)
    return out.select(*[out[k].alias(c) for k, c in zip(names, keep)], "lang_pred", "score", "second", "ambiguous")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows with text and language; what reaches the driver is bounded by
    the number of languages times ``BUCKETS``."""
    counts: dict[str, np.ndarray] = {}
    for r in gram_counts(docs, text, lang).groupBy("lang").agg(
            F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():
        counts[r["lang"]] = np.zeros(BUCKETS, dtype=np.int64)
        counts[r["lang"]][np.array(r["b"])] = np.array(r["n"])
    return fit(counts)
