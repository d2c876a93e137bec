"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

Each class has discounted counts (of documents) of word pairs, words and word beginnings. What
the discount frees goes to the next shorter unit and in the end to continuation counts shared
by both classes, which are gathered from the whole corpus: in how many contexts a word stands.
They are needed for the words of the class counts only, as a word without such counts
has them in both classes alike.
The log-likelihood ratio, divided by the number of words, over the whole text, over its most
telling words and over its most telling run of words, becomes a probability by a logistic fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import flat
from marketlake.llm.language import held_out

#: Labelled rows of each class that a fit reads at most (chosen by a hash of the id).
SAMPLE_ROWS = 8_000
#: Contexts that a task holds before it passes them on.
HELD_CONTEXTS = 2_000_000
#: Contexts and words set aside for words and beginnings that the corpus does not hold.
UNSEEN = {1: 1 << 17, 0: 1 << 15}
PREFIX_BYTES = 5
DISCOUNT = 0.75
LEAST_COUNT = 2
#: Added to the count of a first word, as a share of the class's words: pairs after a rare word say little.
PAIR_SUPPORT = 1e-5
PAIR_PRIOR = 20.0
#: Words of the best run and number of most telling words.
WINDOW = 3
#: Counts up to which an expression is left to the backoff; the fit picks one.
RARE = (3, 7, 15, 30)
CLIP = 10.0
_PAIR, _WORD, _PREFIX = 2, 1, 0


def units(column: pa.Array) -> tuple[flat.Segments, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, hashes of their beginnings, and of each word with the one before (0 at a text's start)."""
    data, at = flat.texts(column)
    seg = flat.words(data, at, flat.ALNUM)
    h = flat.Hasher(data, lower=True)
    word = h(seg.start, seg.end)
    prefix = h(seg.start, np.minimum(seg.end, seg.start + PREFIX_BYTES))
    pair = np.zeros(len(word), dtype=np.uint64)
    if len(word) > 1:
        pair[1:] = np.where(seg.doc[1:] == seg.doc[:-1], flat.mix(word[1:] + word[:-1] * np.uint64(0xD6E8FEB86659FD93)), np.uint64(0))
    return seg, word, prefix, pair


def class_counts(labelled: DataFrame) -> DataFrame:
    """(kind, key, before, counts by class and part) of labelled texts (text, toxic, calibrate)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch):
                seg, word, prefix, pair = units(part.column("text"))
                cell = np.array([2 * c + (1 - t) for t, c in zip(part.column("toxic").to_pylist(), part.column("calibrate").to_pylist())], np.int64)[seg.doc]
                before = np.concatenate([np.zeros(1, np.uint64), word[:-1]]) if len(word) else word
                for kind, keys in ((_PAIR, pair), (_WORD, word), (_PREFIX, prefix)):
                    use = np.flatnonzero(keys != 0)
                    use = use[np.unique(flat.fold(seg.doc[use], keys[use]), return_index=True)[1]]
                    found, head, inverse = np.unique(keys[use], return_index=True, return_inverse=True)
                    counts = np.bincount(inverse * 4 + cell[use], minlength=4 * len(found)).reshape(-1, 4)
                    prev = before[use][head] if kind == _PAIR else np.zeros(len(found), np.uint64)
                    # Four counts in one number: each stays below 2 ** 15, as the sample does.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), kind, np.int8)), pa.array(found.view(np.int64)), pa.array(prev.view(np.int64)),
                         pa.array(counts @ (np.int64(1) << np.array([0, 15, 30, 45])))], ["kind", "key", "before", "packed"])

    cells = ["toxic_fit", "plain_fit", "toxic_cal", "plain_cal"]
    rows = labelled.select("text", "toxic", "calibrate").mapInArrow(count, "kind byte, key long, before long, packed long")
    added = rows.groupBy("kind", "key", "before").agg(F.sum("packed").alias("packed"))
    added = added.select("kind", "key", "before", *[
        F.expr(f"cast(shiftright(packed, {15 * i}) & 32767 as int)").alias(c) for i, c in enumerate(cells)])
    return added.where(" + ".join(cells) + f" >= {LEAST_COUNT}")


def shared_counts(texts: DataFrame, table: dict[str, np.ndarray]) -> dict[tuple[int, int], int]:
    """By (kind, key) of the class counts: in how many contexts a word stands over all texts, and
    how many words a beginning has. All other keys of a kind count together under key 0.

    Contexts are told apart by 32 bits of a hash (a word with n of them loses about n in 2 ** 33).
    A task sends each (key, context) once, packed by ranges of the context's hash, so that a
    frequent word's contexts spread over all of them.
    """
    spark = texts.sparkSession
    keys = {k: np.sort(table["key"][table["kind"] == k].view(np.uint64)) for k in (_WORD, _PREFIX)}
    shared = spark.sparkContext.broadcast(keys)
    # The row of a key; the first row of each kind is that of all other keys.
    base = {_WORD: 1, _PREFIX: 2 + len(keys[_WORD])}
    n_rows = base[_PREFIX] + len(keys[_PREFIX])
    bits = min(16, (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    rest = 32 - bits

    def packed(pairs: np.ndarray) -> pa.RecordBatch:
        """Distinct pairs as one record for each range of contexts: steps between ascending pairs, by bytes.

        All first bytes come first, then all second ones, and so on: the higher ones are nearly all zero.
        """
        bucket = ((pairs >> rest) & ((1 << bits) - 1)).astype(np.uint16)
        pairs = ((pairs >> 32) << rest) | (pairs & ((1 << rest) - 1))
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=1 << bits))
        parts = np.split(pairs[order], ends[:-1])
        steps = [np.diff(x, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in parts]
        used = [k for k, x in enumerate(parts) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([steps[k] for k in used], pa.binary())], ["bucket", "steps"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: Counts(v, np.zeros(0)) for k, v in shared.value.items()}
        held: list[np.ndarray] = [np.empty(0, np.int64)]
        size = 0
        for batch in batches:
            for part in flat.slices(batch):
                _, word, prefix, pair = units(part.column("text"))
                # A context of a word: the word with the one before, or the word alone at a text's start.
                for kind, of, context in ((_WORD, word, np.where(pair != 0, pair, word)), (_PREFIX, prefix, word)):
                    row = known[kind].find(of) + base[kind]
                    held.append(np.unique((row << 32) | (context >> np.uint64(32)).astype(np.int64)))
                    size += len(held[-1])
                if size >= HELD_CONTEXTS:
                    held = [np.unique(np.concatenate(held))]
                    size = 0
                    if len(held[0]) >= HELD_CONTEXTS:
                        yield packed(held[0])
                        held = [np.empty(0, np.int64)]
        last = np.unique(np.concatenate(held))
        if len(last):
            yield packed(last)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_rows, np.int64)
        of, held, size = None, [], 0

        def close() -> None:
            if held:
                total[:] += np.bincount(np.unique(np.concatenate(held)) >> rest, minlength=n_rows)

        for batch in batches:
            for k, steps in zip(*[c.to_pylist() for c in batch.columns]):
                if k != of:
                    close()
                    of, held, size = k, [], 0
                planes = np.frombuffer(steps, np.uint8).reshape(8, -1)
                held.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0].astype(np.int64)))
                size += len(held[-1])
                if size >= HELD_CONTEXTS:
                    held, size = [np.unique(np.concatenate(held))], 0
        close()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["row", "n"])

    sent = texts.mapInArrow(gather, "bucket int, steps binary")
    counted = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "row long, n long")
    out = {}
    for r in counted.groupBy("row").agg(F.sum("n").alias("n")).collect():
        kind = _PREFIX if r["row"] >= base[_PREFIX] - 1 else _WORD
        at = r["row"] - base[kind]
        out[kind, int(keys[kind][at]) if at >= 0 else 0] = r["n"]
    shared.unpersist()
    return out


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class Counts:
    """Sorted keys of one kind with their counts in (toxic, ordinary) text."""

    keys: np.ndarray
    count: np.ndarray
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.seen = np.zeros(1 << 23, dtype=bool)
        self.seen[slot_of(self.keys, 1 << 23)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key or -1."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.seen[slot_of(keys, 1 << 23)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), max(len(self.keys) - 1, 0))
        if len(self.keys):
            hit = self.keys[at] == keys[maybe]
            out[maybe[hit]] = at[hit]
        return out


class Model:
    """Smoothed ratios from counts."""

    def __init__(self, table: dict[str, np.ndarray], others: dict[int, int], columns: tuple[str, ...], rare: int):
        kinds = {}
        for kind in (_PREFIX, _WORD, _PAIR):
            rows = np.flatnonzero(table["kind"] == kind)
            keys = table["key"][rows].view(np.uint64)
            order = np.argsort(keys)
            counts = np.stack([sum(table[f"{name}_{c}"][rows].astype(np.int64) for c in columns) for name in ("toxic", "plain")], 1)[order].astype(np.float64)
            n = table["contexts"][rows][order] + 0.5
            kinds[kind] = (keys[order], counts, table["before"][rows].view(np.uint64)[order], n / max(n.sum() + others.get(kind, 0) + UNSEEN.get(kind, 0), 1.0))
        self.prefix, self.word, self.pair = (Counts(kinds[k][0], kinds[k][1]) for k in (_PREFIX, _WORD, _PAIR))
        self.total = np.maximum(self.word.count.sum(0), 1.0)
        self.word_share = discounted(self.word.count, rare) / self.total
        self.word_free = 1 - self.word_share.sum(0)
        prefix_share = discounted(self.prefix.count, rare) / self.total
        self.prefix_free = 1 - prefix_share.sum(0)
        self.shared = kinds[_WORD][3]
        self.prefix_ratio = prefix_share / kinds[_PREFIX][3][:, None] + self.prefix_free
        before = self.word.find(kinds[_PAIR][2])
        known = before >= 0
        # The share of a first word that its kept pairs take is common to both classes, and a
        # class that saw few of them leans on the common share.
        both, first = self.pair.count.sum(1), np.where(known, self.word.count[before].sum(1), 1.0)
        taken = np.where(known, discounted(both, rare) / (first + PAIR_SUPPORT * self.total.sum()), 0.0)
        common = np.where(both > 0, both / np.maximum(first, 1.0), 1.0)
        own = (self.pair.count + PAIR_PRIOR * common[:, None]) / (np.where(known[:, None], self.word.count[before], 0.0) + PAIR_PRIOR)
        self.pair_share = taken[:, None] * own / common[:, None]
        self.pair_free = np.maximum(1 - np.bincount(before[known], weights=taken[known], minlength=len(self.word.keys)), 1e-3)[:, None]

    def ratios(self, seg: flat.Segments, word: np.ndarray, prefix: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log P(word | toxic) / P(word | ordinary) of every word."""
        w, p, q = self.word.find(word), self.prefix.find(prefix), self.pair.find(pair)
        ratio = np.where((p >= 0)[:, None], self.prefix_ratio[p] if len(self.prefix_ratio) else 0.0, self.prefix_free)
        # Words without class counts leave the shared count out: it is the same in both classes.
        prob = self.word_free * ratio
        prob[w >= 0] = prob[w >= 0] * self.shared[w[w >= 0]][:, None] + self.word_share[w[w >= 0]]
        before = np.concatenate([[-1], w[:-1]]) if len(w) else w
        before = np.where(pair != 0, before, -1)
        prob[before >= 0] *= self.pair_free[before[before >= 0]]
        prob[q >= 0] += self.pair_share[q[q >= 0]]
        prob = np.maximum(prob, 1e-12)
        return np.clip(np.log(prob[:, 0] / prob[:, 1]), -CLIP, CLIP)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: 1, mean ratio, mean of the ``WINDOW`` highest, best mean over ``WINDOW`` words in a row."""
        seg, word, prefix, pair = units(column)
        n = seg.counts()
        out = np.zeros((len(n), 4))
        out[:, 0] = 1
        if len(word):
            ratio = self.ratios(seg, word, prefix, pair)
            total = np.concatenate([[0.0], np.cumsum(ratio)])
            full = np.flatnonzero(n > 0)
            first, last = seg.first[:-1][full], seg.first[1:][full]
            out[full, 1] = (total[last] - total[first]) / n[full]
            best = np.concatenate([[0.0], np.cumsum(ratio[np.lexsort((-ratio, seg.doc))])])
            top = np.minimum(n[full], WINDOW)
            out[full, 2] = (best[first + top] - best[first]) / top
            end = np.minimum(np.arange(len(word)) + WINDOW, seg.first[1:][seg.doc])
            start = np.maximum(end - WINDOW, seg.first[:-1][seg.doc])
            out[full, 3] = np.maximum.reduceat((total[end] - total[start]) / (end - start), first)
        return out


@dataclass
class Fitted:
    """What travels to the tasks: counts, contexts of all other words and beginnings, and the fit. Models are built from it once in each worker."""

    table: dict[str, np.ndarray]
    others: dict[int, int]
    columns: tuple[str, ...]
    rare: tuple[int, ...]
    weights: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def models(self) -> list[Model]:
        if self.token not in _BUILT:
            _BUILT.clear()
            _BUILT[self.token] = [Model(self.table, self.others, self.columns, r) for r in self.rare]
        return _BUILT[self.token]


_BUILT: dict[str, list[Model]] = {}


def discounted(count: np.ndarray, rare: int) -> np.ndarray:
    """What is left of counts after the discount; up to ``rare`` nothing, so such units are left to the backoff."""
    return np.where(count > rare, count - DISCOUNT, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * b
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        b = b + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Fitted:
    """Fit on labelled documents that are not held out; the shared counts cover all documents.

    At most ``sample_rows`` (below 16,000) labelled rows of each class are read, a documented bound. A quarter
    of the ids (crc32 modulo 4 is 3) is kept for the logistic fit on counts of the others.
    Without labels of both classes every score is the share of toxic labels (0 without any).
    """
    if not 0 < sample_rows < 16_000:
        raise ValueError("sample_rows must lie between 1 and 15,999")  # four counts of a row share one number
    spark = docs.sparkSession
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.when(F.max("toxic") > 0, 1).otherwise(0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for t in (0, 1)]
    sample = picked[0].unionByName(picked[1]).withColumn("calibrate", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 3, 1).otherwise(0))
    texts = docs.select(docs["doc_id"], docs["text"]).where("text is not null")
    # The sample has at most 2 * sample_rows small rows, whatever the input.
    labelled = texts.join(F.broadcast(sample), "doc_id")
    counted = class_counts(labelled).toArrow()
    table = {c: np.asarray(counted[c]) for c in counted.column_names}
    table |= {c: table[c].astype(np.int16) for c in table if c not in ("kind", "key", "before")}
    found = shared_counts(texts.select("text"), table)
    table["contexts"] = np.array([found.get((k, x), 0) for k, x in zip(table["kind"].tolist(), table["key"].view(np.uint64).tolist())], np.int64)
    others = {k: n for (k, x), n in found.items() if x == 0}
    shared = spark.sparkContext.broadcast(Fitted(table, others, ("fit",), RARE, np.zeros(4)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch):
                x = np.hstack([m.features(part.column("text")) for m in shared.value.models()])
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(x))], ["toxic", "x"])

    rows = labelled.where("calibrate = 1").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    shared.unpersist()
    y = np.asarray(rows["toxic"]).astype(np.float64)
    x = np.array(rows["x"].to_pylist()).reshape(len(y), len(RARE), 4)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not 0 < y.sum() < len(y):
        flat_fit = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0, 0, 0])
        return Fitted(table, others, ("fit", "cal"), RARE[:1], flat_fit)
    weight = np.where(y > 0, sizes.get(1, 0) / y.sum(), sizes.get(0, 0) / (len(y) - y.sum()))
    weight /= weight.mean()
    fits = [logistic(x[:, i], y, weight) for i in range(len(RARE))]
    losses = [float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x[:, i] @ b))).sum()) for i, b in enumerate(fits)]
    chosen = int(np.argmin(losses))
    # All labelled counts are larger by this factor than those the limit was chosen on.
    fit_sum, cal_sum = (table[f"toxic_{c}"].sum(dtype=np.int64) for c in ("fit", "cal"))
    rare = round(RARE[chosen] * (fit_sum + cal_sum) / max(1, fit_sum))
    return Fitted(table, others, ("fit", "cal"), (rare,), fits[chosen])


def score(docs: DataFrame, model: Fitted, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` of every whole text; no shuffle.

    NULL, empty and wordless texts get the score of a text without evidence. Repeated rows are
    scored alike; columns other than ``keep`` and the text are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)], docs[text].alias("xtext"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m,), weights = shared.value.models(), shared.value.weights
        for batch in batches:
            for part in flat.slices(batch, "xtext"):
                p = 1 / (1 + np.exp(-np.clip(m.features(part.column("xtext")) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in names], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    ddl = ", ".join([*[f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "score double, predicted int"])
    out = inner.mapInArrow(run, ddl)
    return out.select(*[out[k].alias(c) for k, c in zip(names, keep)], "score", "predicted")
