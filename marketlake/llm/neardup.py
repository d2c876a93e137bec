"""Near-duplicate documents by a chosen-path set similarity join.

Each document is its set of word shingles. Equal sets form one class at once. Classes then
branch down independent trees: at every node a class goes to the branches named by selected
minwise tokens of its set, so similar sets keep meeting while others part. Nodes that become
small are compared in all pairs; nodes that stay large after the last level hold sets that
are alike: in bounded blocks every member finds its most similar one first, and whatever then
lies outside a node's largest component is compared with all members, block by block. Links
are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import flat
from marketlake.llm.graph import components
from marketlake.session import materialize, small_batches

#: Minwise tokens kept of each set.
TOKENS = 48
#: Bytes of ids up to which they are sent to every task.
SENT_BYTES = 16_000_000
#: Bytes of text worked on at a time; shingles take many times as much.
SLICE_BYTES = 500_000
#: Bytes of rows sent to Python at a time.
BATCH_BYTES = 4_000_000
#: Shared shingles of two blocks that are compared at a time.
COLUMNS = 1 << 15
_RNG = np.random.default_rng(20240229)
_FACTOR = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64)


@dataclass(frozen=True)
class Join:
    """Parameters. ``percent``: links have 100 * intersection >= percent * union.

    A pair of similarity s meets in a tree with probability s at the root and
    1 - (1 - s ** chosen) ** branches at each further level: 8 trees miss a pair at 0.8 about 4
    times in a million. A pair at 0.4 meets again in 0.4 branches on average, so frequent
    passages part. A large node whose members agree in a share ``dense`` of their tokens would not
    part and stays as it is. ``loose`` is the estimate (share of equal minwise tokens) below which a
    candidate is not looked at: more than four standard deviations below 0.8.
    """

    words: int = 4
    percent: int = 80
    trees: int = 8
    chosen: int = 3
    branches: int = 6
    levels: int = 4
    small: int = 16
    dense: float = 0.35
    block: int = 128
    block_bytes: int = 4_000_000
    loose: float = 0.55


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text ascending, and where each text starts.

    A text of fewer than n words has its whole sequence as one shingle, one without words none.
    """
    seg = flat.words(data, at, flat.SPACED)
    hashes = flat.Hasher(data, lower=True)(seg.start, seg.end)
    found, first = flat.windows(hashes, seg, n)
    docs, values = [seg.doc[first]], [found]
    count = seg.counts()
    for short in range(1, n):
        which = np.flatnonzero(count == short)
        if len(which):
            total = np.full(len(which), short, np.uint64)
            for k in range(short):
                total = flat.mix(total + hashes[seg.first[which] + k])
            docs.append(which)
            values.append(total)
    return flat.distinct(np.concatenate(docs), np.concatenate(values), len(at) - 1)


def signatures(docs: DataFrame, join: Join, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, bytes of the text, two fingerprints of the set, and its minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, most=SLICE_BYTES):
                data, at = flat.texts(part.column("text"))
                sets, first = shingles(data, at, join.words)
                size = np.diff(first)
                full = np.flatnonzero(size > 0)
                prints = np.zeros((2, len(size)), np.uint64)
                tokens = np.zeros((len(size), TOKENS), np.int32)
                if len(full):
                    prints[0, full] = np.add.reduceat(sets, first[full])
                    prints[1, full] = np.add.reduceat(flat.mix(sets + np.uint64(1)), first[full])
                    for k in range(TOKENS):
                        tokens[full, k] = np.minimum.reduceat((sets * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32), first[full]).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * TOKENS, pa.int32()), pa.array(tokens.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.diff(at)), pa.array(prints[0].view(np.int64)),
                                                  pa.array(prints[1].view(np.int64)), lists], ["doc_id", "n", "bytes", "f", "g", "tokens"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n long, bytes long, f long, g long, tokens array<int>")


def similar(pairs: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b, fa, fb, ta, tb) whose full sets are similar; the texts must be those of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, "ta", SLICE_BYTES):
                sides, sizes, match = [], [], np.ones(part.num_rows, bool)
                for text, mark in (("ta", "fa"), ("tb", "fb")):
                    data, at = flat.texts(part.column(text))
                    sets, first = shingles(data, at, join.words)
                    size = np.diff(first)
                    full = np.flatnonzero(size > 0)
                    prints = np.zeros(len(size), np.uint64)
                    if len(full):
                        prints[full] = np.add.reduceat(sets, first[full])
                    match &= prints.view(np.int64) == np.asarray(part.column(mark))
                    sides.append(flat.fold(np.repeat(np.arange(len(size)), size), sets))
                    sizes.append(size)
                rows = np.repeat(np.arange(part.num_rows), sizes[0])
                common = np.bincount(rows, weights=np.isin(sides[0], sides[1]), minlength=part.num_rows)
                good = match & (100 * common >= join.percent * (sizes[0] + sizes[1] - common))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(good)), part.column("b").filter(pa.array(good))], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def _close(join: Join) -> str:
    """SQL: sizes and minwise tokens allow the pair to be similar."""
    return (f"100 * least(na, nb) >= {join.percent} * greatest(na, nb) and "
            f"aggregate(zip_with(xa, xb, (x, y) -> IF(x = y, 1, 0)), 0, (s, v) -> s + v) >= {int(join.loose * TOKENS)}")


def grow(classes: DataFrame, join: Join) -> tuple[list[DataFrame], DataFrame]:
    """Members (node, id) of small nodes, level by level, and of nodes still large at the end."""
    none = F.lit(0).cast("long")
    rows = classes.select("id", "tokens", F.explode(F.sequence(F.lit(0), F.lit(join.trees - 1))).alias("tree"))
    rows = rows.select("id", F.xxhash64("tree", F.expr("tokens[tree]"), none).alias("node"), "tree")
    small: list[DataFrame] = []
    whole: list[DataFrame] = []
    for level in range(join.levels):
        rows = materialize(rows, "nodes")
        sizes = materialize(rows.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"), "node-sizes")
        # Lone members meet nobody; small nodes are done; the others branch again unless they are dense.
        met = rows.join(sizes, "node")
        small.append(met.where(f"members <= {join.small}").select("node", "id"))
        if not sizes.where(f"members > {join.small}").limit(1).count():
            break
        large = materialize(met.where(f"members > {join.small}").select("node", "id", "tree", "members"), "large-nodes")
        if level == join.levels - 1:
            whole.append(large.select("node", "id"))
            break
        spots = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"tokens[{k}]").alias("v")) for k in range(TOKENS - 6, TOKENS)])
        votes = large.join(classes.select("id", "tokens"), "id").select("node", "members", F.explode(spots).alias("s"))
        votes = votes.groupBy("node", "members", "s").agg(F.count("*").alias("n")).groupBy("node", "members").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
        dense = materialize(votes.where(f"q >= {join.dense} * 6 * members * members").select("node"), "dense-nodes")
        whole.append(large.join(dense, "node", "left_semi").select("node", "id"))
        large = large.join(dense, "node", "left_anti")
        branch = F.explode(F.sequence(F.lit(0), F.lit(join.branches - 1))).alias("branch")
        spots = ", ".join(f"tokens[cast({join.trees} + pmod(xxhash64(tree, {level}, branch, {i}), {TOKENS - join.trees}) as int)]"
                          for i in range(join.chosen))
        rows = large.select("node", "id", "tree", branch).join(classes.select("id", "tokens"), "id").select(
            "id", F.expr(f"xxhash64(node, branch, {spots})").alias("node"), "tree")
    dense_rows = classes.select(none.alias("node"), "id").limit(0)
    for part in whole:
        dense_rows = dense_rows.union(part)
    return small, materialize(dense_rows, "dense-members")


def partners(blocks: DataFrame, join: Join) -> DataFrame:
    """The most similar member (by minwise tokens) of each member of a block (ids, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, tokens in zip(*[batch.column(c) for c in ("ids", "n", "tokens")]):
                ids, n = np.asarray(ids.values), np.asarray(n.values)
                grid = np.asarray(tokens.values).reshape(len(ids), TOKENS)
                equal = np.zeros((len(ids), len(ids)), np.int16)
                for k in range(TOKENS):
                    equal += grid[:, k, None] == grid[None, :, k]
                equal[100 * np.minimum(n[:, None], n) < join.percent * np.maximum(n[:, None], n)] = 0
                np.fill_diagonal(equal, 0)
                best = equal.argmax(1)
                good = equal[np.arange(len(ids)), best] >= join.loose * TOKENS
                yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(ids[best[good]])], ["a", "b"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"a {kind}, b {kind}")


def across(met: DataFrame, join: Join) -> DataFrame:
    """Similar pairs of different components between two blocks (out, all) of (id, c, f, text), on full sets."""

    def load(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = pa.RecordBatch.from_struct_array(column)
        found = [shingles(*flat.texts(piece.column("text")), join.words) for piece in flat.slices(part, most=SLICE_BYTES)]
        sets, size = np.concatenate([s for s, _ in found]), np.concatenate([np.diff(f) for _, f in found])
        first = np.concatenate([[0], np.cumsum(size)])
        prints = np.zeros(len(size), np.uint64)
        full = np.flatnonzero(size > 0)
        prints[full] = np.add.reduceat(sets, first[full]) if len(full) else 0
        size = np.where(prints.view(np.int64) == np.asarray(part.column("f")), size, 0)
        return np.asarray(part.column("id")), np.asarray(part.column("c")), np.repeat(np.arange(len(size)), np.diff(first)), sets, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out, every in zip(batch.column("out"), batch.column("all")):
                (ia, ca, ra, xa, na), (ib, cb, rb, xb, nb) = load(out.values), load(every.values)
                # Only shingles that both sides hold count, as columns, so many at a time.
                values = np.intersect1d(xa, xb)
                common = np.zeros((len(ia), len(ib)), np.float32)
                for low in range(0, len(values), COLUMNS):
                    columns, grids = values[low: low + COLUMNS], []
                    for ids, rows, held in ((ia, ra, xa), (ib, rb, xb)):
                        spot = np.minimum(np.searchsorted(columns, held), len(columns) - 1)
                        use = columns[spot] == held
                        grids.append(np.zeros((len(ids), len(columns)), np.float32))
                        grids[-1][rows[use], spot[use]] = 1
                    common += grids[0] @ grids[1].T
                total = na[:, None] + nb[None, :] - common
                good = (100 * common >= join.percent * total) & (common > 0) & (ca[:, None] != cb[None, :]) & (na[:, None] > 0) & (nb[None, :] > 0)
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ia[i], ib[j])), pa.array(np.maximum(ia[i], ib[j]))], ["a", "b"])

    kind = met.schema["out"].dataType.elementType["id"].dataType.simpleString()
    return met.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents without words have an empty set: they are linked with nothing and kept. Rows
    with the same set, repeated rows included, form one class with the smallest id; a NULL id
    never names a class with other ids. Only classes are compared. Other columns are not read.
    """
    # Everything that Python works on is written inside; a row of blocks alone has up to two blocks of text.
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _near_duplicates(docs, join, doc_id, text)


def _near_duplicates(docs: DataFrame, join: Join, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    marked = materialize(signatures(docs, join, "doc_id", "text"), "signatures")
    classes = marked.where("n > 0 and doc_id is not null").groupBy("f", "g", "n").agg(
        F.min("doc_id").alias("id"), F.max("bytes").alias("bytes"), F.first("tokens").alias("tokens"))
    classes = materialize(classes, "classes")
    small, large = grow(classes, join)
    sides = [classes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"x{s}"), F.col("f").alias(f"f{s}")) for s in "ab"]

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """Candidates (a, b) that sizes and tokens allow, with what the comparison needs."""
        met = pairs.distinct().join(sides[0], "a").join(sides[1], "b").where(_close(join))
        return materialize(met.select("a", "b", "fa", "fb", F.expr("aggregate(zip_with(xa, xb, (x, y) -> IF(x = y, 1, 0)), 0, (s, v) -> s + v)").alias("equal")), name)

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of the ids asked for. Where they are few enough to be sent to every task, no other text is shuffled."""
        found = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")
        held = ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 32)).first()[0] or 0
        return found.join(F.broadcast(ids), "id", "left_semi") if held <= SENT_BYTES else found

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs.select("a", "b", "fa", "fb"), f"{name}-candidates")
        wanted = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        ta, tb = wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), wanted.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return materialize(similar(pairs.join(ta, "a").join(tb, "b"), join), name)

    # Nodes of all levels are told apart by their hashes, so they are gathered at once.
    lists = reduce(DataFrame.union, small).groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    within = lists.select(F.explode(F.expr(
        "flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('a', x, 'b', y))))")).alias("p")).select("p.a", "p.b")
    candidates = checked(within, "candidates")
    # First the most similar partner of each class, in small nodes and in blocks of large ones: a forest that connects most.
    best = candidates.select("a", "b", "equal").union(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "equal"))
    best = best.groupBy("a").agg(F.min(F.struct((-F.col("equal")).alias("e"), "b")).alias("m")).select("a", "m.b")
    # A block has about ``block`` members and ``block_bytes`` of text at most.
    deal = F.expr(f"pmod(xxhash64(id, node), cast(ceil(greatest(members / {join.block}, bytes / {join.block_bytes})) as int))")
    sizes = materialize(large.join(classes.select("id", "bytes"), "id").groupBy("node").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes")), "large-sizes")
    dealt = large.join(sizes, "node").withColumn("block", deal)
    blocks = dealt.join(classes.select("id", "n", "tokens"), "id").groupBy("node", "block").agg(
        F.collect_list("id").alias("ids"), F.collect_list("n").alias("n"), F.flatten(F.collect_list("tokens")).alias("tokens"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    forest = best.union(partners(blocks.select("ids", "n", "tokens"), join)).select(*ordered).distinct()
    forest = forest.join(sides[0].select("a", "fa"), "a").join(sides[1].select("b", "fb"), "b")
    links = confirmed(forest, "forest-links")
    named = components(links)
    # Then every candidate that still lies across components.
    known = classes.select("id", "f").join(named.withColumnRenamed("node", "id"), "id", "left").select("id", "f", F.coalesce("component", "id").alias("c"))
    known = materialize(known, "known")
    ca, cb = known.select(F.col("id").alias("a"), F.col("c").alias("ca")), known.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    apart = candidates.select("a", "b", "fa", "fb").join(ca, "a").join(cb, "b").where("ca <> cb").select("a", "b", "fa", "fb")
    more = confirmed(apart, "more-links")
    placed = materialize(large.join(known, "id").select("node", "id", "f", "c"), "placed")
    parts = materialize(placed.groupBy("node", "c").agg(F.count("*").alias("n")), "node-parts")
    main = parts.groupBy("node").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("members")).where("k > 1")
    main = materialize(main.select("node", "members", F.col("m.c").alias("main")), "main-parts")
    if main.limit(1).count():
        inside = materialize(placed.join(main.drop("members"), "node").join(sizes, "node").withColumn("block", deal).select("node", "block", "id", "f", "c", "main"), "open-members")
        open_nodes = inside.join(texts_of(inside.select("id").distinct()), "id")
        member = F.collect_list(F.struct("id", "c", "f", "text"))
        everyone = materialize(open_nodes.groupBy("node", "block").agg(member.alias("all")), "node-blocks")
        outside = materialize(open_nodes.where("c <> main").groupBy("node", "block").agg(member.alias("out")), "outside-blocks")
        met = outside.join(everyone.select("node", "all"), "node").select("out", "all")
        more = more.union(materialize(across(met, join), "across-links"))
    named = components(links.union(more))
    final = materialize(classes.select("id", "f", "g", "n").join(named.withColumnRenamed("node", "id"), "id", "left").select(
        "f", "g", "n", F.coalesce("component", "id").alias("component")), "class-components")
    grouped = marked.select("doc_id", "n", "f", "g").where("n > 0 and doc_id is not null").join(final, ["f", "g", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = marked.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB text equal to ``near_duplicates(documents)``.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS sh
      FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
e AS (SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.h = q.h AND p.doc_id <> q.doc_id
      GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
