"""Mixing, token alignment and phrases against plain code, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marketlake.llm import alignment, collocations, mixing

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns whose names the operators use inside.
CLASHES = ("size long, copy string, mix_source string, mix_target int, target int, n long, f long, prefix string, rest string, bucket int, "
           "pairs int, links int, rank int, score int, a int")
CLASH = (1, "c", "m", 2, 3, 4, 5, "p", "r", 6, 7, 8, 9, 10, 11)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["new", "york", "city", "of", "the", "Big", "apple", "x.y", "a,b", "\ttab", "É", "and\nso", "on!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de", None]),
             "hot" if rng.random() < 0.4 else rng.choice(["b", "c", "d", "é", None])) for i in range(300)]
    rows += [(1000, None, "en", "b"), (1001, "", None, None), (1002, "  ", "de", "empty"), (1003, "long " * 60_000, "fr", "big"),
             (7, "again", "en", "b"), (7, "again", "en", "b"), (None, "no id", None, "c"), (1004, "one", "en", None)]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, lang string, source string, {CLASHES}").repartition(4)


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(sizes, weights, percent, most):
    """Targets by sharing again and again in whole fractions."""
    from fractions import Fraction

    free = dict(zip(sizes, weights))
    total, target = Fraction(percent * sum(sizes.values()), 100), {}
    while free:
        rest, w = total - sum(target.values()), sum(free.values())
        over = [k for k in free if rest * free[k] / w > most * sizes[k]]
        if not over:
            target |= {k: rest * free[k] / w for k in free}
            break
        for k in over:
            target[k] = Fraction(most * sizes[k])
            del free[k]
    return target


def test_mix_reaches_its_targets(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += n_words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    sizes = {s: sizes[s] for s in order}
    for mix in (mixing.Mix(), mixing.Mix(percent=110, weights=(1, 9), seed=3), mixing.Mix(percent=250, most=2), mixing.Mix(percent=300, most=3)):
        want = shares(sizes, [mix.weights[i % len(mix.weights)] for i in range(len(order))], mix.percent, mix.most)
        got = mixing.repetitions(docs, mix).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
            rate = float(want[r["source"]]) / r["source_size"] if r["source_size"] else 0.0
            assert int(rate) <= r["copies"] <= -(-rate // 1) and r["copies"] <= mix.most
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), n_words(r["text"])) for r in rows)
    assert {(r["doc_id"], r["copies"]) for r in mixing.repetitions(docs).collect()} == {
        (r["doc_id"], r["copies"]) for r in mixing.repetitions(docs.repartition(7)).collect()}


def test_mix_emits_each_copy(docs):
    copies = Counter()
    for r in mixing.repetitions(docs).collect():
        copies[r["doc_id"], r["source"]] += r["copies"]
    out = mixing.emit(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    assert out.schema["copy"].dataType.simpleString() == "int" and out.schema["target"].dataType.simpleString() == "int"
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +copies
    assert mixing.repetitions(docs.limit(0)).count() == 0 and mixing.emit(docs.limit(0)).count() == 0


def test_mix_of_many_sources_comes_near(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"),
                                    F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"))
    for r in mixing.repetitions(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.04)


def test_places_by_ranges(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5003 as v").union(spark.createDataFrame([(None,)], "v long"))
    got = {r["v"]: r["number"] for r in mixing.numbered(df, [F.col("v").asc_nulls_last()]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got, key=lambda x: (x is None, x or 0)))}


def by_hand(texts):
    """Alignment of each text with the two libraries, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    letters, names = alignment.byte_letters(), {i: t for t, i in first.get_vocab().items()}
    out, counts = [], Counter()
    for t in texts:
        spelled = []
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
            spelled = [[bytes(letters[c] for c in names[i]) for i in a],
                       [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if not t or any(b"".join(s) != (" " + t).encode() for s in spelled):
            out.append(None)
            continue
        ends = [[len(b"".join(s[:i + 1])) for i in range(len(s))] if len(s) < 500 else list(__import__("itertools").accumulate(map(len, s))) for s in spelled]
        at = [dict(zip(e, ids)) for e, ids in zip(ends, (a, b))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(at[0][e], at[1][e]) for e in shared]
        counts.update(links)
        groups, low = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(x[k]) for k in sorted(x) if low < k <= e) for x in at) if len(shared) < 500 else None)
            low = e
        out.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None))
    highest = Counter()
    for (a, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], len(x[2]), len(x[2]), sum(counts[y] == highest[y[1]] for y in x[2]), sum(counts[y] for y in x[2]), x[3]) for x in out], counts, highest


def test_alignment_equals_plain_code(spark, docs, monkeypatch):
    rng = random.Random(9)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "foo", "Bar's", "<|endoftext|>", "é", "😀", "1234", " ", "　", "!?", "</s>", "\x00", "\x1c",
             "don't", "\r\n", "中文", "<0x41>", " the city", "ing", " of"]
    texts = [r["text"] for r in docs.collect()] + ["".join(rng.choices(parts, k=rng.randint(1, 20))) for _ in range(300)]
    texts += ["▁ as text", " ", "\n"]
    df = spark.createDataFrame([(i, t, *CLASH) for i, t in enumerate(texts)], f"doc_id long, text string, {CLASHES}").repartition(3)
    out, pairs = alignment.alignment(df, BYTES, PIECES)
    want, counts, highest = by_hand(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == (w if w[-1] is not None else (*w[:-1], got[i][-1]))
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {k: (n, n == highest[k[1]]) for k, n in counts.items()}


def test_alignment_of_odd_tables(spark, docs):
    out, pairs = alignment.alignment(docs.limit(0), BYTES, PIECES)
    assert out.count() == 0 and pairs.count() == 0
    none = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id int, text string")
    out, pairs = alignment.alignment(none, BYTES, PIECES)
    assert sorted(map(str, out.collect())) == sorted(map(str, [r for r in out.collect()])) and out.count() == 3 and pairs.count() == 0


def test_links_beyond_the_short_codes(spark):
    """More distinct pairs in a bucket than two bytes can name."""
    bucket = alignment.Bucket(alignment.coder(BYTES, PIECES))
    import numpy as np
    import pyarrow as pa

    pairs = np.concatenate([np.arange(70_000), np.arange(5)]).astype(np.int64)
    n = np.array([[1, 1], [1, 1], [70_000, 5], [70_000, 5]])
    bucket.parts.append((pa.array([1, 2]), n, np.array(["x", "y"], dtype=object), pairs))
    rows = list(bucket.rows(0))
    found = np.array(rows[1].column("pairs")[0].as_py())
    back = []
    for links, rare in zip(rows[0].column("links").to_pylist(), rows[0].column("rare").to_pylist()):
        own = np.frombuffer(links, "<u2").astype(np.int64)
        own[own == 0xFFFF] = np.frombuffer(rare, "<u4")
        back += found[own].tolist()
    assert back == pairs.tolist()


def phrases_by_hand(rows, least, cover, top, scale):
    langs = {}
    for text, lang in rows:
        f = langs.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            f.update(tuple(w[i:i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, f in langs.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in good.items():
            if any(100 * b >= cover * a for q, b in good.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n, -s))
    return sorted(out)


@pytest.mark.parametrize("held", [None, 50])
def test_phrases_equal_plain_code(docs, monkeypatch, held):
    if held:
        # Small containers: subtrees burst and are spilled many times (in this process: workers read the source).
        trie = collocations.Trie("en", None)
        monkeypatch.setattr(collocations, "HELD_KEYS", held)
        monkeypatch.setattr(collocations, "BURST", 4)
        import pyarrow as pa

        texts, total = [r["text"] for r in docs.where("lang = 'en' and text is not null").collect()], Counter()
        for t in texts:
            trie.add(pa.array([t]))
            if trie.full():
                for b in trie.run(False):
                    for r in b.to_pylist():
                        total[r["prefix"]] += r["n"]
        for b in trie.run(True):
            for r in b.to_pylist():
                total[r["prefix"]] += r["n"]
        want = Counter()
        for t in texts:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
                w = re.findall("[^ \t]+", piece)
                want.update([*w, *map(" ".join, zip(w, w[1:]))])
        total.pop("")
        assert total == want
        return
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    for mining in (collocations.Mining(least=3, top=40), collocations.Mining(least=8, cover=50, top=2000)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, mining).collect())
        assert got == phrases_by_hand(rows, mining.least, mining.cover, mining.top, mining.scale)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''")).count() == 0


def test_a_pool_keeps_the_words_that_come_up_again():
    import numpy as np

    from marketlake.llm.pool import WordPool

    asked = []

    def encode(words):
        asked.append(list(words))
        return np.concatenate([np.arange(len(w)) + ord(w[0]) for w in words]), np.array([len(w) for w in words])

    pool = WordPool(encode, 6, recurring=True)
    for words in (["aa", "b"], ["b", "ccc", "d"], ["e", "ff", "g", "b"], ["ccc", "b", "h"]):
        ids, size = pool.gather(pool.codes(words))
        assert size.tolist() == list(map(len, words)) and ids.tolist() == [ord(w[0]) + i for w in words for i in range(len(w))]
    # Beyond six words the pool was renewed: what came up once is encoded again, what came up again is not.
    assert asked == [["aa", "b"], ["ccc", "d"], ["e", "ff", "g"], ["ccc", "h"]]
