"""Language and token files: results that do not depend on neighbours, order, partitions or missing documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlake.llm import language, tokens
from marketlake.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASHES = "lang_pred string, score string, second int, ltext string, k0 int"
CLASH = ("x", "y", 1, "z", 2)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    letters = {"aa": "abcde ", "bb": "efghi ", "cc": "xyzéü "}
    rows = [(i, "".join(rng.choices(letters[x], k=rng.choice([1, 2, 3, 5, 40, 300]))), x) for i, x in enumerate(rng.choices(list(letters), k=240))]
    rows += [(900, "ab", "aa"), (900, "ab", "aa"), (901, None, "aa"), (902, "", "bb"), (903, "12 !", "cc"), (904, "ABCDE " * 30_000, "aa"), (905, "xyz", None)]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, lang string, {CLASHES}")


def counts_by_hand(rows):
    out = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            sums = out.setdefault(lang, np.zeros(language.BUCKETS, np.int64))
            data = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()], np.uint8)
            for order in language.ORDERS:
                for i in range(order - 1, len(data)):
                    code = sum(int(data[i - k]) << (8 * k) for k in range(order))
                    sums[((code + order) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48] += 1
    return out


def test_margins_equal_plain_code(docs):
    rows = [(r["text"], r["lang"]) for r in docs.where("doc_id <> 904").collect()]
    few = docs.where("doc_id <> 904")
    got = {}
    for r in language.gram_counts(few).collect():
        got.setdefault(r["lang"], np.zeros(language.BUCKETS, np.int64))[r["bucket"]] = r["n"]
    want = counts_by_hand(rows)
    assert set(got) == set(want) and all((got[x] == want[x]).all() for x in want)
    model = language.fit(want)
    for text in ("ab", "a", "xyzé", "efg hi!", "abcdefghi"):
        own = counts_by_hand([(text, "t")])["t"]
        margin = own @ model.weights / own.sum()
        share = language.decode(model, margin[None, :])[0]
        r = language.predict(few.limit(1).withColumn("text", F.lit(text)), model).first()
        assert r["lang_pred"] == model.langs[int(share.argmax())] and r["score"] == pytest.approx(share.max(), abs=1e-5)


def test_neighbours_order_and_partitions_do_not_matter(spark, docs):
    model = language.learn(docs)
    want = sorted(map(str, language.predict(docs.coalesce(1), model).collect()))
    for other in (docs.repartition(7), docs.orderBy(F.desc("text")), docs.orderBy(F.xxhash64("doc_id"))):
        assert sorted(map(str, language.predict(other, model).collect())) == want
        again = language.learn(other)
        assert (again.weights == model.weights).all()
    alone = {language.predict(docs.where("doc_id = 900").limit(1), model).first()["score"]}
    for before in ("xyz", "efghi", "ab", ""):
        two = spark.createDataFrame([(1, before), (2, "ab")], "doc_id int, text string").coalesce(1)
        alone |= {r["score"] for r in language.predict(two, model).where("doc_id = 2").collect()}
    assert len(alone) == 1


def test_odd_tables_have_results(docs):
    model = language.learn(docs.limit(0))
    assert [r["lang_pred"] for r in language.predict(docs.where("doc_id in (900, 901)"), model).collect()] == ["und"] * 3
    model = language.learn(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, model).where("doc_id >= 900").collect()}
    assert {(901, "und"), (902, "und"), (903, "und"), (904, "aa"), (905, "cc"), (900, "aa")} == got
    assert language.predict(docs.limit(0), model).count() == 0
    assert language.predict(docs, model, keep=["doc_id", "lang", "k0"]).columns[:3] == ["doc_id", "lang", "k0"]


def test_token_files_of_an_empty_table(spark, docs):
    path = scratch_path(spark, "no-tokens")
    manifest = tokens.write(docs.limit(0), WORDS, path)
    assert manifest.count() == 0 and tokens.read(manifest, path).count() == 0


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(WORDS), random.Random(3)
    parts = ["a", "B", "É", "ß", "'s", "'S", "'Re", "''", "don't", "1", "23", "!?", " ", "\n", "\t", "  ", "<|endoftext|>", "<|", "|>", "×", "«", "ö", "\r", "İ", "Σ",
             "中", "😀", "word", "THE", "_", "\x00", "\x7f", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    ids, size = tokens.encoder(WORDS, 2).texts(texts)
    want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert size.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_token_files_read_back(spark, docs):
    path = scratch_path(spark, "some-tokens")
    got = tokens.read(tokens.write(docs.repartition(3), WORDS, path, file_ids=2_000), path).collect()
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(WORDS), 0
    rows = docs.select("doc_id", "text").collect()
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((r["doc_id"], zlib.crc32(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in rows)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == want and [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [x for x, _ in want]


def test_segments_of_grams():
    data, at = language._lowered(pa.array(["ab", "", "xyz"]))
    assert (language.grams(data, at, 3)[:4] == language.BUCKETS).all() and language.grams(data, at, 3)[4] < language.BUCKETS
    assert language.n_grams(np.array([2, 0, 3])).tolist() == [3, 0, 6]
