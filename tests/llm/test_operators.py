"""The ten operators on hand-made documents: edge cases, brute force, exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marketlake.llm import decontam, flat, graph, language, neardup, passages, pieces, pii, quality, tokens, toxicity, wrappers
from marketlake.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names the operators use inside.
CLASHES = "ids string, spans string, k0 int, k1 int, n_words int, node long, a long, id long, tokens int, host string, decoded int"
CLASH = ("x", "y", 1, 2, 3, 4, 5, 6, 7, "h", 8)
LONG = "lorem ipsum dolor sit amet " * 6000


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    body = prose(1, 120)
    return [None, "", " ", "one", "two words", "É ü ñ 😀 12", body, body, body.replace(body.split()[60], "changed"), prose(2, 120), LONG,
            "\n".join([prose(3, 20)] * 4), "a" * 3000, "ENDE. " + prose(4, 60) + " +1 (988) 555-2485 mail a@b.example.org"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, *CLASH) for i, t in enumerate(texts)]
    rows += [(3, "one", *CLASH), (None, "no id", *CLASH)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *cols):
    return sorted((tuple(r) for r in df.select("doc_id", *cols).collect()), key=str)


def test_counts_equal_plain_code(docs, empty):
    got = by_id(quality.quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        row = (r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed)
        want.append(row)
    assert [g[:-1] for g in got] == sorted(want, key=str)
    kept = {g[0]: g[-1] for g in got}
    assert kept[6] and kept[9] and not kept[0] and not kept[10] and not kept[12]
    assert quality.quality(empty).count() == 0


def test_bands_reject_repetition_and_noise(spark):
    noise = "".join(random.Random(5).choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/ ") for _ in range(6000))
    slow = " ".join(f"{w} {i}" for i, w in enumerate(["same"] * 900))
    df = spark.createDataFrame([(1, noise), (2, slow), (3, prose(8, 700))], "doc_id long, text string")
    tight = quality.Bands(whole=((0, 1.5, 3.0),), chunk=(1.5, 4.0))
    assert [r[1] for r in by_id(quality.quality(df, tight), "kept")] == [False, False, True]


def test_sentencepiece_equals_the_library(spark, docs, empty):
    from sentencepiece import SentencePieceProcessor

    sp, rng = SentencePieceProcessor(model_file=PIECES), random.Random(1)
    odd = ["".join(rng.choice(["a", "b", " ", "  ", "▁", "\n", "\t", "é", "你", "ｆ", "the", "ing", "</s>", "aa"]) for _ in range(rng.randint(0, 30)))
           for _ in range(400)] + [" " * k + x for k in range(70) for x in ("", "你", "a")]
    df = docs.select("doc_id", "text", "ids", "decoded").union(
        spark.createDataFrame([(100 + i, t, "x", 0) for i, t in enumerate(odd)], "doc_id long, text string, ids string, decoded int"))
    out = pieces.decode(pieces.encode(df, PIECES), PIECES).collect()
    for r in out:
        want = sp.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == sp.decode(want)
    assert len(out) == df.count()
    assert pieces.encode(empty, PIECES).count() == 0


def test_decode_of_any_ids_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    sp, model, rng = SentencePieceProcessor(model_file=PIECES), pieces.load(PIECES), random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(3, 258), 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int64), np.array([len(ids)])) == [sp.decode(ids)]


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    base = prose(11, 200).split()
    rng, more = random.Random(3), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = prose(1000 + rng.randrange(10**6), 1)
        more.append((200 + i, " ".join(w), *CLASH))
    df = docs.union(spark.createDataFrame(more, docs.schema))
    # Small nodes and blocks, so that branching, blocks and the comparison across them all take part.
    got = by_id(neardup.near_duplicates(df, neardup.Join(small=4, block=8)), "n_shingles", "component_id", "kept")
    sets = {}
    for r in df.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"], r["text"]] = {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    named = [k for k in sets if k[0] is not None and sets[k]]
    smallest = {k: k[0] for k in named}
    for _ in range(len(named)):
        before = dict(smallest)
        for x in named:
            for y in named:
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    smallest[x] = min(smallest[x], smallest[y])
        if before == smallest:
            break
    want = []
    for r in df.collect():
        k = (r["doc_id"], r["text"])
        c = smallest.get(k, r["doc_id"])
        want.append((r["doc_id"], len(sets[k]), c, c == r["doc_id"]))
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 30)] + [(30, 29), (50, 51), (51, 50)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 31)} == {1} and got[51] == 50


def test_personal_data(spark, docs, empty):
    cases = {
        1: ("write a@b.example.org, not a@b", "email:6:21"), 2: ("at 1.2.3.4 and 256.1.1.1", "ip:3:10"),
        3: ("card 4041894974608795 or 4041894974608796", "card:5:21"), 4: ("é +1 (988) 555-2485.", "phone:2:19"),
        5: ("IBAN GB82 WEST 1234 5698 7654 32 here", "iban:5:32"), 6: ("IBAN GB82 WEST 1234 5698 7654 33 here", ""),
        7: ("ssn 123-45-6789", "ssn:4:15"), 8: ("part 123-45-6789", ""), 9: ("", ""), 10: (None, "")}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "555" not in red[13] and red[13].endswith("[PHONE] mail [EMAIL]") and pii.redact(docs).columns == docs.columns
    assert pii.digest(pii.find(empty)).count() == 0 and pii.find(docs).count() == docs.count()


def test_passages(spark, docs, empty):
    shared, near = prose(21, 51), prose(22, 80).split()
    changed = list(near)
    changed[40] = "other"
    rows = [(1, prose(31, 90) + " " + shared + " " + prose(32, 70)), (2, shared.upper() + " " + prose(33, 90)), (3, prose(34, 200)),
            (4, prose(35, 40) + " " + " ".join(near)), (5, " ".join(changed) + " " + prose(36, 45)),
            (6, " ".join(shared.split()[:30]) + " " + prose(37, 80)), (7, None), (8, "")]
    got = by_id(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")), "partner_id", "start_word", "end_word")
    assert [g for g in got if g[0] < 3] == [(1, 2, 90, 141), (2, 1, 0, 51)]
    assert {g[:2] for g in got} == {(1, 2), (2, 1), (4, 5), (5, 4)}
    pairs = {g[:2] for g in by_id(passages.passages(docs), "partner_id")}
    assert {(6, 7), (7, 6)} <= pairs and not any({0, 1, 9} & set(p) for p in pairs)
    assert passages.passages(empty).count() == 0


def test_anchors_are_the_minima_of_all_stretches():
    rng = np.random.default_rng(1)
    values, doc = rng.integers(0, 40, 300).astype(np.uint64), np.repeat([0, 1, 3], [120, 30, 150])
    want = set()
    for i in range(300 - 19):
        if doc[i] == doc[i + 19]:
            want.add(i + int(np.argmin(values[i:i + 20])))
    assert passages.anchors(values, doc, np.arange(300), 20).tolist() == sorted(want)


@pytest.mark.parametrize("block_patterns", [200_000, 40])
def test_decontamination_equals_brute_force(spark, docs, empty, block_patterns):
    window = " ".join(prose(1, 120).split()[10:25])
    items = spark.createDataFrame([(1, window), (2, "two, words!"), (3, None), (4, ""), (5, window), (12, "ENDE")], "item_id long, text string")
    got = by_id(decontam.decontaminate(docs, items, block_patterns=block_patterns), "n_words", "hits", "items")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = {}
    for r in items.collect():
        w = split(r["text"])
        for i in range(max(len(w) - 9, 1) if w else 0):
            found.setdefault(tuple(w[i:i + 10]), set()).add(str(r["item_id"]))
    want = []
    for r in docs.collect():
        w, hit, names = split(r["text"]), set(), set()
        for pattern, ids in found.items():
            for i in range(len(w) - len(pattern) + 1):
                if tuple(w[i:i + len(pattern)]) == pattern:
                    hit |= set(range(i, i + len(pattern)))
                    names |= ids
        want.append((r["doc_id"], len(w), len(hit), sorted(names)))
    assert [(g[0], g[1], sum(h["end"] - h["start"] for h in g[2]), g[3]) for g in got] == sorted(want, key=str)
    assert decontam.decontaminate(empty, items).count() == 0
    assert all(not r["hits"] for r in decontam.decontaminate(docs, items.limit(0)).collect())


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = scratch_path(spark, "token-test")
    manifest = tokens.write(docs, WORDS, path, file_ids=500, block=64)
    rows = tokens.read(manifest, path).orderBy("start").collect()
    library, at = Tokenizer.from_file(WORDS), 0
    source = {(r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()): r["text"] for r in docs.collect()}
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in docs.collect()], key=lambda d: -1 if d is None else d)
    texts = {d: t for (d, _), t in source.items()}
    for r in rows:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    nothing = scratch_path(spark, "token-empty")
    assert tokens.write(empty, WORDS, nothing).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000):
        for high in (1, 2, 49_408, 2**32 - 1):
            ids = rng.integers(0, high, n)
            ids[rng.random(n) < 0.05] = min(high, 2**31)
            head, doc_ids, sizes, back = tokens.parse(tokens.file_bytes("f" * 32, 3, 1, 7, [5, None], np.array([n // 2, n - n // 2]), ids, 64, 90))
            assert (back == ids).all() and doc_ids == [5, None] and head["before"] == 7


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(docs.where(~language.held_out(docs["doc_id"])))
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id")))
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "Der die das"), (5, "😀")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 5)] == ["und"] * 4 and got[4][0] == "de" and 0 <= got[4][1] <= 1
    nothing = language.predict(odd, language.learn(docs.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 30])
def test_codewords_differ(k):
    code = language.codewords(k)
    assert len({tuple(r) for r in code}) == k and all(0 < (c > 0).sum() < k for c in code.T)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(7)
    plain = [prose(5000 + i, 3).split()[0] for i in range(400)]
    rows, labels = [], []
    for i in range(1600):
        w, bad = [rng.choice(plain) for _ in range(60)], i % 4 == 1 and rng.random() < 0.8
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vilest", "rotter", "scoundrel"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    out = toxicity.score(docs, model).join(marks, "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, LONG)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in toxicity.score(odd, model).collect())
    flat_model = toxicity.learn(docs, marks.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs.limit(20), flat_model).collect()} == {0}


def test_html(spark):
    def page(i, extra=""):
        return (f"<html><body><header>Site</header><div class='topnav'><a href=x>Home</a></div><div id=cookie-notice>We use cookies</div>"
                f"<div class='post-body'><h2>Title {i}</h2><p>First &eacute; <b>{i}</b>\n para<p>Second {i}<ul><li>one<li>two {i}</ul>{extra}</div>"
                f"<div class=sidebar><p>Side {i}</p></div><section id=comments><article class=comment><p>Nice {i}!</p></article></section>"
                f"<script>var a='<p>x</p>'</script><form><p>Sign up</p></form><footer>&copy; {i}")

    bare = "<div>Acme News</div><div><h1>T{0}</h1><p>A{0} text</p></div><div>Copyright Acme</div>"
    rows = [(i, "https://a.example.org/p", page(i, "<blockquote>q</blockquote>" if i % 2 else "")) for i in range(6)]
    rows += [(10 + i, "http://b.example.org/p", bare.format(i)) for i in range(6)]
    rows += [(20, None, None), (21, "", ""), (22, "odd", "<div>" * 5000 + "deep"), (23, "https://a.example.org/q", "<article><p>Alone</p></article>"),
             (24, "x", "text & <b>bold</b>"), (24, "x", "text & <b>bold</b>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert got[1] == "Title 1\nFirst é 1 para\nSecond 1\none\ntwo 1\nq" and got[2] == "Title 2\nFirst é 2 para\nSecond 2\none\ntwo 2"
    assert got[12] == "T2\nA2 text"
    assert got[20] == "" and got[21] == "" and got[22] == "deep" and got[23] == "Alone" and got[24] == "text & bold"
    assert wrappers.extract(df).count() == len(rows) and wrappers.extract(df.limit(0)).count() == 0


def test_slices_keep_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "", "b" * 50, "c"], pa.string())})
    assert sum(s.num_rows for s in flat.slices(batch, most=12)) == 5


def passage_pairs(spark, rows):
    return by_id(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "partner_id", "start_word", "end_word")


def test_a_text_with_part_of_a_passage_hides_no_others(spark):
    rows, want = [], set()
    for k in range(40):
        shared, held = prose(7000 + k, 51).split(), 44 if k % 2 else 47
        low = (51 - held) // 2
        part = " ".join(shared[low:low + held])
        rows += [(10 * k, f"{prose(12000 + k, 60)} {part} {prose(12100 + k, 60)}" if k % 2 else part),
                 (10 * k + 2, prose(12200 + k, 60) + " " + " ".join(shared) + " " + prose(12300 + k, 20)), (10 * k + 3, " ".join(shared))]
        want |= {10 * k + 2, 10 * k + 3}
    assert {g[0] for g in passage_pairs(spark, rows)} == want


def test_every_place_of_a_passage_has_a_row(spark):
    shared = prose(7500, 55)
    twice = " ".join([prose(7501, 40), shared, prose(7502, 70), shared, prose(7503, 30)])
    for ids in ((1, 2), (2, 1)):
        got = passage_pairs(spark, [(ids[0], twice), (ids[1], shared + " " + prose(7504, 60))])
        assert sorted(g[2:] for g in got if g[0] == ids[0]) == [(40, 95), (165, 220)]
        assert [g[2:] for g in got if g[0] == ids[1]] == [(0, 55)]


def test_one_changed_word_loses_no_passage(spark):
    rng, rows = random.Random(9), []
    for k in range(120):
        one = prose(8000 + k, 50 + 10 * (k % 3)).split()
        other = list(one)
        other[len(one) // 2 - rng.randint(0, 1)] = "changed"
        rows += [(2 * k, prose(9000 + k, 40) + " " + " ".join(one)), (2 * k + 1, " ".join(other) + " " + prose(9500 + k, 30))]
    assert {g[:2] for g in passage_pairs(spark, rows)} == {(a, a ^ 1) for a in range(240)}


def test_a_text_with_the_key_only_hides_no_pair_that_differs_in_one_word(spark):
    rows, want = [], set()
    for k in range(40):
        one = prose(20_000 + k, 51).split()
        other, at = list(one), 10 + k * 30 // 39
        other[at] = "changed"
        # The first text holds the longer part of the passage up to its last words, and nothing of the other part.
        part = " ".join(one[at + 1:] if at < 25 else one[:at])
        rows += [(10 * k, f"{prose(21_000 + k, 60)} {part} {prose(21_100 + k, 60)}"), (10 * k + 2, prose(21_200 + k, 60) + " " + " ".join(one)),
                 (10 * k + 3, " ".join(other) + " " + prose(21_300 + k, 40))]
        want |= {(10 * k + 2, 10 * k + 3), (10 * k + 3, 10 * k + 2)}
    assert {g[:2] for g in passage_pairs(spark, rows)} == want


def test_default_bands_reject_noise_and_keep_prose(spark):
    rng, rows = random.Random(5), []
    kinds = ["0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/ ", "".join(map(chr, range(32, 127)))]
    for n in (1_000, 3_500, 4_000, 6_000, 12_000, 15_000):
        for kind in kinds:
            # A space at least every 18 characters, so that the base rule has its 50 words.
            noise = [rng.choice(kind) for _ in range(n)]
            noise[::18] = " " * len(noise[::18])
            rows.append((len(rows), "".join(noise)))
    bad = len(rows)
    rows += [(bad + k, prose(600 + k, n)) for k, n in enumerate((160, 600, 2_000))]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(not r["base_failed"] and r["kept"] == (r["doc_id"] >= bad) for r in got)


def test_last_part_of_a_text_is_a_chunk():
    import zstandard

    rng, bands = random.Random(6), quality.Bands()
    tail = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/ ") for _ in range(2_000))
    _, bad = quality.ratios(memoryview((prose(700, 1_000)[:2_048] + tail).encode()), bands, zstandard.ZstdCompressor(level=3))
    assert bad == 0.5


def test_shared_counts_have_no_ceiling(spark):
    words = [f"w{i}x" for i in range(2_000)]
    rows = [(" ".join(f"{w} common" for w in words[k::4]),) for k in range(4)] + [(f"common {words[0]} common",), (None,)]
    data = pa_texts(["common rare", "commo"])
    _, word, prefix, _ = toxicity.units(data)
    table = {"kind": np.array([1, 1, 0], np.int8), "key": np.array([word[0], word[1], prefix[0]], np.uint64).view(np.int64)}
    got = toxicity.shared_counts(spark.createDataFrame(rows, "text string").repartition(3), table)
    # 2,000 words stand before it, and a text begins with it.
    assert got[1, int(word[0])] == 2_001 and (1, int(word[1])) not in got and got[0, int(prefix[0])] == 1
    # After it 1,996 other words and the first of the last text; four texts begin with another word.
    want = {(a, b) for (t,) in rows if t for a, b in zip([None, *t.split()], t.split()) if b != "common"}
    assert got[1, 0] == len(want) and got[0, 0] == 2_000


def pa_texts(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_keys_are_ordered_by_text_and_place():
    rng = np.random.default_rng(5)
    key, doc, place = (rng.integers(0, n, 5000) for n in (3000, 4, 50))
    assert [(key[i], doc[i], place[i]) for i in passages.by_key(key, doc, place)] == sorted(zip(key, doc, place))
    assert passages.by_key(*np.zeros((3, 0), np.int64)).tolist() == []


def test_windows_are_linked_without_a_table_between(spark, docs, monkeypatch):
    names = []
    real = passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df, name: names.append(name) or real(df, name))
    first = spark.createDataFrame([(i, prose(40_000, 60) + f" end{i}") for i in range(6)], "doc_id long, text string").repartition(3)
    assert {g[0] for g in by_id(passages.passages(first), "partner_id")} == set(range(6))
    assert not {"windows", "stretches", "gapped-stretches"} & set(names)


def test_python_gets_small_batches_of_blocks(spark, docs, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real, before = neardup.materialize, spark.conf.get(name)
    monkeypatch.setattr(neardup, "materialize", lambda df, what: seen.append(spark.conf.get(name)) or real(df, what))
    rows = spark.createDataFrame([(i, prose(50_000 + i // 2, 60)) for i in range(8)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(rows).collect()}
    assert got == {(i, i - i % 2) for i in range(8)}
    assert set(seen) == {str(neardup.BATCH_BYTES)} and spark.conf.get(name) == before


def test_a_round_of_components_writes_two_tables(spark, monkeypatch):
    names = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: names.append(name) or real(df, name))
    edges = spark.createDataFrame([(1, 2), (3, 2), (2, 1), (9, 8), (8, 7), (3, 4)], "a long, b long")
    got = {(r["node"], r["component"]) for r in graph.components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}
    assert names[:2] == ["edges", "labels"] and set(zip(names[2::2], names[3::2])) == {("hooked", "labels")}


@pytest.mark.parametrize("columns", [1 << 15, 7])
def test_blocks_are_compared_on_the_shingles_both_hold(spark, monkeypatch, columns):
    monkeypatch.setattr(neardup, "COLUMNS", columns)
    join, base = neardup.Join(), prose(60_000, 80).split()
    texts = [" ".join(base), " ".join(base[:79] + ["other"]), " ".join(base[:40] + prose(60_001, 40).split()), prose(60_002, 50)]
    sets = [neardup.shingles(*flat.texts(neardup.pa.array([t])), join.words)[0] for t in texts]
    rows = [(i, i, int(np.add.reduce(s).view(np.int64)), t) for i, (t, s) in enumerate(zip(texts, sets))]
    width, zeros = [], np.zeros
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **k: width.append(shape) or zeros(shape, *a, **k))
    member = "array<struct<id long, c long, f long, text string>>"
    made = []

    class Frame:
        schema = spark.createDataFrame([], f"out {member}, all {member}").schema

        def mapInArrow(self, run, ddl):
            struct = neardup.pa.struct([(n, neardup.pa.string() if n == "text" else neardup.pa.int64()) for n in ("id", "c", "f", "text")])
            column = neardup.pa.array([[dict(zip(("id", "c", "f", "text"), r)) for r in rows]], neardup.pa.list_(struct))
            made.extend(run(iter([neardup.pa.RecordBatch.from_arrays([column, column], ["out", "all"])])))

    neardup.across(Frame(), join)
    assert {tuple(x.values()) for b in made for x in b.to_pylist()} == {(0, 1)}
    # No grid is wider than what both sides hold.
    assert max(s[1] for s in width if isinstance(s, tuple) and len(s) == 2) <= min(columns, len(np.unique(np.concatenate(sets))))


def test_python_gets_small_batches_of_windows(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real, before = passages.materialize, spark.conf.get(name)
    monkeypatch.setattr(passages, "materialize", lambda df, what: seen.append(spark.conf.get(name)) or real(df, what))
    # Keys that stay open, so that all steps take part.
    part, ends = prose(70_000, 40).split(), [prose(70_001 + i, 30).split() for i in range(2)]
    rows = [(1, " ".join(part))] + [(2 + i, " ".join([*ends[0], *part[:20], f"w{i}", *part[21:], *ends[1]])) for i in range(3)]
    out = passages.passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == {2, 3, 4}
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert set(seen) == {str(passages.BATCH_BYTES)} and spark.conf.get(name) == before
