"""The pipeline on the small tables against plain code, stage by stage."""

import re

import corpus_pipeline
import public_tokenizers
from marketlake.llm import pii, quality
from marketlake.session import materialize


def test_every_stage(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-test")
        kept[name] = docs.collect()
        assert name == "token_ids" or docs.columns == columns
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in kept["quality_rules"]} == good

    def shingles(t, n=5):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))}

    sets = {d: shingles(source[d]) for d in good}
    left = {r["doc_id"] for r in kept["near_dedup"]}
    alike = {(x, y) for x in good for y in good if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert not any(x in left and y in left for x, y in alike)
    assert all(d in left or any(d == y for _, y in alike) for d in good)
    windows = set()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()

    def clean(t):
        w = words(t)
        return not any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert {r["doc_id"] for r in kept["benchmark_decontamination"]} == {d for d in left if clean(source[d])}
    assert all(not r["spans"] for r in pii.find(spark.createDataFrame(kept["personal_data"])).collect())
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in kept["personal_data"]}
    assert all(r["ids"] == sp.encode(text[r["doc_id"]]) and r["round_trip"] for r in kept["token_ids"])
    assert len(kept["token_ids"]) == len(kept["personal_data"])


def test_an_empty_table_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_token_ids_need_one_worker_a_task_and_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real, before = corpus_pipeline.materialize, spark.conf.get(name)

    def write(df, what):
        seen.append((spark.conf.get(name), df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")))
        return real(df, what)

    monkeypatch.setattr(corpus_pipeline, "materialize", write)
    docs = spark.createDataFrame([(1, "two words", "en", "x"), (2, None, "en", "x")], "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r)[0:1] + (r["round_trip"],) for r in corpus_pipeline.token_ids(spark, docs, "").collect()) == [(1, True), (2, True)]
    assert seen == [(str(corpus_pipeline.BATCH_BYTES), 1)] and spark.conf.get(name) == before
