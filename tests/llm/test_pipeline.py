"""The pipeline against the same stages one after the other in plain form, and what it must keep and drop."""

from __future__ import annotations

from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_matching import brute
from weftline.llm import decontamination, language_id, near_duplicates, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_and_result(spark):
    docs, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in language_id.identify(docs, language_id.learn_languages(docs)).where("not rejected").collect()}
    left = docs.where(docs.doc_id.isin(*known))
    mild = {r.doc_id for r in toxicity.score_toxicity(left, toxicity.learn_stems(left, labels)).where("predicted = 0").collect()}
    left = docs.where(docs.doc_id.isin(*mild))
    single = {i for _, i, class_id, _ in brute([(i, texts[i]) for i in mild]) if i == class_id}
    assert single == {r.doc_id for r in near_duplicates.near_duplicates(left).where("doc_id = class_id").collect()}
    leaked = {r.doc_id for r in decontamination.find_leaks(docs, benchmark).collect()}
    want = single - leaked

    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.doc_id] += r.length
    assert set(lengths) == want
    assert all(n == len(library.encode(texts[i], add_special_tokens=False).ids) + 1 for i, n in lengths.items())
    assert len(known) >= 0.99 * len(texts) and len(single) < len(mild)


def test_stages_begin_with_collected_heaps(spark, odd_docs):
    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = odd_docs.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES:
        before = full_collections()
        stage(spark, docs, SF)
        assert full_collections() > before


def test_each_stage_returns_documents(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
