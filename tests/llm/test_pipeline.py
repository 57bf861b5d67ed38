"""The pipeline, stage by stage on its own input."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from test_decontaminate import brute as contaminated
from test_jaccard import brute as classes
from test_secret_scan import brute as secrets

import corpus_pipeline
from communitylens.llm.store import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_drops_what_it_predicts(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.9 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_one_of_each_class_stays(stages):
    want = {d for d, _, c in classes(texts(stages[1]), 5, 80) if d == c}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_benchmark_passages_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in stages[3].collect()} == {r[0] for r in contaminated(texts(stages[2]), items) if not r[5]}


def test_secrets_are_replaced(stages):
    before, after = dict(texts(stages[3])), {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for doc, text in before.items():
        assert (after[doc].text != text) == bool(secrets([(doc, text)])[0][5])
        assert not secrets([(doc, after[doc].text)])[0][5]
        assert after[doc].n_chars == len(after[doc].text)


def test_encoding(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in stages[5].collect()}
    for doc, text in texts(stages[4]):
        assert rows[doc].ids == library.encode(text, add_eos=True) and rows[doc].decoded == text


def test_run_gives_the_last_stage(spark, stages):
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.ids) for r in stages[5].collect())
