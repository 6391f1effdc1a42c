"""Ids above 2^53 in one batch with a null: every operator and stage gives them unchanged, and loses no document."""

import public_tokenizers
import pytest
from tests_fixture import write_tables

import corpus_pipeline
from verbaloom.llm import near_copies, op01_license, op02_quality, op03_sentencepiece, op05_lm, op06_packing, op07_simhash, op08_toxicity, op10_pii, op11_collocations, op12_sharding, op13_merkle

IDS = [2**53 + 1, 2**53 + 3, 2**62 + 1, 2**62 + 3, None, 7, 2**63 - 1]
WORDS = "river stone blue rock lorem ipsum general public license contact mail of the and".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(WORDS[(k * j + j) % len(WORDS)] for j in range(60)) + f" only{k}", "en", "a", 1) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


OPERATORS = {
    "license": lambda d: op01_license.license_scan(d),
    "quality": lambda d: op02_quality.quality(d),
    "sentencepiece": lambda d: op03_sentencepiece.sentencepiece_encode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "lm": lambda d: op05_lm.lm_score(d),
    "packing": lambda d: op06_packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).filter("start = 0"),
    "simhash": lambda d: op07_simhash.simhash_components(d),
    "toxicity": lambda d: op08_toxicity.toxicity(d, op08_toxicity.fit_on(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic", "1 quality"))),
    "pii": lambda d: op10_pii.with_spans(d),
    "sharding": lambda d: op12_sharding.deal(d),
    "merkle": lambda d: op13_merkle.manifest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_are_kept(docs, name):
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in OPERATORS[name](docs).collect()), key=key) == sorted(IDS, key=key)


def test_stages_keep_large_ids(spark, docs, tmp_path):
    write_tables(spark, tmp_path, 40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        if name != "quality":
            assert {r["doc_id"] for r in found.collect()} >= {i for i in IDS if i is not None}, name
        assert dict(found.dtypes) == dict(docs.dtypes)


def test_nullable_columns_ride_along(spark, docs, tmp_path):
    """Extra whole numbers with nulls pass the first stage unchanged."""
    write_tables(spark, tmp_path, 40)
    more = docs.selectExpr("*", "case when doc_id is null then null else doc_id - 1 end as own")
    found = corpus_pipeline.STAGES[0][1](spark, more, str(tmp_path)).collect()
    assert {r["own"] for r in found} == {None if i is None else i - 1 for i in IDS}


def test_near_copies_keep_ids(docs):
    assert {r["doc_id"] for r in near_copies.near_components(docs).collect()} == set(IDS)
    assert op11_collocations.collocations(docs).columns[0] == "lang"
