import importlib

from tests_fixture import write_tables


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    write_tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0
    packed = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in packed}
    assert 0 in ids and 500 not in ids and 501 not in ids  # an exact and a short copy go
    assert not ids & {600, 601}  # toxic, symbols


def test_empty_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    write_tables(spark, tmp_path, rows=0)
    assert pipeline.run(spark, str(tmp_path)).count() == 0
