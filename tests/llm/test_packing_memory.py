import time
import tracemalloc

import public_tokenizers
import pyarrow as pa

from verbaloom.llm import common, op06_packing


def test_a_chunk_is_laid_out_in_few_bytes_a_token():
    encoder = op06_packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["the of and to " * 50_000])
    encoder.encode(texts.slice(0, 0))
    tracemalloc.start()
    ids, at = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at.tolist() == [0, 200_000] and ids.tolist() == [encoder.lib.encode(w).ids[0] for w in "the of and to".split()] * 50_000
    assert peak < 36 * len(ids)


def test_pieces_are_made_of_small_batches(spark, monkeypatch):
    """A batch is what is encoded at once, not ten thousand texts; the setting is restored."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, write = spark.conf.get(key), common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag: (seen.update({tag: spark.conf.get(key)}), write(df, tag))[1])
    docs = spark.createDataFrame([(i, "a b") for i in range(5)], "doc_id long, text string")
    assert op06_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 5
    assert int(seen["pieces"]) == op06_packing.CHUNK and spark.conf.get(key) == before


def test_words_are_dropped_when_no_task_comes(monkeypatch):
    """Tasks that follow each other share an encoder; later stages of a worker don't carry its words."""
    monkeypatch.setattr(op06_packing, "IDLE_SECONDS", 0.3)
    path = public_tokenizers.path("word_bpe_49k.json")
    with op06_packing.encoder(path) as first:
        time.sleep(0.5)
    with op06_packing.encoder(path) as second:
        assert second is first
        time.sleep(0.5)
        assert path in op06_packing._ENCODERS
    time.sleep(0.6)
    assert path not in op06_packing._ENCODERS
