"""The two-generation memo of the encoders."""

from __future__ import annotations

from verbaloom.llm import common, op06_packing


def test_what_recurs_stays_and_size_is_bounded():
    memo, asked = common.Remembered(10), []
    for step in range(50):
        keys = ["often", f"once-{step}", f"once-{step}-more"]
        fresh = memo.missing(keys)
        asked += fresh
        memo.new.update((k, k.upper()) for k in fresh)
        assert [memo.new[k] for k in keys] == [k.upper() for k in keys]
        assert len(memo.new) + len(memo.old) <= 20 + len(keys)
    assert asked.count("often") == 1 and len(asked) == 101


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "One word, then One.", "a b c d e f g", "word, word. İstanbul x<|y", "b a", "e.\n\nf,g  h", "one word"]
    plain = op06_packing.WordIds(path).encode(pa.array(texts))
    for generation in (1, 3, 8):
        monkeypatch.setattr(op06_packing, "GENERATION", generation)
        few = op06_packing.WordIds(path)
        got = [few.encode(pa.array([t], pa.string()))[0].tolist() for t in texts]
        assert [i for ids in got for i in ids] == plain[0].tolist()
        want = [few.lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert got == want
