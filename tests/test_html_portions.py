import pyarrow as pa

from verbaloom.operators import html


def test_pages_are_taken_in_portions(monkeypatch):
    """A batch of many pages isn't held as rows at once; rows are the same."""
    monkeypatch.setattr(html, "PAGE_BYTES", 200)
    pages = [(i, None if i % 7 == 3 else f"<div class='mw-parser-output'><p>a {i}</p><h2>b</h2></div>") for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pages]), pa.array([h for _, h in pages], pa.string())], ["page_id", "html"])
    found = list(html.page_rows(iter([batch]), "ord int, tag string, block string", lambda h: [(i, *b) for i, b in enumerate(html.blocks(h))]))
    assert len(found) > 5 and max(b.num_rows for b in found) < 20
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert rows == [(i, k, *b) for i, h in pages for k, b in enumerate(html.blocks(h))]
