"""Pieces and characters of texts in Arrow: what text.pieces and text.metaspace give, for many texts at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import MARK

#: Bytes of text that are cut at once.
PORTION = 1 << 24
_MARK = tuple(MARK.encode())


def portions(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes in its last column, a text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def of_each(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[object, pa.Array]]:
    """Each key with its texts; null is a key of its own."""
    coded = keys.dictionary_encode("encode")
    for k, key in enumerate(coded.dictionary.to_pylist()):
        yield key, texts.filter(pc.equal(coded.indices, k))


def white_space(texts: pa.Array) -> pa.Array:
    """White space pieces of each text; ones before and after white space at its ends are empty."""
    return pc.utf8_split_whitespace(texts)


def metaspace(texts: pa.Array, lines: bool = False) -> pa.Array:
    """Pieces that start at each space mark, and behind each newline if lines."""
    marked = pc.replace_substring(pc.fill_null(texts, "").cast(pa.string()), " ", MARK)
    ends = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[: ends[-1]]
    hit = np.zeros(len(data) + 1, bool)  # where a piece begins
    if len(data) > 2:
        hit[: len(data) - 2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
    if lines:
        hit[1:] |= data == 10
    hit[: ends[0]] = False
    hit[ends[:-1][ends[1:] > ends[:-1]]] = True
    hit[-1] = False
    begins = np.flatnonzero(hit)
    values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, ends[-1]].astype(np.int32)), marked.buffers()[2] or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, ends).astype(np.int32)), values)


def lines_metaspace(texts: pa.Array) -> pa.Array:
    return metaspace(texts, True)


def _bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 of all texts."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def nfc(values: pa.Array) -> pa.Array:
    """Characters below U+0300, whose bytes are below 0xCC, are in NFC already."""
    if _bytes(values).max(initial=0) < 0xCC:
        return values
    odd = pc.fill_null(pc.match_substring_regex(values, r"[^\x00-\x{2ff}]"), False)
    if not pc.any(odd).as_py():
        return values
    return pc.replace_with_mask(values, odd, pa.array([unicodedata.normalize("NFC", x) for x in values.filter(odd).to_pylist()], values.type))


def characters(texts: pa.Array) -> list[str]:
    """Distinct characters."""
    data = _bytes(texts)
    seen = np.flatnonzero(np.bincount(data, minlength=128)[:128])
    # bytes beyond ASCII stand together, so without the others they are text too
    return [chr(c) for c in seen.tolist()] + sorted(set(data[data >= 128].tobytes().decode()))
