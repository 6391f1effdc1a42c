"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda (heap) of adjacent symbol pairs whose concatenation is a piece,
ordered by piece score, then by position; unknown symbols fall back to byte pieces. No piece of
the vocabulary holds the space mark behind another character (checked on load), so merges never
cross such a border and texts are encoded by segment; segments repeat, so each worker keeps a
bounded table of those it has encoded. Every segment that enters the table is checked, an Arrow
batch at a time, against the sentencepiece library; a difference raises.

Null text counts as empty: no ids, and the hash of the empty string. Rows are independent:
repeated rows repeat their result, an empty table gives an empty one, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Segments a worker remembers in each of two generations (some 350 bytes each), and the longest that it does.
GENERATION, TABLE_CHARS = 600_000, 48


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.lib.get_piece_size()
        self.pieces = [self.lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if self.lib.is_control(i) or self.lib.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.silent and i not in self.byte_of}
        self.score = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.memo = common.Remembered(GENERATION)

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge by an agenda that lists the score of each adjacent pair in place: the best is its
        first maximum. For segments of usual length."""
        get, none = self.score.get, float("-inf")
        agenda = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) > none:
            i = agenda.index(best)
            symbols[i] = new = symbols[i] + symbols.pop(i + 1)
            agenda.pop(i)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + new, none)
            if i < len(agenda):
                agenda[i] = get(new + symbols[i + 1], none)
        return symbols

    def merged_long(self, symbols: list[str | None]) -> list[str]:
        """The same with the agenda as a heap, in n log n for segments of any length."""
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        score, agenda = self.score, []
        for i in range(len(symbols) - 1):
            if (pair := symbols[i] + symbols[i + 1]) in score:
                agenda.append((-score[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (new := pair + symbols[k]) in score:
                    heapq.heappush(agenda, (-score[new], i, k, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in score:
                heapq.heappush(agenda, (-score[new], h, i, new))
        return [s for s in symbols if s is not None]

    def encode_segment(self, segment: str) -> list[int]:
        ids, out = self.ids, []
        for s in (self.merged if len(segment) <= TABLE_CHARS else self.merged_long)(list(segment)):
            if s in ids:
                out.append(ids[s])
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def decode_ids(self, ids: list[int], strip: bool = True) -> str:
        """Pieces joined, bytes reassembled (malformed ones become U+FFFD each), marks to spaces;
        one leading space, the encoder's own, is dropped."""
        parts, run = [], bytearray()
        if self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            text = "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
            return text[1:] if strip and text.startswith(" ") else text
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(_utf8(run))
                run = bytearray()
            parts.append("" if i in self.silent else self.pieces[i].replace(MARK, " "))
        if run:
            parts.append(_utf8(run))
        text = "".join(parts)
        return text[1:] if strip and text.startswith(" ") else text

    def segments(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.crossing else _SEGMENT.findall(marked)

    def learn(self, segments: set[str]) -> dict[str, tuple[str, int, str]]:
        """Encode segments by the agenda and hold them against the library in one batch."""
        todo = list(segments)
        expected = self.lib.encode([s[1:].replace(MARK, " ") for s in todo], num_threads=1) if todo else []
        out = {}
        for s, want in zip(todo, expected, strict=True):
            if s == MARK:  # the library gives an empty text no prefix, so it can't be asked
                want = [self.lib.piece_to_id(MARK)]
            if (got := self.encode_segment(s)) != want:
                raise ValueError(f"agenda and library differ on {s!r}: {got} and {want}")
            out[s] = (",".join(map(str, got)), len(got), self.decode_ids(got, strip=False))
        return out


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def sentencepiece_encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (decimal, comma-joined), n_tokens, decoded, and SHA-256 of ids and decoded text.
    with_ids=False leaves the two texts out of the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                texts = [m.segments(t) if t else [] for t in part["text"]]
                fresh = m.memo.missing(set().union(*texts))
                table = m.memo.new
                table.update(m.learn(fresh))
                rows = []
                for segs in texts:
                    found = [table[s] for s in segs]
                    ids = ",".join([e[0] for e in found])
                    text = "".join([e[2] for e in found])
                    text = text[1:] if text.startswith(" ") else text
                    rows.append((ids, sum([e[1] for e in found]), text, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                for s in fresh:
                    if len(s) > TABLE_CHARS:
                        del table[s]
                out = pd.DataFrame(rows, columns=["ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"])
                yield out if with_ids else out.drop(columns=["ids", "decoded"])

    texts = "" if not with_ids else "ids string, "
    decoded = "" if not with_ids else "decoded string, "
    return common.beside(docs, ["doc_id"], ["text"], run, f"{texts}n_tokens long, {decoded}ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return sentencepiece_encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
