"""Table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from verbaloom.functions.text import MARK
from verbaloom.operators.bpe import Encoder, encoded_rows

_PIECE = re.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


def register_tokenize(spark: SparkSession, merges: dict[str, list[tuple[str, str]]], name: str = "tokenize", lang: str = "*") -> None:
    """SELECT ... FROM documents, LATERAL tokenize(text): rows (at, tokens), the tokens of each piece of a text in
    order, with the merges of `lang`. A null text has no rows. The merges, at most a vocabulary, travel with the function."""
    own = {lang: merges.get(lang, [])}

    class Tokenize:
        def __init__(self):
            self.encode = Encoder(own, None, "<unk>")

        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError(f"{name}() takes a string, not {text.dataType.simpleString()}")
            return AnalyzeResult(StructType().add("at", IntegerType()).add("tokens", ArrayType(StringType())))

        def eval(self, text: str) -> Iterator[tuple[int, list[str]]]:
            pieces = [] if text is None else _PIECE.findall(text.replace(" ", MARK))
            yield from enumerate(self.encode(lang, pieces))

    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Tokenize))


def register_tokenize_table(spark: SparkSession, merges: dict[str, list[tuple[str, str]]], name: str = "tokenize_table") -> None:
    """SELECT ... FROM tokenize_table(TABLE(SELECT doc_id, lang, pieces FROM documents)): rows (doc_id, lang, at, tokens)
    of whole Arrow batches, which a lateral function can't have; for streams of any size."""
    from pyspark.sql.functions import arrow_udtf

    class TokenizeTable:
        def __init__(self):
            self.encode = Encoder(merges, None, "<unk>")

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for rows in encoded_rows(self.encode, iter([batch])):
                yield pa.Table.from_batches([rows])

    spark.udtf.register(name, arrow_udtf(TokenizeTable, returnType="doc_id long, lang string, at int, tokens array<string>"))
