"""Incremental word counts over a stream of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verbaloom.functions import text as T

#: Keys that a language's words are dealt to, and the words of each that its state gives.
BUCKETS, TOP = 64, 30
_WORD, _COUNT = "token string", "n long, first_doc long, first_pos int"
TOPS = f"lang string, bucket int, {_WORD}, {_COUNT}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def word_counts(docs: DataFrame) -> DataFrame:
    """Running (lang, piece, n) of a streaming documents frame; write in update or complete mode."""
    pieces = F.explode(T.pieces(T.collapse(F.col("text"))))
    return docs.select("lang", pieces.alias("piece")).groupBy("lang", "piece").agg(F.count("*").alias("n"))


class _TopWords(StatefulProcessor):
    """State of a key: each word's number and first place, on disk; given: the first TOP words of the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", _WORD, _COUNT)
        self.top = handle.getValueState("top", "words array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Only words of the batch and those given before can be among the first."""
        fresh: dict[str, tuple[int, int, int]] = {}
        for batch in rows:
            for token, doc, pos in zip(batch["token"].tolist(), batch["doc_id"].tolist(), batch["pos"].tolist(), strict=True):
                n, *at = fresh.get(token, (0, doc, pos))
                fresh[token] = (n + 1, *min(tuple(at), (doc, pos)))
        for token, (n, *at) in fresh.items():
            if self.counts.containsKey((token,)):
                known, *first = self.counts.getValue((token,))
                n, at = n + known, min(tuple(at), tuple(first))
            self.counts.updateValue((token,), (int(n), int(at[0]), int(at[1])))
        near = {*fresh, *(self.top.get()[0] if self.top.exists() else ())}
        found = sorted(((*self.counts.getValue((t,)), t) for t in near), key=lambda r: (-r[0], r[1], r[2]))[:TOP]
        self.top.update(([r[3] for r in found],))
        lang, bucket = key
        yield pd.DataFrame([(lang, bucket, t, n, doc, pos) for n, doc, pos, t in found], columns=["lang", "bucket", "token", "n", "first_doc", "first_pos"])

    def close(self) -> None:
        pass


def top_words(docs: DataFrame) -> DataFrame:
    """For each batch of a streaming documents frame (doc_id not null) the keys (lang, bucket) that it touches with
    their first words, counted over all batches so far. Texts are normalized in full, NFC included. Needs the RocksDB
    state store; write in update mode (see `keep`)."""
    texts = docs.select("lang", "doc_id", T.collapse(T.nfc(F.col("text"))).alias("text"))
    rows = texts.select("lang", "doc_id", F.posexplode(T.pieces(F.col("text"))).alias("pos", "token"))
    keyed = rows.select("lang", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket"), "doc_id", "pos", "token")
    return keyed.groupBy("lang", "bucket").transformWithStateInPandas(_TopWords(), TOPS, "Update", "None")


def keep(tops: DataFrame, path: str, checkpoint: str):
    """A writer of top_words' rows: a folder for each batch, written anew when a batch is repeated after a failure."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return tops.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def current_top(spark: SparkSession, path: str, k: int = TOP) -> DataFrame:
    """lang, rank, token, n as of the last batch: the last version of each key, then the first k of a language's keys
    (at most BUCKETS * TOP rows)."""
    rows = spark.read.schema(f"{TOPS}, version long").parquet(path)
    last = rows.groupBy(F.col("lang").alias("l"), F.col("bucket").alias("b")).agg(F.max("version").alias("v"))
    rows = rows.join(last, F.col("lang").eqNullSafe(F.col("l")) & (F.col("bucket") == F.col("b")) & (F.col("version") == F.col("v")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "first_doc", "first_pos")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("lang", "rank", "token", "n")
