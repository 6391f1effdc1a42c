"""Tables, text and JSON files in; Parquet, text and JSON files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages in order with names, weights, and monolingual training sizes.
LANGUAGES = (("en", "English", 3, 9500), ("de", "German", 4, None), ("fr", "French", 4, None), ("es", "Spanish", 2, None))
DEFAULT_TRAIN_SIZE = 6000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{k}', '{n}', {w}, CAST({s or 'NULL'} AS INT))" for i, (k, n, w, s) in enumerate(LANGUAGES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, lang, name, weight, train_size)")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, newlines universal; path is any path Spark reads."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def first_available(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, tried in order."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def write_texts(docs: DataFrame, path: str) -> None:
    """Texts by language, one folder each."""
    docs.select("lang", "text").write.mode("overwrite").partitionBy("lang").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
