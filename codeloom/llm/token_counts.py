"""Token counts through a cache of content digests.

The cache is a Parquet table of (content digest, tokenizer digest, counts).
Texts are joined to it by both digests; of those it lacks, each distinct one is
encoded once and its counts are appended.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, stage, whole_texts
from codeloom.llm.encoder import WIDTH, encoder

CACHE = "content binary, tokenizer string, n_bytes long, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary is another version."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def read_cache(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A null text is the empty text, with 0 bytes. Repeated rows appear as often
    as they are there, a null ``doc_id`` stays null. An empty table gives no
    rows. Texts count as they are: any other normalisation would change them.
    """
    version = tokenizer_version(tokenizer)
    texts = whole_texts(docs).withColumn("content", F.unhex(F.sha2("text", 256)))
    keys = stage(texts.select("doc_id", "content"), "digests")
    known = read_cache(docs, cache).filter(F.col("tokenizer") == version)
    missing = texts.select("content", "text").join(known, "content", "left_anti")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(tokenizer).encode
        texts = [value.as_py() for value in batch[1]]
        counts = [len(ids(text)) // WIDTH for text in texts]
        sizes = [len(text.encode()) for text in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch[0],
                pa.array([version] * len(texts), pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(counts, pa.int64()),
            ],
            [c.split()[0] for c in CACHE.split(", ")],
        )

    misses = missing.dropDuplicates(["content"]).select("content", "text")
    map_texts(misses, encode, CACHE).write.mode("append").parquet(cache)
    # Two runs that append at once may store a text twice, with equal counts.
    stored = read_cache(docs, cache).filter(F.col("tokenizer") == version)
    counts = stored.groupBy("content").agg(
        F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens")
    )
    return keys.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
