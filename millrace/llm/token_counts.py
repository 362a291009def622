"""Token counts through a digest cache.

Every text is reduced to the SHA-256 of its content and the tokenizer file to the SHA-256 of its
bytes. Counts are stored in a Parquet cache under (tokenizer digest, text digest); only digests that
the cache lacks are encoded, once each, and appended. Texts move once, dealt by digest, after each
task has dropped its own repeats; so a text that makes up a third of all rows reaches its owner a
few times, not millions of times. Counts come back to the documents in a join of digests only, a
plain sort-merge join whose hot digests adaptive execution splits.

Nulls count as empty texts (no tokens). Repeated rows stay rows. A null ``doc_id`` is carried
along. An empty table gives an empty result and leaves the cache as it was. Other columns of the
input are ignored, so their names can't clash."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

CACHE = "digest binary, n_tokens long, tokenizer string"
MISSES = "digest binary, n_tokens long"

_tokenizers: dict = {}


def load(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, as a function from texts to counts."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _tokenizers[path] = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            p = SentencePieceProcessor(model_file=path)
            _tokenizers[path] = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    return _tokenizers[path]


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops what the task has met before. It remembers 32 bytes a distinct text."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64())) if len(new) < batch.num_rows else batch


def _encoder(path: str, step: int = 1 << 20):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(path)
        for batch in _first_seen(batches):
            digests, texts = batch.column(0), batch.column(1)
            counts: list[int] = []
            some: list[str] = []
            size = 0
            for t in texts:  # in steps, so that no more than about a megabyte of text is encoded at a time
                some.append(t.as_py())
                size += len(some[-1])
                if size >= step:
                    counts += count(some)
                    some, size = [], 0
            counts += count(some) if some else []
            yield pa.RecordBatch.from_arrays([digests, pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the id, n_bytes and n_tokens; fills the cache at ``cache_path``.

    ``tokenizer_path`` must be readable on the driver and executors alike."""
    spark = docs.sparkSession
    common.ship(spark)
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_column), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    # Written, as it is used twice and each use would hash all texts again.
    keys = common.written(docs.select(F.col(id_column), digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")

    def cache() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).drop("tokenizer")

    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache_path)
    texts = docs.select(digest, text.alias("text")).mapInArrow(_first_seen, "digest binary, text string").repartition("digest")
    misses = texts.join(cache().select("digest"), "digest", "left_anti").mapInArrow(_encoder(tokenizer_path), MISSES)
    misses.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_path)
    # Two runs at a time may both have appended a digest: one row of each is used.
    found = cache().join(keys.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(common.written(found, "counts"), "digest").select(id_column, "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Counts by byte_bpe_50k.json. The cache starts empty each time, so that a run shows the whole work."""
    import public_tokenizers

    cache = common.scratch_path(spark, "token-cache")
    counts = token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
