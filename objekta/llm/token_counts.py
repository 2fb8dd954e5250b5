"""Token counts with a digest cache.

A text's count is stored under the digest of its normalised content (null becomes the empty text; nothing else is changed,
since any other change could change the count) and the digest of tokenizer and library version. Documents are joined to
the stored counts; only distinct texts without one are encoded, and their counts are appended to the cache.

Texts are thinned to one per digest on the map side, before they are shuffled; the join back to the documents carries
digests only, and Spark can split its hot keys.

Defined cases: null and empty texts have 0 bytes and the count of the empty text; repeated rows and rows with a null
doc_id each get a row; an empty table gives no rows; long texts are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objekta.llm import tokenizer_files
from objekta.llm.common import cut, fresh_path, table

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Bytes of text encoded in one call at most (one longer text is a call of its own).
STEP_BYTES = 1 << 20

_loaded: dict[str, object] = {}


def _encoder(path: str):
    """Counts of some texts. A worker loads a tokenizer once."""
    if path not in _loaded:
        _loaded[path] = tokenizer_files.load(path)
    library = _loaded[path]
    if path.endswith(".json"):
        return lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    return lambda texts: [len(x) for x in library.encode(texts, out_type=int, num_threads=1)]


def _steps(texts: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for text, n in zip(texts, pc.binary_length(texts).to_pylist(), strict=True):
        if part and size + n > STEP_BYTES:
            yield part
            part, size = [], 0
        part.append(text.as_py())
        size += n
    if part:
        yield part


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [n for part in _steps(batch.column(1)) for n in _encoder(path)(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def _cached(spark, cache_path: str, version: str) -> DataFrame:
    """digest and n_tokens of this version; no rows where there is no cache yet."""
    schema = "digest binary, n_tokens long, version string"
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).select("digest", "n_tokens")
    return spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")


def token_counts(documents: DataFrame, tokenizer_path: str, cache_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Appends what it had to encode to the cache."""
    spark = documents.sparkSession
    version = tokenizer_files.version(tokenizer_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    docs = documents.select(F.col("doc_id").cast("long"), text.alias("text"), digest.alias("digest"))
    distinct = docs.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(_cached(spark, cache_path, version), "digest", "left_anti").select("digest", "text")
    counted = misses.mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens long")
    counted.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    # Two writers at once may both have stored a digest; the counts are then the same.
    counts = cut(_cached(spark, cache_path, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """A cache of its own: every distinct text of the table is encoded once."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_files.public_path(VOCABULARY), fresh_path(spark, "token-cache"))
