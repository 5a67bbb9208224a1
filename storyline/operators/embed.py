"""Vectors for articles through a provider that is chosen by name."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions.text import embedding_text
from storyline.schema import ISSUE
from storyline.session import materialize

# Fixed value: texts per provider call.
BATCH_SIZE = 50
HASH_DIMENSIONS = 256

#: A provider maps texts to vectors, in order.
Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]

_FACTORIES: dict[str, Callable[[], Provider]] = {}


def register_provider(name: str, factory: Callable[[], Provider]) -> None:
    """Make a provider known; the factory is called once per task, so it may open a client."""
    _FACTORIES[name.lower()] = factory


def provider_factory(name: str) -> Callable[[], Provider]:
    if name.lower() not in _FACTORIES:
        raise ValueError(f"unknown embedding provider: {name}")
    return _FACTORIES[name.lower()]


def with_embedding_text(articles: DataFrame) -> DataFrame:
    return articles.withColumn("embedding_text", embedding_text(F.col("title"), F.col("description")))


def embed(articles: DataFrame, provider: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add ``embedding_text, embedding, provider``.

    Every task makes its own provider and sends ``batch_size`` texts per call; a failing call fails the task, which
    Spark runs again, so a provider must give the same vector for the same text. The result is written, so that whatever reads
    it, and however often, no text is sent twice. Rows of an issue come together first, so that a table by issue gets few files.
    """
    factory = provider_factory(provider)
    issue = [F.col(c) for c in ISSUE if c in articles.columns]
    texts = with_embedding_text(articles.hint("rebalance", *issue) if issue else articles)
    schema = T.StructType(texts.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()
        for batch in batches:
            # A call's rows are passed on before the next call; only its texts become Python objects.
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                answer = list(call(part["embedding_text"].to_pylist()))
                if len(answer) != part.num_rows:
                    raise ValueError("the provider returned another number of vectors than texts")
                vectors = pa.array(answer, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

    return materialize(texts.mapInArrow(run, schema).withColumn("provider", F.lit(provider.lower())), "embedded")


def word_buckets(text: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """The bucket of each word of the text in lower case: the checksum of the word, modulo the number of buckets."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dimensions)).cast("string"))


def _bucket_counts(articles: DataFrame, dimensions: int) -> DataFrame:
    """Articles with ``_counts``, how often each bucket occurs in the embedding text."""
    texts = with_embedding_text(articles).withColumn("_buckets", word_buckets(F.col("embedding_text"), dimensions))
    model = CountVectorizerModel.from_vocabulary([str(k) for k in range(dimensions)], inputCol="_buckets", outputCol="_counts")
    return model.transform(texts).drop("_buckets")


def _document_counts(counted: DataFrame) -> DataFrame:
    sums = counted.agg(vector_to_array(Summarizer.numNonZeros(F.col("_counts"))).alias("found"), F.count("*").alias("all"))
    return sums.select(F.posexplode(F.concat(F.array(F.col("all").cast("double")), "found")).alias("bucket", "texts")).select(
        (F.col("bucket") - 1).alias("bucket"), F.col("texts").cast("bigint").alias("texts")
    )


def document_counts(articles: DataFrame, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """``bucket, texts``: in how many texts each bucket occurs; bucket -1 has the number of texts.

    Such tables of different batches add up (:func:`merge_counts`), so one can be kept and given to later runs, which then weigh words
    alike. It has one row per bucket whatever the number of texts.
    """
    return _document_counts(_bucket_counts(articles, dimensions))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The document counts of several batches together."""
    return reduce(DataFrame.unionByName, counts).groupBy("bucket").agg(F.sum("texts").alias("texts"))


def bucket_weights(counts: DataFrame, dimensions: int = HASH_DIMENSIONS) -> list[float]:
    """``log((texts + 1) / (texts with the bucket + 1))`` of each bucket. The table has a row per bucket, so the driver may take it."""
    found = {r["bucket"]: r["texts"] for r in counts.collect()}
    return [math.log((found.get(-1, 0) + 1) / (found.get(k, 0) + 1)) for k in range(dimensions)]


def embed_hashing(articles: DataFrame, dimensions: int = HASH_DIMENSIONS, counts: DataFrame | None = None) -> DataFrame:
    """Offline vectors: hashed words weighted by rarity, unit length. All inside the JVM.

    The weights come from ``counts`` (:func:`document_counts`), or from the articles at hand. The text they are made from is not written with
    the counts; it is put together again where it is read.
    """
    columns = with_embedding_text(articles).columns
    counted = _bucket_counts(articles, dimensions)
    if counts is None:
        # Texts are split once; the pass over all rows that weighs the words reads only their counts.
        counted = with_embedding_text(materialize(counted.drop("embedding_text"), "counted"))
        counts = _document_counts(counted.select("_counts"))
    scale = ElementwiseProduct(scalingVec=Vectors.dense(bucket_weights(counts, dimensions)), inputCol="_counts", outputCol="_weights")
    unit = Normalizer(inputCol="_weights", outputCol="_unit").transform(scale.transform(counted))
    made = unit.withColumn("embedding", vector_to_array("_unit", "float32")).withColumn("provider", F.lit("hashing"))
    return made.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "embedding", "provider"])])


def hashing_provider(weights: Sequence[float]) -> Callable[[], Provider]:
    """A factory for :func:`register_provider` that gives the vectors of :func:`embed_hashing` with these weights.

    Python's ``\\W`` knows other letters than the JVM's in scripts with combining marks, where words may be cut elsewhere.
    """
    kept = list(weights)

    def call(texts: Sequence[str]) -> list[list[float]]:
        made = []
        for text in texts:
            vector = [0.0] * len(kept)
            for word in re.split(r"\W+", text.lower()):
                if word:
                    bucket = zlib.crc32(word.encode()) % len(kept)
                    vector[bucket] += kept[bucket]
            length = math.sqrt(sum(x * x for x in vector)) or 1.0
            made.append([x / length for x in vector])
        return made

    return lambda: call


#: The offline provider by name, all words alike; register it again with kept weights.
register_provider("hashing", hashing_provider([1.0] * HASH_DIMENSIONS))
