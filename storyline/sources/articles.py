"""Article and embedding tables, partitioned by issue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.schema import ARTICLE_DEFAULTS, ARTICLES, ISSUE


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles with the fixed schema; a text column that is missing or null reads as ""."""
    return with_defaults(spark.read.schema(ARTICLES).parquet(path))


def with_defaults(articles: DataFrame) -> DataFrame:
    have = set(articles.columns)
    return articles.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("") for c in ARTICLE_DEFAULTS}
    )


def write_articles(articles: DataFrame, path: str) -> None:
    """Write issues, replacing only those in the batch; an empty batch changes nothing.

    Rows are gathered by issue, and adaptive execution splits a large issue into several even files.
    """
    spread = articles.hint("rebalance", *[F.col(c) for c in ISSUE])
    spread.write.partitionBy(*ISSUE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def new_issues(incoming: DataFrame, stored: DataFrame, force_refresh: bool = False) -> DataFrame:
    """Rows of issues that are not stored yet; all rows when forced."""
    if force_refresh:
        return incoming
    return incoming.join(stored.select(*ISSUE).distinct(), ISSUE, "left_anti")


def refresh(incoming: DataFrame, stored: DataFrame, force_refresh: bool = False) -> DataFrame:
    """The issues after a run: stored ones are reused, missing (or all, when forced) come from the batch."""
    fresh = new_issues(incoming, stored, force_refresh)
    kept = new_issues(stored, incoming) if force_refresh else stored
    return kept.unionByName(fresh)


def read_embeddings(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Embedded articles of one provider, named in any case; the provider and issue folders are pruned."""
    schema = T.StructType(
        ARTICLES.fields
        + [
            T.StructField("embedding_text", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("provider", T.StringType()),
        ]
    )
    return spark.read.schema(schema).parquet(path).filter(F.col("provider") == provider.lower())


def write_embeddings(embedded: DataFrame, path: str) -> None:
    """Add embedded articles; providers stand in folders of their own.

    ``embed`` has brought the rows of an issue together, so they are written where they are.
    """
    embedded.sortWithinPartitions("provider", *ISSUE).write.partitionBy("provider", *ISSUE).mode("append").parquet(path)


def not_embedded(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Articles that have no stored vector yet; ``stored`` is read for its keys only."""
    return articles.join(stored.select(*ISSUE, "seq"), [*ISSUE, "seq"], "left_anti")


def attach_embeddings(articles: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """Every article beside its vector, matched by key; the vector of an article that has none is null.

    ``vectors`` has one row per key. :func:`without_embedding` counts the articles that were not matched.
    """
    return articles.join(vectors, on, "left")


def without_embedding(attached: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: articles, and how many of them have no vector."""
    return attached.groupBy(*groups).agg(F.count("*").alias("articles"), F.count_if(F.col("embedding").isNull()).alias("without_vector"))
