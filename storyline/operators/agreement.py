"""How far two label sets agree: contingency, indexes, splits and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.operators.ordering import first_rows

# Rows of a report.
REPORT_ROWS = 5
SAMPLE_TITLES = 3
TITLE_LENGTH = 80


def contingency(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Articles per pair of labels: ``label_a, label_b, n``. Inputs hold ``on`` and ``label``."""
    left = a.select(*on, F.col("label").alias("label_a"))
    right = b.select(*on, F.col("label").alias("label_b"))
    return left.join(right, on).groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def _margins(cells: DataFrame) -> DataFrame:
    """Cells, rows, columns and total in one pass; ``level`` tells which: 0 cell, 1 row, 2 column, 3 total."""
    return cells.cube("label_a", "label_b").agg(F.sum("n").cast("double").alias("c"), F.grouping_id().alias("level"))


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index from contingency counts."""
    pairs = F.col("c") * (F.col("c") - 1) / 2
    sums = _margins(cells).agg(*[F.sum(F.when(F.col("level") == i, pairs)).alias(n) for i, n in enumerate(["both", "a", "b", "total"])])
    expected = F.col("a") * F.col("b") / F.col("total")
    bound = (F.col("a") + F.col("b")) / 2
    return sums.select(
        F.when((F.col("total") == 0) | (bound == expected), F.lit(1.0))
        .otherwise((F.col("both") - expected) / (bound - expected))
        .alias("adjusted_rand")
    )


def nmi(cells: DataFrame) -> DataFrame:
    """Normalised mutual information with the arithmetic mean; 1.0 when both sides are a single label."""
    weight = F.col("c") * F.log("c")
    sums = _margins(cells).agg(
        *[F.sum(F.when(F.col("level") == i, weight)).alias(n) for i, n in enumerate(["both", "a", "b"])],
        F.max(F.when(F.col("level") == 3, F.col("c"))).alias("n"),
    )
    entropy = {k: F.log("n") - F.col(k) / F.col("n") for k in ("both", "a", "b")}
    shared = F.greatest(entropy["a"] + entropy["b"] - entropy["both"], F.lit(0.0))
    mean = (entropy["a"] + entropy["b"]) / 2
    return sums.select(F.when(F.abs(mean) < 1e-15, F.lit(1.0)).otherwise(shared / mean).alias("nmi"))


def cluster_splits(
    a: DataFrame, b: DataFrame, on: list[str], titles: DataFrame | None = None, limit: int = REPORT_ROWS
) -> DataFrame:
    """The largest clusters of ``a`` that ``b`` separates: ``label, size, pieces, rank``.

    With ``titles`` (``on, seq, title``) each comes with its first titles. Swap the inputs for merges.
    """
    cells = contingency(a, b, on)
    broken = (
        cells.groupBy(F.col("label_a").alias("label"))
        .agg(F.sum("n").alias("size"), F.count("*").alias("pieces"))
        .filter("size >= 2 and pieces > 1")
    )
    top = first_rows(broken, [], [F.col("size").desc(), F.col("label")], limit)
    if titles is None:
        return top
    other = b.select(*on, F.col("label").alias("other_label"))
    members = a.join(top.select("label", "rank"), "label", "left_semi").join(other, on).join(titles, on)
    samples = first_rows(members, ["label"], [F.col("seq")], SAMPLE_TITLES, "sample")
    return top.join(samples, "label").select(
        "rank", "label", "size", "pieces", "sample", "other_label", F.left("title", F.lit(TITLE_LENGTH)).alias("title")
    )


def top_stories_compare(a: DataFrame, b: DataFrame, limit: int = 10) -> DataFrame:
    """Two rankings side by side. Inputs hold ``rank, size, n_sources, diversity_score, label``."""

    def side(stories: DataFrame, name: str) -> DataFrame:
        return stories.filter(F.col("rank") <= limit).select(
            "rank",
            F.col("size").alias(f"size_{name}"),
            F.col("n_sources").alias(f"sources_{name}"),
            F.col("diversity_score").alias(f"diversity_{name}"),
            F.left("label", F.lit(TITLE_LENGTH)).alias(f"label_{name}"),
        )

    return side(a, "a").join(side(b, "b"), "rank", "full")
