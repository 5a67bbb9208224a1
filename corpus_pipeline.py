"""The corpus pipeline: language, toxicity, near-duplicates, contamination, packing.

Each stage takes what the one before kept, as a table that was written and read again. All but the last return rows of
``documents`` with their own columns; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import decontamination, language, ngramjoin, packing, toxicity
from storyline.llm.common import table, text_remainder
from storyline.llm.queries import piece_digests
from storyline.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; null texts and texts without a letter go.

    The kernel classifier learns from two folds of three of the rows at hand. Without any labelled row there is nothing to
    tell languages by, and every text with a letter stays.
    """
    model = language.train(docs.select("doc_id", "text", "lang"), text_remainder("doc_id", 3) != 1)
    if model is None:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language.identify(docs, model)
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).select("doc.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below ``toxicity.TOXIC_FROM``. The machine learns from two folds of three of the labelled rows at hand."""
    machine = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), text_remainder("doc_id", 3) != 1)
    return toxicity.score(docs, machine).filter(F.col("score") < toxicity.TOXIC_FROM).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of at least 0.8 on runs of five words."""
    return ngramjoin.deduplicate(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words less than one in 20 lies in a window shared with the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, as ``op9_packing`` returns them."""
    return piece_digests(packing.pack(docs.select("doc_id", "text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", not_contaminated),
    ("packing", packed),
]

#: Classifiers, min-hashes and the packing programme have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
