"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import bpe, chat, collocations, decontamination, language, neardup, ngramjoin, packing, prefixtrie, sharding, suffixtree, toxicity, warc
from storyline.llm.common import table, text_remainder
from storyline.llm.oracles import ORACLES  # noqa: F401
from storyline.operators.ordering import first_rows


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id",
        F.col("words").alias("n_words"),
        decontamination.hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    hard = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digest_chats(chat.format_chats(turns))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record in the primary archive, and how it fares in a replica with spoiled and lost records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    spoiled = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    copy = F.when(~F.coalesce(F.col("page_id") % 211 == 9, F.lit(False)), F.sha2(warc.record_bytes(F.col("url"), F.col("page_id"), spoiled), 256))
    records = warc.materialize(warc.archive(pages, keep=(copy.alias("replica_sha256"),)), "archive")
    replica = records.filter("replica_sha256 is not null").select("file", "offset", F.col("replica_sha256").alias("sha256"))
    found = warc.audit(warc.merkle(records), warc.merkle(replica))
    return records.join(found, ["file", "offset"], "left").select(
        "page_id", F.col("file").cast("bigint").alias("file"), "offset", "length", "sha256", F.coalesce("status", F.lit("sound")).alias("status")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = text_remainder("doc_id", 3)
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 1)
    score = F.col("score")
    return toxicity.score(docs, machine).select("doc.doc_id", "score").select(
        "doc_id", (fold == 1).alias("held_out"), "score", (score >= toxicity.TOXIC_FROM).cast("int").alias("predicted")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        "row.doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.join(docs).select("doc_id", "n_links", "class_id", "kept")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixtree.score(docs, text_remainder("doc_id", 7) == 2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(packing.pack(docs))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = text_remainder("doc_id", 3)
    model = language.train(docs.select("doc_id", "text", "lang"), fold != 1)
    return language.identify(docs.select("doc_id", "text"), model).select("doc.doc_id", "lang_pred", "score").select(
        "doc_id", (fold == 1).alias("held_out"), "lang_pred", "score"
    )


#: Phrases reported per language.
TOP_PHRASES = 2000


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    phrases = collocations.mine(docs).filter(~F.col("dropped")).select("lang", "phrase", "a", "l", "r", "n", "score")
    ranked = first_rows(phrases, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], TOP_PHRASES)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.decode(coded).select(
        "doc.doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefixtrie.rebuilt(prefixtrie.number_turns(table(spark, sf_dir, "conversations")))
    return prefixtrie.build(turns, members)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_chat": op3_chat,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_collocations": op11_collocations,
    "op12_bpe": op12_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
