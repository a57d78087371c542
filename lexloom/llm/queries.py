"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import chat, decontaminate, divergence, extract, jaccard, language, media, oracles, packing, quality, sharding, substring, suffix, trie

QUERIES = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def _fold(k: int) -> F.Column:
    """crc32 of the id as text modulo ``k``."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % k, F.lit(0))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(items, "UTF-8"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(_documents(spark, sf_dir, "doc_id", "text"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir, "doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.learn(docs.filter(_fold(4) != 2))
    ids = docs.select(F.col("doc_id"), "text")
    return language.predict(ids, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_documents(spark, sf_dir, "doc_id", "text"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.learn(docs, labels)).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.suffix_dedup(_documents(spark, sf_dir, "doc_id", "text"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = chat.read_back(chat.expand(turns.unionByName(probe)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.write_media(_documents(spark, sf_dir, "doc_id", "text")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES |= {
    f.__name__: f
    for f in (op2_benchmark_decontamination, op3_substring_dedup, op4_packing, op5_language_id, op6_sharding, op7_quality_classifier, op8_suffix_array_dedup, op9_chat_formatting, op10_media_columns)
}



def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir, "doc_id", "text"), shingle=5, percent=80)


QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir, "text", "lang", "source"), min_docs=30, top=50)


QUERIES["op13_source_divergence"] = op13_source_divergence


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES["op12_conversation_trie"] = op12_conversation_trie


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op11_html_extraction"] = op11_html_extraction
