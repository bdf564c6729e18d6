"""Registered queries of this package and their SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spendtide.llm import chat, lexical, lines, minhash, mixing, packing, quality, sampling, sharding, substrings, topk, urls, warc
from spendtide.llm.common import table
from spendtide.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in SQL.items() if name in QUERIES}


# ---- 1 ----------------------------------------------------------------------------------


@query
def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), size=2).drop("text_hash")


# ---- 2 ----------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY, RANKS))


# ---- 3 ----------------------------------------------------------------------------------


@query
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return quality.judge(docs, long_lines=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "depleted"
    )


# ---- 4 ----------------------------------------------------------------------------------

RULES = [
    urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow"),
]


@query
def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf, "pages"), urls.rule_table(spark, RULES))


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that link to the hosts of two other pages each, so that there is a graph of hosts."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    n = F.lit(pages.count())
    hosts = pages.select(F.col("page_id").alias("to"), urls.host_of(F.col("url")).alias("host")).filter("host <> ''")
    ends = pages.select("page_id", F.explode(F.array_distinct(F.array((F.col("page_id") * 7 + 3) % n, (F.col("page_id") * 13 + 5) % n))).alias("to"))
    links = ends.join(hosts, "to").groupBy("page_id").agg(
        F.array_join(F.collect_list(F.concat(F.lit('<a href="http://'), F.col("host"), F.lit('/">'))), "").alias("links")
    )
    more = F.concat(F.coalesce("html", F.lit("")), F.coalesce("links", F.lit("")))
    return pages.join(links, "page_id", "left").select("page_id", "url", more.alias("html"))


@query
def linked_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Operator 4 on pages of linked hosts: scores travel over eight rounds, and decide pages without a rule."""
    return urls.judge_urls(linked_pages(spark, sf), urls.rule_table(spark, RULES))


# ---- 5 ----------------------------------------------------------------------------------


@query
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf, "documents").select("doc_id", "text"), 50).drop("spans")


# ---- 6 ----------------------------------------------------------------------------------


@query
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, words=lines.MIN_WORDS).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


# ---- 7 ----------------------------------------------------------------------------------


@query
def op7_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


# ---- 8 ----------------------------------------------------------------------------------

PROBE = "</s>[INST] ok [/INST]"


@query
def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat.format_chat(rows).select(
        "conv_id", "valid", "complete", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
    )
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        chat.loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "complete",
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid", "complete",
    )


# ---- 9 ----------------------------------------------------------------------------------

SHARDS = 8


@query
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    rows = table(spark, sf, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("bigint").alias("text_crc32"),
        "source", "lang",
    ).withColumn("length", F.col("size"))
    rows = sharding.ranked_codes(rows, ["source", "lang"]).drop("source", "lang")
    placed = sharding.kd_shards(rows, ["source_code", "lang_code", "length"], "size", ["text_crc32", "doc_id"], SHARDS)
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    return sharding.number_rows(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


# ---- 10 ---------------------------------------------------------------------------------

WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


@query
def op10_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, WEIGHTS).select(
        "doc_id", "source", F.col("block_").alias("block"), F.col("slot_").alias("slot"), F.col("start_").alias("start")
    )


# ---- 11 to 13 ---------------------------------------------------------------------------


@query
def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages"), "2024-01-01T00:00:00Z").drop("uri")


@query
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), F.col("item_id"))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
