"""Registered queries of the operators, over whole tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, dedup, htmltext, langid, secrets, shards, simhash, toxicity, trie, warc, whiten, winnow
from .common import table

SHARD_BYTES = 1 << 20  # one shard is one read of a streaming loader

#: Tools of the chat query's stand-in calls.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "lookup": {"type": "object", "required": ["key"], "properties": {"key": {"type": "string", "maxLength": 400},
                                                                   "scope": {"type": "string", "enum": ["page", "site"]}}},
    "measure": {"type": "object", "required": ["values"], "properties": {"values": {"type": "array", "items": {"type": "integer"}}}},
}


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE: encode every document and decode it again."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup report: of equal texts the largest doc_id stays."""
    return dedup.report(table(spark, sf_dir, "documents"), keep="max")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing report of documents against the benchmark, windows of 13 words."""
    return winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as whole-file gzip WARC, normalised to one member per record, read back by index."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by extendible hashing."""
    return shards.assign(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by Kneser-Ney character models."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with linked multipart credentials."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def chat_messages(conversations: DataFrame) -> DataFrame:
    """Stand-in tool traffic in the operator's input schema: each assistant turn carries one call made of
    its own whole text, each later user turn is a tool message naming the turn before.  A call waits for the
    one two turns back; some wait for two calls, name a call that is not there, use an identifier again, or
    wait in a circle."""
    text = F.coalesce("text", F.lit(""))
    words = F.split(text, " ")
    n = F.length(text)
    turn, odd = F.col("turn"), F.col("conv_id") + F.col("turn")
    name = F.element_at(F.array(*[F.lit(k) for k in TOOLS]), (n % 3 + 1).cast("int"))
    call = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    search = F.to_json(F.struct(text.alias("query"), (n % 60).alias("limit")))
    lookup = F.to_json(F.struct(text.alias("key"), F.when(n % 2 == 0, "page").otherwise("book").alias("scope")))
    measure = F.to_json(F.struct(F.transform(words, lambda w: F.length(w)).alias("values")))
    arguments = F.when(n % 3 == 0, search).when(n % 3 == 1, lookup).otherwise(
        F.when(n % 5 == 0, F.concat(measure, F.lit("]"))).otherwise(measure))
    after = (F.when((odd % 13 == 4) & (turn < 3), F.array(call(turn + 2)))  # that call waits for this one
             .when(odd % 17 == 3, F.array(call(turn - 2), call(F.lit(-1))))
             .when((turn % 64 == 5), F.array(call(turn - 2), call(turn - 4)))
             .when(turn >= 3, F.array(call(turn - 2))))
    own = F.when((odd % 19 == 6) & (turn >= 3), call(turn - 2)).otherwise(call(turn))
    calls = F.to_json(F.array(F.struct(own.alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))))
    is_answer = (F.col("role") == "user") & (turn > 0)
    return conversations.select(
        "conv_id", "turn", F.when(is_answer, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(F.col("role") == "assistant", calls).alias("tool_calls"),
        F.when(is_answer, call(turn - 1)).alias("tool_call_id"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls linked, ordered, validated and serialised, over all conversations."""
    return chat.format_chats(chat_messages(table(spark, sf_dir, "conversations")), TOOLS)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened on their first 8 components, found by spectral divide and conquer."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, by block digests."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by differencing pages of near URLs."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_codec, op2_exact_dedup, op3_decontamination, op4_warc, op5_sharding, op6_language_id, op7_toxicity,
                            op8_secret_scan, op9_simhash_dedup, op10_tool_calls, op11_embedding_whitening, op12_prefix_trie, op13_html_extraction)}

SQL: dict[str, str] = {
    "op2_exact_dedup": dedup.ORACLE_SQL,
    "op3_decontamination": winnow.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_sharding": shards.oracle_sql(SHARD_BYTES),
    "op12_prefix_trie": trie.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    return OPERATORS | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
