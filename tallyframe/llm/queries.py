"""The named queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    alignment, chat, decontaminate, lm_score, mixing, near_dup, packing, pii, quality, secrets, sql, toxicity, trie, url_filter,
)
from tallyframe.llm.common import table, word_count

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


#: The one tool of op7's derived calls.
TOOLS = {
    "reply": {
        "type": "object",
        "properties": {
            "prompt": {"type": "string"}, "words": {"type": "integer", "minimum": 1}, "after": {"type": "array"},
        },
        "required": ["prompt", "words"],
        "additionalProperties": False,
    }
}


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """The conversations as calls and results: a user's turn calls ``reply``, the next turn is its result.

    From the second question on a call refers to the result of the one before.
    """
    turn = F.col("turn")
    arguments = F.struct(
        F.col("text").alias("prompt"), word_count(F.col("text")).alias("words"),
        F.when(turn >= 2, F.array(F.struct(F.concat(F.lit("c"), turn - 2).alias("$ref")))).alias("after"),
    )
    call = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("c"), turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments")
    )).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool")
        .otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result)
        .otherwise(F.col("text")).alias("text"),
    )


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chat(as_tool_calls(table(spark, folder, "conversations")), TOOLS)


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(table(spark, folder, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"))


def with_shared_heads(turns: DataFrame, family: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of conversation c - c % ``family``, then c's own turns after its first h.

    ``turns`` is as from ``trie.numbered``; h is crc32 of c in decimal, modulo
    ``longest``. Gives the turns with ``depth`` for ``place``, and all conv_ids.
    """
    conv_id = F.col("conv_id")
    h = F.crc32(conv_id.cast("string").cast("binary")) % longest
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    base = lengths.where(conv_id % family == 0).select(conv_id.alias("base"), F.col("length").alias("base_length"))
    members = lengths.select("conv_id", h.alias("h"), (conv_id - conv_id % family).alias("base")).join(base, "base", "left")
    members = members.withColumn("head", F.least("h", F.coalesce("base_length", F.lit(0))))
    # At most longest - 1 turns of a base, and at most 2 * family - 1 conversations with one base.
    heads = turns.where((conv_id % family == 0) & (F.col("place") < longest)).withColumnRenamed("conv_id", "base")
    heads = heads.join(members.select("conv_id", "base", "h"), "base").where("place <= h")
    own = turns.where(F.col("place") > h).join(members.select("conv_id", "h", "head"), "conv_id")
    bits = ["key_a", "key_b", "points"]
    rebuilt = heads.select("conv_id", F.col("place").alias("depth"), *bits).unionByName(
        own.select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), *bits)
    )
    return rebuilt, members.select("conv_id")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(*with_shared_heads(trie.numbered(table(spark, folder, "conversations"))))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_secrets, op2_decontaminate, op3_near_dup, op4_pii, op5_quality, op6_mixing, op7_chat, op8_url_filter, op9_toxicity,
    op10_lm_score, op11_alignment, op12_prefix_trie, op13_packing,
)}

ORACLES: dict[str, str] = {
    "op5_quality": sql.quality(), "op8_url_filter": sql.url_filter(), "op12_prefix_trie": sql.prefix_trie(),
}
