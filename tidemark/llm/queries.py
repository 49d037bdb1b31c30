"""One query per operator, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment,
    bag_minhash,
    chat,
    decontaminate,
    hard_negatives,
    host_rules,
    language,
    mixing,
    personal_data,
    sharding,
    suffix_dedup,
    token_files,
    toxicity,
)
from tidemark.llm.oracles import oracle_sql

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

__all__ = ["oracle_sql", "queries"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def _query(f):
    _queries[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bag_minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id")


@_query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return removed.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return token_files.token_files(documents, TOKENIZER, encode_special_tokens=False)


def _held_out(modulus: int, remainder: int):
    return F.coalesce(
        F.expr(f"crc32(CAST(doc_id AS string)) % {modulus} = {remainder}"), F.lit(False)
    )


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    contents = language.dictionaries(documents.where(~_held_out(4, 2)))
    found = language.identify(documents.select("doc_id", "text"), contents)
    return found.select("document.doc_id", "lang_pred", "score", "rejected").withColumn(
        "held_out", _held_out(4, 2)
    )


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic AS label")
    drawn = toxicity.draw(labels.where(~_held_out(3, 1)))
    model = toxicity.fit(documents.join(F.broadcast(drawn), "doc_id"))
    found = toxicity.score(documents, model)
    return found.select("document.doc_id", "score", "predicted").withColumn(
        "held_out", _held_out(3, 1)
    )


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


@_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[
            F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS long) AS n_{kind}")
            for kind in personal_data.KINDS
        ],
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )


# A conversation whose texts are control strings; it comes as a record of messages.
CONTROL_RECORD = (
    '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"},'
    ' {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
)


@_query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns_from_rows(_table(spark, sf_dir, "conversations"))
    record = spark.range(1).select(
        F.lit(-7).alias("conv_id"), F.lit(CONTROL_RECORD).alias("record")
    )
    turns, _ = chat.turns_from_json(record)
    return chat.conversation_digests(chat.format_chats(rows.unionByName(turns)))


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


@_query
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@_query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "similarity", "start", "n_windows")


@_query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(_table(spark, sf_dir, "documents"), TOKENIZER, PIECES).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"),
        hard_negatives.quantised("embedding", 256).alias("vector"),
    )
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
