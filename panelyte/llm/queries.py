"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyte.llm import chat_format, lexical_search, url_reputation
from panelyte.llm.attention_lm import lm_scores
from panelyte.llm.bpe_fst import encode_decode
from panelyte.llm.embed_dedup import embedding_dedup
from panelyte.llm.exact_dedup import exact_dedup
from panelyte.llm.jaccard import jaccard_join
from panelyte.llm.packing import pack
from panelyte.llm.pii import find_personal_data
from panelyte.llm.quality import score_quality
from panelyte.llm.repair import damaged, repair_conversations
from panelyte.llm.shared import table
from panelyte.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"), keep_text=False)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mixed = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(mixed)))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"), keep_turns=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_reputation": op3_url_reputation,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_bpe_transducer": op5_bpe_transducer,
    "op6_attention_lm": op6_attention_lm,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_personal_data": op9_personal_data,
    "op10_jaccard": op10_jaccard,
    "op11_chat_format": op11_chat_format,
    "op12_repair": op12_repair,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_url_reputation": url_reputation.oracle(),
    "op11_chat_format": chat_format.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
